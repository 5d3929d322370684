"""Language identification in two steps: the family first, then one-versus-one linear machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import held_out, uniform

#: Hash buckets of character sequences of one to three letters.
BUCKETS = 1 << 12
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def profile(text: str) -> np.ndarray:
    """Root-scaled unit vector of the character one- to three-grams of a whole text, lower-cased; only letters and gaps count."""
    lowered = text.lower()
    code = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
    if not len(code):
        return np.zeros(BUCKETS, np.float32)
    # everything in ASCII that is no letter is one gap, whatever its kind
    code = np.where((code < 97) | ((code > 122) & (code < 170)), np.uint32(32), code)
    total = np.zeros(BUCKETS, np.int64)
    mixed = code * _ODD[0]
    for n in range(1, 4):
        if len(code) < n:
            break
        h = mixed[: len(code) - n + 1].copy()
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _ODD[i] + mixed[i : len(code) - n + 1 + i]
        h = (h ^ (h >> np.uint32(13))) * _ODD[1] + np.uint32(n)
        total += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    v = np.sqrt(total, dtype=np.float32)
    return v / max(np.linalg.norm(v), 1e-12)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, c: float = 20.0) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge loss) by accelerated gradient steps.

    Both classes weigh the same, however many rows they have.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(z.shape[1], np.float32)
    ahead, t, step = w.copy(), 1.0, np.float32(1 / (1 + 4 * c))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        grad = ahead - 2 * z.T @ (weight * y * slack)
        grad[-1] -= ahead[-1]
        new = ahead - step * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


def families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages joined by the likeness of their mean profiles, closest first, down to the square root of their number."""
    groups = [[name] for name in sorted(centres)]
    like = {frozenset(p): float(centres[p[0]] @ centres[p[1]]) for p in combinations(sorted(centres), 2)}
    while len(groups) > max(1, round(len(centres) ** 0.5)):
        near = lambda a, b: np.mean([like[frozenset((x, y))] for x in a for y in b])
        a, b = max(combinations(groups, 2), key=lambda p: near(*p))
        groups = [g for g in groups if g is not a and g is not b] + [sorted(a + b)]
    return sorted(groups)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [profile(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary())], ["lang", "v"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v").to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(BUCKETS, np.float64))
            total[lang] += np.frombuffer(v, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])


def _fit_tasks(sides: dict[int, tuple[set[str], set[str]]]):
    """One machine per group: its rows are the bounded sample of its languages."""

    def run(key, frame):
        task = int(key[0].as_py())
        x = np.array([np.frombuffer(v, np.float32) for v in frame.column("v").to_pylist()])
        y = np.array([1.0 if lang in sides[task][0] else -1.0 for lang in frame.column("lang").to_pylist()])
        return pa.table({"task": pa.array([task], pa.int64()), "w": pa.array([fit_svm(x, y).astype(np.float32).tobytes()], pa.binary())})

    return run


def language_model(docs: DataFrame, per_language: int = 500, seed: int = 23) -> tuple[list[list[str]], dict, dict]:
    """Families, machines of family against family, and machines of language against language within each family.

    Machines see a sample of about ``per_language`` texts of each language among the learning rows (crc32 of the id not
    divisible by 5, lang not null). The sample grows with the number of languages only; each machine is fitted in a
    task of its own, and what reaches the driver is one weight vector each.
    """
    learn = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], {}, {}
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    chosen = learn.where(uniform(F.lit(seed), F.col("doc_id"), F.col("text")) < rate[F.col("lang")]).select("lang", "text")
    vectors = cut(chosen.mapInArrow(_profiles, "lang string, v binary"))
    # one sum per language and part of the bounded sample
    centres: dict[str, np.ndarray] = {}
    for r in vectors.mapInArrow(_centres, "lang string, v binary").toArrow().to_pylist():
        centres[r["lang"]] = centres.get(r["lang"], 0) + np.frombuffer(r["v"], np.float64)
    groups = families({k: v / max(np.linalg.norm(v), 1e-12) for k, v in centres.items()})
    pairs = [("family", a, b) for a, b in combinations(range(len(groups)), 2)]
    pairs += [("lang", a, b) for g in groups for a, b in combinations(g, 2)]
    sides = {i: (set(groups[a]), set(groups[b])) if kind == "family" else ({a}, {b}) for i, (kind, a, b) in enumerate(pairs)}
    if not pairs:
        return groups, {}, {}
    asked = F.create_map(*[x for lang in centres for x in (F.lit(lang), F.array(*[F.lit(i) for i, (a, b) in sides.items() if lang in a | b]))])
    fitted = vectors.select("lang", "v", F.explode(asked[F.col("lang")].cast("array<bigint>")).alias("task")).groupBy("task").applyInArrow(_fit_tasks(sides), "task long, w binary")
    weights = {r["task"]: np.frombuffer(r["w"], np.float32) for r in fitted.toArrow().to_pylist()}
    by_kind = lambda kind: {(a, b): weights[i] for i, (k, a, b) in enumerate(pairs) if k == kind}
    return groups, by_kind("family"), by_kind("lang")


def vote(names: list, machines: dict, margin) -> tuple[object, float]:
    """Winner of all machines among ``names`` by votes, then by summed margins, and its mean assurance (0 to 1)."""
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for a, b in combinations(names, 2):
        m = margin(machines[a, b])
        votes[a if m > 0 else b] += 1
        for name, s in ((a, m), (b, -m)):
            sums[name] += s
            sure[name] += 1 / (1 + np.exp(-np.clip(4 * s, -30, 30)))
    best = max(names, key=lambda n: (votes[n], sums[n]))
    return best, sure[best] / (len(names) - 1)


def _predictor(groups: list[list[str]], of_family: dict, of_language: dict):
    numbers = list(range(len(groups)))
    machines = [*of_family.items(), *of_language.items()]
    stacked = np.array([w for _, w in machines], np.float32) if machines else np.zeros((0, BUCKETS + 1), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {pair: i for i, (pair, _) in enumerate(machines)}
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                t = text.as_py()
                if not groups or t is None or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                margins = stacked[:, :-1] @ profile(t) + stacked[:, -1]
                margin = margins.__getitem__
                family, sure = vote(numbers, {p: place[p] for p in of_family}, margin)
                lang, within = vote(groups[family], {p: place[p] for p in of_language}, margin)
                names.append(lang)
                scores.append(float(sure * within))
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (assurance of both steps, multiplied).

    Whole texts are profiled and nothing but the text is seen by a prediction. Null texts and texts without any letter are
    ``und`` with score 0, as is everything if no row can be learnt from; one learnt language is always predicted;
    repeated rows get equal rows.
    """
    model = language_model(docs, per_language)
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_predictor(*model), f"doc_id {id_type}, lang_pred string, score double")
