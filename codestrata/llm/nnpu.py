"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import held_out, row_key, small_batches, uniform

_WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are features beside the words themselves: stems carry over to unseen endings.
_STEMS = (3, 4, 5, 6)


def features_of(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in _STEMS if len(word) > k)]


def choose_features(p: dict[str, int], u: dict[str, int], n_p: int, n_u: int, size: int) -> list[str]:
    """Features that are commoner among the confirmed examples, by their standardised excess; ties by name.

    ``p`` and ``u`` count the confirmed and the unlabelled texts that have a feature, out of ``n_p`` and ``n_u``.
    """

    def excess(f: str) -> float:
        a, b = p[f] / n_p, u[f] / n_u
        return (a - b) / ((b + 1 / n_u) / n_p) ** 0.5

    ranked = sorted((-excess(f), f) for f in p)
    return [f for e, f in ranked[:size] if e < -3]


def fit_nnpu(p_rows: list[np.ndarray], u_rows: list[np.ndarray], dim: int, prior: float, rounds: int = 400, step: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic classifier under the non-negative risk.

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]).  Where the second part turns negative, the
    model has begun to fit the examples themselves, and the step goes against it instead.
    """
    n_p, n_u = len(p_rows), len(u_rows)
    sizes = np.array([len(r) for r in p_rows + u_rows])
    ids = np.concatenate(p_rows + u_rows) if sizes.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(n_p + n_u), sizes)
    w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    w[dim] = np.log(prior / (1 - prior))
    is_p = np.arange(n_p + n_u) < n_p
    for t in range(1, rounds + 1):
        g = np.bincount(row, w[ids], n_p + n_u) + w[dim]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        negative = np.logaddexp(0, g)
        below = negative[~is_p].mean() - prior * negative[is_p].mean() < 0
        d_plus = np.where(is_p, prior * (s - 1) / n_p, 0)
        d_minus = np.where(is_p, -prior * s / n_p, s / n_u)
        d = -d_minus if below else d_plus + d_minus
        grad = np.append(np.bincount(ids, d[row], dim), d.sum()) + decay * np.append(w[:dim], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class _Member:
    """The examples of one member: every feature is held once and numbered, a text is an array of numbers."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: dict[bool, list[np.ndarray]] = {True: [], False: []}

    def add(self, text: str | None, confirmed: bool) -> None:
        numbers, found = self.numbers, set()
        for word in set(_WORD.findall((text or "").lower())):
            for f in features_of(word):
                found.add(numbers.setdefault(f, len(numbers)))
        self.texts[confirmed].append(np.fromiter(found, np.int32, len(found)))

    def fit(self, size: int, prior: float, least: int = 4) -> tuple[list[str], np.ndarray] | None:
        """Chosen features and their weights, the bias last; nothing unless there are examples of both kinds."""
        if not self.texts[True] or not self.texts[False]:
            return None
        p, u = (np.bincount(np.concatenate(self.texts[c]), minlength=len(self.numbers)) for c in (True, False))
        enough = {f: i for f, i in self.numbers.items() if p[i] >= least}
        counts = [{f: int(x[i]) for f, i in enough.items()} for x in (p, u)]
        names = choose_features(*counts, len(self.texts[True]), len(self.texts[False]), size)
        place = np.full(len(self.numbers), -1)
        place[[enough[f] for f in names]] = np.arange(len(names))
        rows = [[np.sort(x[x >= 0]) for x in (place[t] for t in self.texts[c])] for c in (True, False)]
        return names, fit_nnpu(*rows, len(names), prior)


def toxicity_model(
    docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000, members: int = 3, size: int = 3000, seed: int = 11
) -> dict[str, float]:
    """Weights by feature ("" is the bias) of classifiers averaged over ``members``; empty without confirmed examples.

    The classifiers see bounded samples only: about ``positives`` confirmed toxic texts and ``unlabelled`` texts of the
    learning rows (crc32 of the id not divisible by 5), dealt out to the members by content.  The class prior is the
    share of toxic among all labelled learning rows.  Labels of rows without a toxic value count for nothing.
    """
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    stat = learn.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("pos")).first()
    if not stat["pos"]:
        return {}
    prior = min(max(stat["pos"] / stat["n"], 0.01), 0.5)
    members = max(1, min(members, stat["pos"] // 500))  # a member needs some hundred examples to choose its features from
    ids = cut(
        learn.where((F.col("toxic") == 1) & (uniform(F.lit(seed), F.col("doc_id")) < positives / stat["pos"])).select("doc_id").distinct()
    )
    plain = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    n = plain.select("doc_id").count()
    # at most about ``positives`` ids, so the list may be broadcast
    confirmed = plain.join(F.broadcast(ids), "doc_id", "left_semi").select("text", F.lit(True).alias("confirmed"))
    others = plain.where(uniform(F.lit(seed + 1), F.col("doc_id"), F.col("text")) < unlabelled / max(n, 1)).select("text", F.lit(False).alias("confirmed"))
    sample = confirmed.unionByName(others).withColumn("member", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(members)))
    fitted = cut(sample.repartitionByRange(members, "member").select("text", "confirmed", "member").mapInArrow(_fit_parts(size, prior), "feature string, weight double, member long"))
    held = max(fitted.select("member").distinct().count(), 1)
    # every member names at most ``size`` features
    rows = fitted.groupBy("feature").agg(F.sum("weight").alias("w")).toArrow()
    return {f: w / held for f, w in zip(rows["feature"].to_pylist(), rows["w"].to_pylist(), strict=True)}


def _fit_parts(size: int, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Member] = {}
        for batch in small_batches(batches):
            for text, confirmed, member in zip(*(batch.column(c).to_pylist() for c in ("text", "confirmed", "member")), strict=True):
                held.setdefault(member, _Member()).add(text, confirmed)
        for k in list(held):
            if (found := held.pop(k).fit(size, prior)) is not None:
                names, w = found
                yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array(w), pa.array([k] * len(w), pa.int64())], ["feature", "weight", "member"])

    return run


def _scorer(weights: dict[str, float]):
    bias = weights.get("", -30.0)
    known = {f: w for f, w in weights.items() if f}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[str, tuple[str, ...]] = {}
        for batch in small_batches(batches):
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                found: set[str] = set()
                for word in set(_WORD.findall((text.as_py() or "").lower())):
                    own = hits.get(word)
                    if own is None:
                        if len(hits) > 100_000:
                            hits.clear()
                        own = hits[word] = tuple(f for f in features_of(word) if f in known)
                    found.update(own)
                scores[i] = bias + sum(known[f] for f in sorted(found))
            scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores)], [*columns, "score"])

    return run


def _keeper(weights: dict[str, float]):
    score = _scorer(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for scored in score(iter([batch.select(["text"])])):
                yield batch.filter(pa.array(scored.column("score").to_numpy() < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, **sampling: int) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; nulls and empty texts stay."""
    return docs.mapInArrow(_keeper(toxicity_model(docs, labels, **sampling)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **sampling: int) -> DataFrame:
    """One row per document: doc_id, rk (content key), score in 0..1, predicted (1 from 0.5 on).

    Whole texts are scored and nothing but the text is seen by a score.  A null text scores like an empty one, repeated
    rows score alike, documents without a label are scored too, labels of unknown ids and repeated labels do no
    harm, and without any confirmed example every score is close to 0.
    """
    weights = toxicity_model(docs, labels, **sampling)
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", row_key().alias("rk"), "text")
    scored = rows.mapInArrow(_scorer(weights), f"doc_id {id_type}, rk long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
