"""Substring dedup, phrase stripes and fill-in-the-middle against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codestrata.llm import phrase_stripes
from codestrata.llm.doubling_dedup import ladder, lengths, strip_repeats
from codestrata.llm.fill_in_middle import fill_in_middle, line_list, restored
from codestrata.llm.phrase_stripes import collocations

DOC = "doc_id long, text string, lang string, key string, rk long, n long, f string, h1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2, "f", "h") for i, t, lang in rows], DOC)


def stripped(rows, length):
    """Rows of (doc_id, n_words, n_removed, kept) with documents of one id in the order given by ``rows``."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone.update(range(i, i + length))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), " ".join(kept)))
    return out


@pytest.mark.parametrize("bits", [7, 20])
@pytest.mark.parametrize("length,base", [(4, 1), (8, 2), (20, 5)])
def test_strip_repeats(spark, bits, length, base):
    rnd = random.Random(length + bits)
    passage = [f"p{i}" for i in range(2 * length + 3)]
    rows = []
    for i in range(60):
        words = [f"w{rnd.randrange(12)}" if i % 3 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 90))]
        if i % 4 == 0:
            a = rnd.randrange(4)
            words[5:5] = passage[a : a + length + rnd.randrange(-1, length)]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, " \n "), (105, "é x " * (3 * length)), (106, "w " * 5000)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    table = docs(spark, [(i, t, "en") for i, t in shuffled]).repartition(5)
    found = strip_repeats(table, length, base, bits, chunk=500).collect()
    assert sorted(tuple(r) for r in found) == stripped(rows, length)


def test_strip_repeats_of_null_and_repeated_ids(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(None, a), (5, a), (7, b), (7, b), (7, b), (None, b), (None, None)]
    found = strip_repeats(docs(spark, [(i, t, None) for i, t in rows]).repartition(4), chunk=40).collect()
    want = [(5, 30, 0, a), (7, 30, 0, b), (7, 30, 0, b), (7, 30, 0, b), (None, 0, 0, ""), (None, 30, 30, ""), (None, 30, 30, "")]
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)
    same_id = strip_repeats(docs(spark, [(3, a, None), (3, a + " x", None)])).collect()
    assert sorted(r.n_removed for r in same_id)[0] == 0 and sorted(r.n_removed for r in same_id)[1] == 30
    assert strip_repeats(docs(spark, rows and [])).collect() == []


def test_ladder():
    words = np.array([random.Random(i % 7).randrange(2**63) for i in range(50)], np.uint64)
    for h, size in zip(ladder(words, 3, 12), lengths(3, 12), strict=True):
        same = defaultdict(set)
        for i in range(len(h)):
            same[tuple(words[i : i + size])].add(int(h[i]))
        assert all(len(v) == 1 for v in same.values()) and len(set(h.tolist())) == len(same)
    with pytest.raises(ValueError, match="doubled"):
        lengths(3, 20)


def best_phrases(rows, least, top, most=5):
    n, f = Counter(), defaultdict(Counter)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        listed = []
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in often.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("bits", [7, 20])
def test_collocations(spark, bits):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        words = [rnd.choice("the of a New York City É 漢字 x y z".split()) for _ in range(rnd.randrange(0, 60))]
        for _ in range(3):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(["New York City", "as soon as possible now", "ha ha ha ha ha ha", "a b", "end.", "x, y!", "q\nr\x0bs"]))
        rows.append((i, rnd.choice([" ", "\t", "  "]).join(words), [None, "en", "fr"][i % 3]))
    rows += [(200, None, "en"), (201, "", None), (202, " . ", "de"), (5, rows[5][1], rows[5][2]), (None, "ha ha " * 3000, "it")]
    table = docs(spark, rows).repartition(5)
    found = collocations(table, least=4, top=40, bits=bits, chunk=700, lanes=3).collect()
    assert sorted(tuple(r) for r in found) == best_phrases(rows, 4, 40)
    assert collocations(table.limit(0)).collect() == []


def test_stripes_hold_one_chunk_and_each_word_once(monkeypatch):
    made, most = [], []

    class Watched(phrase_stripes._Words):
        def __init__(self, lang, texts):
            most.append(sum(w() is not None for w in made))
            super().__init__(lang, texts)
            made.append(weakref.ref(self))
            listed = [v for v in vars(self).values() if isinstance(v, list)]
            assert all(len(v) <= 3 for v in listed)

    monkeypatch.setattr(phrase_stripes, "_Words", Watched)
    batch = pa.record_batch([pa.array(["en"] * 9), pa.array(["a b c " * 50] * 9)], ["lang", "text"])
    open_ = type("Held", (), {"value": np.full(16, ~np.uint64(0))})
    runs = [phrase_stripes._first_words(300), phrase_stripes._stripes(3, [open_, open_], 300, 3, 8)]
    assert [len(list(run(iter([batch])))) for run in runs] == [9, 9]
    assert most == [0] * 18


def test_collocation_scores_are_exact(spark):
    # 1000 * a * n / (l * r) with products beyond 64 bits, computed as in the operator's expression
    big = spark.sql("SELECT cast(1000 AS decimal(4,0)) * cast(9999999999999 AS decimal(13,0)) * cast(9999999999999999 AS decimal(16,0)) div (cast(9999999999998 AS decimal(13,0)) * cast(9999999999997 AS decimal(13,0))) AS s")
    assert big.first().s == 1000 * 9999999999999 * 9999999999999999 // (9999999999998 * 9999999999997)


def rewritten(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "é", "\n", "\n\n", "漢", "😀", "< P>", "\r", "<"]) for _ in range(rnd.randrange(0, 300))) for _ in range(150)]
    texts += [None, "", "\n", "a<P>b\nc", "<", "x\n" * 40_000, "no line end", "<S", "P>\n<M"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[4])]
    table = docs(spark, [(i, t, None) for i, t in rows]).repartition(3)
    found = fill_in_middle(table)
    got = found.select("*", restored(found.output, found.form).alias("back")).collect()
    want = sorted((rewritten(i, t) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert fill_in_middle(table, rate=0).where("form <> 'plain'").count() == 0
    assert fill_in_middle(table.limit(0)).collect() == []


def test_skip_list_finds_every_rank():
    rnd = random.Random(6)
    for n in (0, 1, 4, 5, 17, 900):
        lines = ["".join(rnd.choice("aé漢😀") for _ in range(rnd.randrange(6))) + "\n" for _ in range(n)]
        found = line_list("".join(lines).encode())
        assert n < 17 or len(found.lanes) > 1
        for rank in range(n + 1):
            before = "".join(lines[:rank])
            assert found.find(rank) == (len(before), len(before.encode()))
