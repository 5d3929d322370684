"""Phrase collocations from stripes: every prefix keys a counter of next words, and stripes are merged entry by entry."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .key_filter import BITS, bit_table, may_hold
from .shingles import mix

#: Least occurrences of a candidate, most words of a phrase, and rows reported per language.
LEAST, WORDS, TOP = 100, 5, 2000
#: Bytes of text of one language that a task works on at a time, and lanes that a stripe is split into by next word.
CHUNK, LANES = 8 << 20, 16

#: Lower-case A-Z and blank the characters that end a piece; and the kind of each byte: 0 word, 1 blank, 2 end of a piece.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes(32 if b in _ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b in _ENDS else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


def _extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases that are one word longer."""
    return mix(keys * _A + words * _B)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class _Words:
    """The words of a chunk of one language: hash, number of the piece and id of each; bytes and hashes of different ones.

    Bytes are held once per different word: an object for each word of a chunk takes many times the chunk itself.
    """

    def __init__(self, lang: str, texts: list[bytes]):
        data = b"\n".join(texts)  # pieces end with their text
        kind = _KIND[np.frombuffer(data, np.uint8)]
        begins = np.flatnonzero((kind == 0) & (np.concatenate([[1], kind[:-1]]) != 0))
        self.lang, self.piece = lang, np.cumsum(kind == 2, dtype=np.int32)[begins]
        del kind, begins
        listed = data.translate(_CLEAN).split()
        self.hash = _word_hashes(listed)
        self.distinct, first, self.id = np.unique(self.hash, return_index=True, return_inverse=True)
        self.word = [listed[i] for i in first.tolist()]

    def places(self, k: int, tables: list[np.ndarray]) -> np.ndarray:
        """Starts of phrases of ``k`` words both whose parts of ``k - 1`` words may be frequent."""
        n = len(self.id)
        start = np.full(len(self.distinct), _lang_key(self.lang))
        good = may_hold(tables[0], _extend(start, self.distinct))[self.id]
        keys = _extend(start, self.distinct)[self.id]
        for j in range(2, k + 1):
            at = np.flatnonzero(good[:-1] & good[1:]) if n else np.empty(0, np.int64)
            at = at[at + j <= n]
            at = at[self.piece[at] == self.piece[at + j - 1]]
            if j == k or not len(at):
                return at
            longer = _extend(keys[at], self.hash[at + j - 1])
            keys, good = np.zeros(n, np.uint64), np.zeros(n, bool)
            keys[at], good[at] = longer, may_hold(tables[j - 1], longer)
        return at


def _by_language(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[_Words]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def take(lang: str) -> _Words:
        sizes.pop(lang)
        return _Words(lang, held.pop(lang))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes()
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= chunk:
                yield take(lang)
            elif sum(sizes.values()) >= 2 * chunk:
                yield take(max(sizes, key=sizes.get))
    for lang in list(held):
        yield take(lang)


def _first_words(chunk: int):
    """The stripe of the empty prefix, as rows: lang, word, n; the row of a null word carries all words of the chunk."""

    def counted(words: _Words) -> pa.RecordBatch:
        seen = np.bincount(words.id, minlength=len(words.distinct))
        columns = [pa.array([words.lang] * (len(seen) + 1)), pa.array([*words.word, None], pa.string()), pa.array(np.append(seen, len(words.id)))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    # map holds no chunk while the next one is made
    return lambda batches: map(counted, _by_language(batches, chunk))


def _stripes(k: int, held: list, chunk: int, lanes: int, buckets: int):
    """Stripes of the prefixes of ``k - 1`` words, packed by bucket: lang, bucket, stripes.

    Each line is a stripe, its fields parted by tabs: the prefix, then next words, each with its count unless that is one.
    """

    def packed(words: _Words, tables: list[np.ndarray]) -> pa.RecordBatch | None:
        at = words.places(k, tables)
        if not len(at):
            return None
        size = len(words.distinct)
        name = words.id[at]
        for i in range(1, k - 1):  # equal prefixes get equal names
            name = np.unique(name * size + words.id[at + i], return_inverse=True)[1]
        entries, where, seen = np.unique(name * size + words.id[at + k - 1], return_index=True, return_counts=True)
        place, prefix = at[where], entries // size
        del at, name, where, entries
        keys = words.hash[place]
        for i in range(1, k - 1):
            keys = _extend(keys, words.hash[place + i])
        lane = (words.hash[place + k - 1] >> np.uint64(32)) % np.uint64(lanes)
        bucket = (mix(keys + lane) % np.uint64(buckets)).astype(np.int64)
        del keys, lane
        order = np.argsort(bucket, kind="stable")
        place, prefix, seen, bucket = place[order], prefix[order], seen[order], bucket[order]
        del order
        word, ids = words.word, words.id
        tabbed = [b"\t" + w for w in word]
        fields = [tabbed[i] for i in ids[place + k - 1].tolist()]
        for i in np.flatnonzero(seen > 1).tolist():
            fields[i] += b" %d" % seen[i]
        new = np.diff(bucket, prepend=-1) != 0
        for i in np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | new).tolist():
            start = place[i]
            fields[i] = b"\n" + b" ".join([word[w] for w in ids[start : start + k - 1].tolist()]) + fields[i]
        cuts = np.append(np.flatnonzero(new), len(fields)).tolist()
        stripes = [b"".join(fields[a:b])[1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([words.lang] * len(stripes)), pa.array(bucket[new]), pa.array(stripes, pa.string())], ["lang", "bucket", "stripes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in held]
        # map and filter hold no chunk while the next one is made
        return filter(None, map(lambda words: packed(words, tables), _by_language(batches, chunk)))

    return run


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        phrases = [p.as_buffer().to_pybytes().split(b" ") for p in batch.column("phrase")]
        keys = np.array([_lang_key(lang) for lang in batch.column("lang").to_pylist()], np.uint64)
        for i in range(len(phrases[0]) if phrases else 0):
            keys = _extend(keys, _word_hashes([p[i] for p in phrases]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def phrase_counts(docs: DataFrame, least: int = LEAST, words: int = WORDS, bits: int = BITS, chunk: int = CHUNK, lanes: int = LANES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, k, prefix, phrase, f) of one to ``words`` words, and n (lang, n), the words of each language.

    ``docs`` has lang and text, neither null. Each length is one pass over the texts: a phrase is counted only where both its
    parts that are a word shorter may be frequent, which a bit table of fixed size tells. The table lets every frequent phrase through.
    """
    first = docs.mapInArrow(_first_words(chunk), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    first = cut(first.where(f"f >= {least} OR word IS NULL"))
    n = first.where("word IS NULL").select("lang", F.col("f").alias("n"))
    found = first.where("word IS NOT NULL").select("lang", F.lit(1).alias("k"), F.lit("").alias("prefix"), F.col("word").alias("phrase"), "f").where(f"f >= {least}")
    levels, held = [found], []
    buckets = max(256, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for k in range(2, words + 1):
        table, kept = bit_table(levels[-1].select("lang", "phrase").mapInArrow(_phrase_keys, "key long"), bits)
        if not kept:
            break
        held.append(table)
        stripes = docs.mapInArrow(_stripes(k, held, chunk, lanes, buckets), "lang string, bucket long, stripes string")
        # stripes of a prefix meet in the buckets of its lanes; their entries are added there without another shuffle
        met = stripes.repartition("lang", "bucket").select("lang", "bucket", F.explode(F.split("stripes", "\n")).alias("s"))
        met = met.select("lang", "bucket", F.split("s", "\t").alias("s")).select("lang", "bucket", F.col("s")[0].alias("prefix"), F.explode(F.expr("slice(s, 2, size(s) - 1)")).alias("e"))
        entry = F.split("e", " ")
        met = met.select("lang", "bucket", "prefix", entry[0].alias("next"), F.coalesce(F.get(entry, F.lit(1)).cast("long"), F.lit(1)).alias("n"))
        merged = met.groupBy("lang", "bucket", "prefix", "next").agg(F.sum("n").alias("f"))
        phrases = merged.where(f"f >= {least}").select("lang", F.lit(k).alias("k"), "prefix", F.concat_ws(" ", "prefix", "next").alias("phrase"), "f")
        levels.append(cut(phrases))
    return reduce(DataFrame.unionByName, levels), n


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, bits: int = BITS, chunk: int = CHUNK, lanes: int = LANES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, all numbers exact.

    Score: the least of floor(1000 * a * n / (l * r)) over the cuts of a phrase in two. A phrase goes if its words stand in
    a longer candidate that is as frequent; as counts only fall with length, looking one word further to either side is
    enough: the largest entry of the phrase's own stripe, and the largest among phrases whose tail it is. Null texts count as
    empty, a null lang as und; ties go to the smallest cut and, between phrases, to byte order; repeated rows count each;
    whole texts are read, however long; an empty table gives an empty table. Only lang and text are read, so other columns may
    have any name. Numbers fit up to 10**13 occurrences of a phrase and 10**16 words; words of one chunk are told apart by 64
    bits (v different ones hold about v * v / 2**65 pairs that are mistaken).
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    phrases, n = phrase_counts(rows, least, words, bits, chunk, lanes)
    longer = phrases.where("k > 2")
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    around = longer.select("lang", F.col("prefix").alias("phrase"), F.col("f").alias("most")).unionByName(longer.select("lang", tail.alias("phrase"), F.col("f").alias("most")))
    around = around.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    free = phrases.where("k > 1").join(around, ["lang", "phrase"], "left").where("most IS NULL OR most < f")
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "k").select(
        "lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("head"), F.array_join(F.expr("slice(w, cut + 1, size(w))"), " ").alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(n, "lang")
    number = lambda c, digits: f"cast({c} AS decimal({digits}, 0))"
    score = F.expr(f"{number('1000', 4)} * {number('a', 13)} * {number('n', 16)} div ({number('l', 13)} * {number('r', 13)})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "n", F.col("b.score").cast("long").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
