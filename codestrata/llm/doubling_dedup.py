"""Substring dedup by level-wise doubling: windows repeated at one length alone are looked at at twice that length."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key
from .key_filter import BITS, bit_table, may_hold
from .shingles import mix

#: Words of a window, and of the shortest windows looked at; the first is the second doubled a few times.
LENGTH, BASE = 20, 5
#: Words of the documents that a task works on at a time.
CHUNK = 1 << 20

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Documents in the order of first starts, hashes of all their words one after the other, and words per document."""
    docs: dict[int, tuple] = {}

    def flush():
        listed = sorted(docs.values(), key=lambda d: d[:3])
        words = [d[3] for d in listed]
        return [d[:3] for d in listed], np.concatenate(words), np.array([len(w) for w in words])

    size = 0
    for batch in batches:
        for doc_id, rk, text in zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), batch.column("text"), strict=True):
            if rk in docs:  # a repeated row is the same document
                continue
            listed = text.as_buffer().to_pybytes().split()
            docs[rk] = (doc_id is None, doc_id or 0, rk, np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed)))
            size += len(listed)
            if size >= chunk:
                yield flush()
                docs, size = {}, 0
    if docs:
        yield flush()


def lengths(base: int, length: int) -> list[int]:
    """base, 2 * base, ... length."""
    out = [base]
    while out[-1] < length:
        out.append(2 * out[-1])
    if out[-1] != length:
        raise ValueError("the length must be the base doubled")
    return out


def ladder(words: np.ndarray, base: int, length: int, seed: int = 0) -> list[np.ndarray]:
    """Hashes of the windows of each length at each place; those of one length are made of two of half that length."""
    many = mix(np.arange(1, base + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
    n = max(len(words) - base + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(base):
        h += words[i : i + n] * many[i]
    out = [mix(h)]
    for size in lengths(base, length)[:-1]:
        h = out[-1]
        n = max(len(h) - size, 0)
        out.append(mix(h[:n] * _LEFT + h[size : size + n] * _RIGHT))
    return out


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours, by doubling."""
    span, n = 1, len(a) - width + 1
    while 2 * span <= width:
        a, span = best(a[:-span], a[span:]), 2 * span
    return best(a[:n], a[width - span : width - span + n])


def _candidates(words: np.ndarray, sizes: np.ndarray, base: int, length: int, tables: list[np.ndarray]):
    """Places of windows of the full length that may be repeated, with the hashes of all lengths.

    At each shorter length a window is judged by the one of its parts with the smallest hash: if the window is
    repeated then so is that part, wherever the window stands.
    """
    rungs = ladder(words, base, length)
    n = max(len(words) - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    alive = doc[:n] == doc[length - 1 :]
    for h, size, table in zip(rungs, lengths(base, length), tables, strict=False):
        at = np.flatnonzero(alive)
        alive[at] = may_hold(table, _slide(h, length - size + 1, np.minimum)[at])
    return rungs, doc, alive


def _parts(base: int, length: int, held: list, chunk: int):
    """Keys of the parts that stand for the windows left at the next length: key, seen (1, or 2 for more than one place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size = [t.value for t in held], lengths(base, length)[len(held)]
        for _, words, sizes in _chunks(batches, chunk):
            if len(words) < length:
                continue
            rungs, _, alive = _candidates(words, sizes, base, length, tables)
            h, more = rungs[len(held)], length - size
            low = np.where(alive, _slide(h, more + 1, np.minimum), np.uint64(0))
            edge = np.zeros(more, np.uint64)
            # a part stands for a window around it if the largest of their minima is its own hash
            stands = (_slide(np.concatenate([edge, low, edge]), more + 1, np.maximum) == h) & (h > 0)
            keys, seen = np.unique(h[stands], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(seen, 2))], ["key", "seen"])

    return run


def _windows(base: int, length: int, held: list, chunk: int):
    """Windows left at the full length, one row for the first of each chunk, and one row per document for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in held]
        for docs, words, sizes in _chunks(batches, chunk):
            if len(words) < length:
                continue
            rungs, doc, alive = _candidates(words, sizes, base, length, tables)
            at = np.flatnonzero(alive)
            if not len(at):
                continue
            one, two = rungs[-1][at], ladder(words, base, length, 1)[-1][at] >> np.uint64(32)
            order = np.lexsort((at, two, one))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            first, later = np.sort(order[fresh]), np.sort(order[~fresh])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, rks = np.array([d[1] for d in docs], np.int64), np.array([d[2] for d in docs], np.int64)
            none = np.array([d[0] for d in docs])
            d = doc[at[first]]
            e = doc[at[later]]
            own, cut = np.unique(e, return_index=True)
            m, k = len(first), len(own)
            places = pa.array(np.concatenate([at[first] - starts[d], np.full(k, -1)]), pa.int32(), mask=np.arange(m + k) >= m)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(m, np.int64), cut, [len(later)]]), pa.int32()), pa.array(at[later] - starts[e], pa.int32()))
            both = np.concatenate([d, own])
            arrays = [
                pa.array(np.arange(m + k) >= m),
                pa.array(np.concatenate([one[first].view(np.int64), rks[own]])),
                pa.array(np.concatenate([two[first].astype(np.int64), np.full(k, -1)])),
                pa.array(ids[both], pa.int64(), mask=none[both]),
                pa.array(rks[both]),
                places,
                lists,
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["known", "h1", "h2", "doc_id", "rk", "pos", "again"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, base: int = BASE, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Starts of the windows that also start earlier: rk (content key of the document), starts (array of word places).

    ``docs`` has doc_id (long), rk and text (never null). Earlier means a smaller doc_id (null last), then a smaller rk,
    then an earlier place in the document. The shorter lengths only rule windows out, by a bit table of fixed size.
    """
    held, spark = [], docs.sparkSession
    for _ in lengths(base, length)[:-1]:
        parts = docs.mapInArrow(_parts(base, length, held, chunk), "key long, seen long")
        repeated = parts.groupBy("key").agg(F.sum("seen").alias("seen")).where("seen > 1")
        table, survivors = bit_table(repeated, bits)
        if not survivors:  # no window of this length is repeated, so no longer one is
            return spark.createDataFrame([], "rk long, starts array<int>")
        held.append(table)
    found = docs.mapInArrow(_windows(base, length, held, chunk), "known boolean, h1 long, h2 long, doc_id long, rk long, pos int, again array<int>")
    # a window has at most one row per chunk, and a rank needs no more than the row before
    order = Window.partitionBy("known", "h1", "h2").orderBy(F.col("doc_id").isNull(), "doc_id", "rk")
    later = found.withColumn("_nth", F.rank().over(order)).where("known OR _nth > 1")
    return later.groupBy("rk").agg(F.flatten(F.collect_list(F.when(F.col("known"), F.col("again")).otherwise(F.array("pos")))).alias("starts"))


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n, gone, kept = [], [], []
                for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                    words = text.as_buffer().to_pybytes().split()
                    n.append(len(words))
                    if starts.is_valid and len(starts):
                        at = starts.values.to_numpy()
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + length, -1)
                        stays = np.cumsum(edges[:-1]) == 0
                        words = list(itertools.compress(words, stays.tolist()))
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def strip_repeats(docs: DataFrame, length: int = LENGTH, base: int = BASE, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of ``length`` words covers it whose words also start earlier, in a document of smaller doc_id or
    earlier in the same one. Texts of fewer words lose nothing; a null text has no words; null ids come last; documents of
    one id are ordered by content key, and rows alike in doc_id and text are one document, so each of them keeps the same.
    Whole texts are read, however long; an empty table gives an empty table. Only doc_id and text are read, so other
    columns may have any name. Two windows count as the same by 96 bits of their hashes, whose words count as the same by
    64: n different windows hold about n * n / 2**97 pairs that are mistaken, v different words v * v / 2**65; documents
    are told apart by 64 bits.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("rk"))
    gone = repeated_windows(rows, length, base, bits, chunk)
    stripped = rows.join(gone, "rk", "left").mapInArrow(_strip(length), "doc_id long, n_words long, n_removed long, kept string")
    return stripped.withColumn("doc_id", F.col("doc_id").cast(kind))
