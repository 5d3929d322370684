"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Segments per resolution, coarse to fine; vectors are split as evenly as their length allows.
LEVELS = (1, 4, 16)
#: Vectors per block of queries and of candidates.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and integer components floor(256 * x) of vectors without null or non-finite components."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(x.isNotNull() & fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(256 * v)).cast("array<long>").alias("x")
    )


def _pack(size: int):
    """Blocks of at most ``size`` vectors of one length: ids and values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def flush(dim):
            ids, rows = held.pop(dim)
            values = np.array(rows, np.int64).reshape(len(ids), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dim", "ids", "values"]
            )

        for batch in batches:
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("x"), strict=True):
                v = x.values.to_numpy()
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return run


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, and the segments' lengths."""
    edges = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    lengths = np.diff(edges).astype(float)
    if not len(lengths):
        return np.zeros((len(x), 0)), np.zeros((len(x), 0)), lengths
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)), lengths


def lower_bounds(q: tuple, c: tuple) -> np.ndarray:
    """Squared distance of any two rows at least: per segment, length * (difference of means ** 2 + of deviations ** 2)."""
    (qm, qs, lengths), (cm, cs, _) = q, c
    w = np.sqrt(lengths)
    a, b = np.hstack([qm * w, qs * w]), np.hstack([cm * w, cs * w])
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best ``k`` of one block: query ids, row ids, exact scores.

    A distance bound is a score bound, as 2 * score = |q|^2 + |c|^2 - distance^2. The exact scores of the rows that look
    best at the coarsest resolution give each query a threshold; a row that falls short of it at any resolution is
    out, and ties with it stay. What survives the finest resolution is computed exactly in integers.
    """
    qf, cf = q.astype(float), c.astype(float)
    norms = (qf * qf).sum(1)[:, None] + (cf * cf).sum(1)[None, :]
    own = q_ids[:, None] == c_ids[None, :]
    slack = 1e-9 * norms + 1e-6
    threshold, alive = None, ~own
    for segments in LEVELS:
        best = (norms - lower_bounds(segment_statistics(qf, segments), segment_statistics(cf, segments))) / 2 + slack
        if threshold is None:
            tried = np.argpartition(np.where(own, -np.inf, best), -min(4 * k, len(c)), axis=1)[:, -min(4 * k, len(c)) :]
            scores = np.einsum("qd,qtd->qt", q, c[tried])
            scores = np.sort(np.where(np.take_along_axis(own, tried, 1), np.iinfo(np.int64).min, scores), axis=1)
            threshold = scores[:, -k] if scores.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
        alive &= best >= threshold[:, None]
    rows, columns = np.nonzero(alive)
    scores = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 18):  # survivors in slices: no copy of all pairs
        scores[i : i + (1 << 18)] = np.einsum("pd,pd->p", q[rows[i : i + (1 << 18)]], c[columns[i : i + (1 << 18)]])
    order = np.lexsort((c_ids[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return q_ids[rows[keep]], c_ids[columns[keep]], scores[keep]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_values"], np.int64).reshape(len(q_ids), r["dim"])
                c = np.frombuffer(r["values"], np.int64).reshape(len(c_ids), r["dim"])
                out = block_top(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_by_segments(rows: DataFrame, every: int = 50, k: int = 5, vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, against all other rows of the same length. Both are packed
    into blocks; a block of queries meets every block of rows once, under an equi-join on the number of the query
    block, and keeps its best rows, so what leaves the blocks is small. Rows with the query's own vec_id are its own.
    Null vectors, null or non-finite components and null ids take no part; a repeated row is one more candidate of equal
    rank order; an empty table gives an empty result.
    """
    schema = "dim long, ids binary, values binary"
    vectors = usable(rows, vector)
    blocks = cut(vectors.mapInArrow(_pack(ROW_BLOCK), schema))
    queries = cut(
        vectors.where(F.col("vec_id") % every == 0)
        .dropDuplicates(["vec_id", "x"])
        .mapInArrow(_pack(QUERY_BLOCK), schema)
        .withColumn("block", F.monotonically_increasing_id())
    )
    # numbers of the query blocks by length of their vectors: one per thousand queries
    numbers = queries.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    dealt = blocks.join(numbers, "dim").select("dim", "ids", "values", F.explode("blocks").alias("block"))
    asked = queries.select("block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    best = dealt.join(asked, "block").select("dim", "ids", "values", "q_ids", "q_values").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
