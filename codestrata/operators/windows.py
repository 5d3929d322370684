"""Ranking and neighbour operators that do not sort a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def next_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column,
                  prefix: str = "next_") -> DataFrame:
    """The following row's values inside each group.

    ``bucket`` must not decrease along ``order``.  Rows are sorted per (group, bucket) only; the last row of a bucket
    takes the head of the next non-empty bucket from a table with one row per bucket.  A group of any size is spread
    over as many tasks as it has buckets.
    """
    marked = df.withColumn("_bucket", bucket)
    parts = [*keys, "_bucket"]
    row = F.struct(*[F.col(v).alias(v) for v in values])
    inner = marked.withColumn("_next", F.lead(row).over(Window.partitionBy(*parts).orderBy(*order)))
    inner = inner.withColumn(
        "_last", F.lead(F.lit(1)).over(Window.partitionBy(*parts).orderBy(*order)).isNull())
    heads = marked.groupBy(*parts).agg(F.min_by(row, F.struct(*order)).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_head")
    joined = inner.join(heads, parts, "left")
    picked = F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))
    out = joined.withColumn("_picked", picked)
    return out.select(*df.columns, *[F.col(f"_picked.{v}").alias(f"{prefix}{v}") for v in values])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_name: str | None = None) -> DataFrame:
    """Newest ``n`` rows per group.  The rank filter is pushed below the shuffle as a per-partition limit."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank_name) if rank_name else kept.drop("_rank")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as a partially aggregated max."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def global_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Zero-based position in a total order without sorting everything in one task.

    Rows are range-partitioned and sorted; each row's place is its place inside the partition plus the size of the
    partitions before it (one small row per partition).
    """
    from ..session import cut

    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order)
                 .withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_p", "_before")
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop(
        "_p", "_i", "_before")


def validation_split(df: DataFrame, order: Sequence[str], every: int = 5) -> DataFrame:
    """Marks every ``every``-th row in a total order as validation data."""
    return global_ordinal(df, order, "_ord").withColumn(
        "is_validation", F.pmod("_ord", F.lit(every)) == 0).drop("_ord")


def occurrence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "version") -> DataFrame:
    """1-based number of a row among the rows of its group (groups are one function's variable, hence small)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Last non-null value so far inside one file."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def max_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], bucket: Column) -> DataFrame:
    """Running maxima over the earlier rows of a group, by name; null before the first value.

    ``bucket`` must not decrease along ``order``. Windows run inside (group, bucket) only, and what earlier buckets hold is
    carried in by a table with one row per bucket, so a group of any size is spread over as many tasks as it has buckets.
    """
    marked = df.withColumns({"_bucket": bucket, **{f"_v_{n}": v for n, v in values.items()}})
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = marked.withColumns({f"_w_{n}": F.max(f"_v_{n}").over(inner) for n in values})
    earlier = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_k__bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = marked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_bucket")]).agg(*[F.max(f"_v_{n}").alias(f"_h_{n}") for n in values])
    carried = heads.select(*[f"_k_{k}" for k in (*keys, "_bucket")], *[F.max(f"_h_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_bucket")]
    joined = within.join(carried, same)
    return joined.select(*df.columns, *[F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in values])
