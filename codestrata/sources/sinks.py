"""Writing results: snapshots, keyed upserts, retention, the code index."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.windows import latest_per

MAX_ROWS, MAX_BYTES, MAX_ROW_BYTES = 320, 4 * 1024 * 1024, 128 * 1024


def merge_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both tables, the newer one per key; incoming rows win ties."""
    both = current.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return latest_per(both, list(keys), [*order, "_in"]).drop("_in")


def append_rows(rows: DataFrame, path: str, keys: Sequence[str], batch: str, buckets: int = 64) -> None:
    """Adds the rows of one delivery to an append-only parquet table, spread over key buckets.

    A delivery owns its ``_batch`` partitions.  Written again after a failure it replaces them and nothing else, so a
    repeated delivery leaves the table as it was and a half-written one becomes whole.  No other file is touched.
    """
    placed = rows.withColumn("_batch", F.lit(batch)).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    placed.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "_batch", "_bucket").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType, without: str | None = None) -> DataFrame:
    """Rows of an append-only table; of none if nothing has been written yet.  ``without`` leaves out one delivery."""
    plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = T.StructType([*plain.fields, T.StructField("_batch", T.StringType()), T.StructField("_bucket", T.IntegerType())])
    try:
        rows = spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], stored)
    kept = rows if without is None else rows.where(F.col("_batch") != without)
    return kept.drop("_batch", "_bucket")


def upsert_table(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], batch: str) -> None:
    """Keyed upsert; the newest row per key of a delivery is appended and :func:`read_latest` settles the rest."""
    append_rows(latest_per(incoming, list(keys), list(order)), path, keys, batch)


def read_latest(spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], order: Sequence[str],
                without: str | None = None) -> DataFrame:
    """The newest row per key, by one aggregation over the deliveries."""
    return latest_per(read_rows(spark, path, schema, without), list(keys), list(order))


def replace_snapshot(df: DataFrame, path: str) -> None:
    """A15."""
    df.write.mode("overwrite").parquet(path)


def retain_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, max_rows: int = MAX_ROWS,
                  max_bytes: int = MAX_BYTES, max_row_bytes: int = MAX_ROW_BYTES, used: int = 2) -> DataFrame:
    """Newest rows within a byte budget; a row that does not fit is skipped and the walk goes on.

    The budget only shrinks, so among rows of equal size the kept ones are the newest: at most ``max_rows`` and
    ``max_bytes / size`` of each size can ever be kept.  That bound is applied first, as a distributed top-n per
    (group, size); only the bounded remainder of a group is walked in order.
    """
    keys = list(keys)
    newest = [F.desc(c) for c in order]
    fits = rows.where(F.col(size) <= max_row_bytes)
    rank = F.row_number().over(Window.partitionBy(*keys, size).orderBy(*newest))
    bounded = fits.withColumn("_r", rank).where((F.col("_r") <= max_rows) & (F.col("_r") * F.col(size) <= max_bytes)).drop("_r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), ascending=False, kind="stable")
        kept, total = [], used
        for i, n in enumerate(pdf[size].tolist()):
            if len(kept) == max_rows:
                break
            if total + n <= max_bytes:
                kept.append(i)
                total += n
        return pdf.iloc[kept]

    return bounded.groupBy(*keys).applyInPandas(walk, rows.schema)


def retain_prefix(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A17, approximation: the newest rows whose running size stays within the budget (stops at the first misfit)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= max_bytes).drop("_sum")


def write_index(tables: dict[str, DataFrame], path: str, partition: str = "run_id") -> None:
    """One parquet table per relation, partitioned by run.

    Rows are distributed by run and a salt, so one large run is written by many tasks.
    """
    for name, df in tables.items():
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
        salted.repartition(partition, "_salt").drop("_salt").write.mode("overwrite").partitionBy(partition).parquet(f"{path}/{name}")


def symbol_rows(functions: DataFrame) -> DataFrame:
    """One row per parameter, output, input, validation, effect and risk of a function."""
    kinds = {
        "parameter": "params", "output": "outputs", "external_input": "external_inputs", "validation": "validations",
        "side_effect": "side_effects", "risk": "risks",
    }
    def tag(kind: str, column: str):
        return F.transform(F.col(column), lambda v, i: F.struct(
            F.lit(kind).alias("kind"), v.alias("name"), i.cast("long").alias("position")))

    tagged = F.concat(*[tag(kind, column) for kind, column in kinds.items()])
    return functions.select("project_id", "function_id", F.inline(tagged))


def symbol_count(functions: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    total = sum((F.size(c) for c in ("params", "outputs", "external_inputs", "validations", "side_effects", "risks")), F.lit(0))
    return functions.groupBy(*keys).agg(F.sum(total).alias("symbol_count"))
