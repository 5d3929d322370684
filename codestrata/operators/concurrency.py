"""Pairwise conflicts of concurrent statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LAUNCH = r"spawn|thread|promise\.all|asyncio\.gather|async|await|go\b"


def launches(cfg: DataFrame) -> DataFrame:
    """Statements that start work, of functions that start at least two."""
    found = cfg.where(F.col("concurrency").rlike(LAUNCH))
    several = found.groupBy("function_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return found.join(several.select("function_id"), "function_id", "left_semi")


def race_pairs(events: DataFrame) -> DataFrame:
    """Pairs of launches that touch one variable, one of them writing, without a common lock or two atomics.

    ``events``: ``function_id, ord, reads, writes, locks`` (arrays), ``atomic`` (boolean).  Pairs come from an equi-join
    on (function, variable) between writers and all users, never from all launches of a function.
    """
    writes = events.select(
        "function_id", F.col("ord").alias("w_ord"), "locks", "atomic", F.explode(F.array_distinct("writes")).alias("variable"))
    uses = events.select(
        "function_id", F.col("ord").alias("u_ord"), F.col("locks").alias("u_locks"), F.col("atomic").alias("u_atomic"),
        F.explode(F.array_union("writes", "reads")).alias("variable"))
    joined = writes.join(uses, ["function_id", "variable"]).where(
        (F.col("w_ord") != F.col("u_ord")) & ~F.arrays_overlap("locks", "u_locks") & ~(F.col("atomic") & F.col("u_atomic")))
    return joined.select(
        "function_id", F.least("w_ord", "u_ord").alias("first"), F.greatest("w_ord", "u_ord").alias("second"),
        "variable").distinct()


def sync_edges(events: DataFrame) -> DataFrame:
    """C20: orderings between launches: by a shared lock, or because both are atomic."""
    held = events.select("function_id", "ord", F.explode(F.array_union(
        "locks", F.when(F.col("atomic"), F.array(F.lit("atomic"))).otherwise(F.array().cast("array<string>")))).alias("primitive"))
    right = held.withColumnRenamed("ord", "second")
    return held.withColumnRenamed("ord", "first").join(right, ["function_id", "primitive"]).where("first < second").select(
        "function_id", "first", "second", "primitive")
