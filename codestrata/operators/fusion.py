"""Fusing parser facts with compiler facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import first_per


def better_type(current: Column, incoming: Column) -> Column:
    missing = incoming.isNull() | incoming.isin("", "unknown")
    weak = current.isNull() | current.isin("", "unknown", "inferred")
    return F.when(missing, current).when(weak, incoming).when(F.length(current) <= F.length(incoming), current).otherwise(incoming)


def match_facts(functions: DataFrame, facts: DataFrame, tolerance: int = 3) -> DataFrame:
    """Per compiler fact the first base function of the same file and (short) name within ``tolerance`` lines.

    The join is an equi-join on (file, name); the line distance is a residual test.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    base = functions.select(
        F.col("function_id").alias("base_id"), "path", F.col("start_line").alias("_line"), F.explode(F.array_distinct(
            F.array("name", last(F.col("name"))))).alias("_name"))
    keyed = facts.select("fact_id", "path", F.col("start_line").alias("_fact_line"), F.explode(F.array_distinct(
        F.array("name", F.coalesce("short_name", "name")))).alias("_name"))
    pairs = keyed.join(base, ["path", "_name"]).where(F.abs(F.col("_line") - F.col("_fact_line")) <= tolerance)
    return first_per(pairs.select("fact_id", "base_id", "_line"), ["fact_id"], ["_line", "base_id"]).select("fact_id", "base_id")


def fuse_functions(functions: DataFrame, facts: DataFrame, tolerance: int = 3) -> DataFrame:
    """Base functions upgraded by their facts, plus the facts that match nothing (a full outer result)."""
    matched = match_facts(functions, facts, tolerance)
    detail = facts.select("fact_id", F.col("params").alias("_p"), F.col("return_type").alias("_r"), F.col("confidence").alias("_c"))
    upgrades = first_per(matched.join(detail, "fact_id"), ["base_id"], ["fact_id"])
    joined = functions.join(upgrades.withColumnRenamed("base_id", "function_id"), "function_id", "left")
    hit = F.col("fact_id").isNotNull()
    base = joined.select(
        F.col("function_id").cast("string").alias("function_id"), "path", "name", "start_line",
        F.when(hit & (F.size("_p") > 0), F.col("_p")).otherwise(F.col("params")).alias("params"),
        F.when(hit, better_type(F.col("return_type"), F.col("_r"))).otherwise(F.col("return_type")).alias("return_type"),
        F.when(hit, F.least(F.lit(98), F.greatest("confidence", F.coalesce("_c", F.lit(90))))).otherwise(F.col("confidence"))
        .cast("long").alias("confidence"), F.when(hit, "merged").otherwise("base").alias("origin"))
    added = facts.join(matched, "fact_id", "left_anti").select(
        F.concat(F.lit("compiler:"), F.col("fact_id").cast("string")).alias("function_id"), "path", "name", "start_line", "params",
        F.coalesce("return_type", F.lit("unknown")).alias("return_type"),
        F.coalesce("confidence", F.lit(90)).cast("long").alias("confidence"), F.lit("added").alias("origin"))
    return base.unionByName(added)


def fuse_edges(edges: DataFrame, fact_edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Compiler edges with fused ids that are new and no self calls."""
    ids = matched.select("fact_id", F.col("base_id").cast("string").alias("_id"))
    remap = fact_edges.join(ids.withColumnRenamed("fact_id", "src").withColumnRenamed("_id", "_s"), "src", "left").join(
        ids.withColumnRenamed("fact_id", "dst").withColumnRenamed("_id", "_d"), "dst", "left")
    named = remap.select(
        F.coalesce("_s", F.concat(F.lit("compiler:"), F.col("src").cast("string"))).alias("src"),
        F.coalesce("_d", F.concat(F.lit("compiler:"), F.col("dst").cast("string"))).alias("dst"),
        F.coalesce("confidence", F.lit(92)).alias("confidence"))
    known = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return named.where("src <> dst").join(known, ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
