"""Call edges: building, degrees, merging, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every node that has an edge; one shuffle, partially aggregated."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")
    )


def call_sites(functions: DataFrame) -> DataFrame:
    """Distinct called names per function.  The called name is everything that reads ``word(``."""
    names = F.array_distinct(F.regexp_extract_all(F.col("body"), F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1))
    return functions.select(
        F.col("project_id"), F.col("function_id").alias("src"), F.explode(names).alias("callee")
    )


def resolve_calls(functions: DataFrame) -> DataFrame:
    """Calls to functions of the same project, an equi-join on (project, name).

    A definition ``a.b`` is also reachable by its last part.  Self calls are left out.
    """
    aliases = functions.select(
        "project_id", F.col("function_id").alias("dst"),
        F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("callee"),
    )
    found = call_sites(functions).join(aliases, ["project_id", "callee"])
    return found.where("src <> dst").select("project_id", "src", "dst").dropDuplicates(["src", "dst"])


def build_edges(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Call edges with the lower confidence of the two ends."""
    left = functions.select(F.col("function_id").alias("src"), F.col("confidence").alias("_a"))
    right = functions.select(F.col("function_id").alias("dst"), F.col("confidence").alias("_b"))
    return (
        calls.join(left, "src").join(right, "dst")
        .select("project_id", "src", "dst", F.lit("call").alias("kind"), F.least("_a", "_b").alias("confidence"))
    )


def isolated(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that no edge touches."""
    ends = edges.select(F.col("src").alias("function_id")).unionByName(edges.select(F.col("dst").alias("function_id")))
    return functions.join(ends, "function_id", "left_anti")


def terminals(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions without an outgoing edge."""
    return functions.join(edges.select(F.col("src").alias("function_id")), "function_id", "left_anti")


def unresolved_calls(functions: DataFrame) -> DataFrame:
    """Called names that no function of the project carries."""
    names = functions.select("project_id", F.col("name").alias("callee"))
    return call_sites(functions).join(names, ["project_id", "callee"], "left_anti")


def merge_edges(edges: DataFrame, keys: list[str], order: Column | str = "ord", parts: int | None = None) -> DataFrame:
    """Parallel edges folded in input order.

    The fold takes the larger volume and adds 4 per merge, capped at 100 after every step.  Because each step adds the
    same 4, a run of edges folds to a pair (greatest lift, number of edges), and such pairs combine in order. Edges are dealt
    out by range of key and order, in ``parts`` ranges if given, so a hot pair of nodes is many runs; only the pairs of
    runs meet per key.
    """
    by = [F.col(k) for k in keys]
    ordered = edges.withColumn("_o", F.col(order) if isinstance(order, str) else order)
    ranged = ordered.repartitionByRange(parts, *by, "_o") if parts else ordered.repartitionByRange(*by, "_o")
    ranged = cut(ranged.select(*by, "_o", "volume", "primary", "confidence", "relation_count", F.spark_partition_id().alias("_p")))
    run = Window.partitionBy(*keys, "_p")
    rank, n = F.row_number().over(run.orderBy("_o")), F.count(F.lit(1)).over(run)
    lifted = ranged.withColumn("_lift", F.col("volume") + 4 * (n - rank + 1)).withColumn("_head", F.when(rank == 1, 4).otherwise(0))
    runs = lifted.groupBy(*keys, "_p").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_lift").alias("_lift"), F.max(F.col("_lift") - F.col("_head")).alias("_first"), F.max("volume").alias("_volume"),
        F.bool_or("primary").alias("primary"), F.max("confidence").alias("confidence"), F.sum("relation_count").alias("relation_count"))
    # the first edge of all is no merge, so its run lifts it by one step less
    behind = Window.partitionBy(*keys).orderBy(F.desc("_p"))
    after = F.coalesce(F.sum("_n").over(behind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_p")) == 1
    runs = runs.withColumn("_v", F.when(first, F.col("_first")).otherwise(F.col("_lift")) + 4 * after)
    return runs.groupBy(*keys).agg(
        F.bool_or("primary").alias("primary"),
        F.when(F.sum("_n") == 1, F.max("_volume")).otherwise(F.least(F.lit(100), F.max("_v"))).alias("volume"),
        F.max("confidence").alias("confidence"),
        F.sum("relation_count").alias("relation_count"),
    )
