"""Work on narrow tables is dealt to all cores, and fixpoints send no tables through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import graph as G
from codestrata.queries.bindings import Bound
from codestrata.queries.facts import function_facts
from codestrata.session import lanes


def _parts(spark, folder, n=400):
    part = spark.range(n).select(
        F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("Brand#1").alias("p_brand"),
        F.lit("PROMO").alias("p_type"), F.lit("red ring").alias("p_name"))
    part.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return Bound(spark, str(folder))


def test_functions_of_one_small_file_are_worked_on_by_all_cores(spark, tmp_path):
    facts = function_facts(_parts(spark, tmp_path)).select("function_id", "risks", F.spark_partition_id().alias("p"))
    rows = facts.collect()
    assert len({r.function_id for r in rows}) == len(rows) == 400
    per_task = {p: sum(r.p == p for r in rows) for p in {r.p for r in rows}}
    assert len(per_task) == lanes(spark) and max(per_task.values()) < 4 * 400 / lanes(spark)


def test_components_are_joined_without_the_driver(spark):
    """Tables of the loops are small on disk and large in memory: broadcast, each would pass through the driver in each round."""
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 3, 4), (0, 4, 4)], "project_id int, src int, dst int")
    for found, want in ((G.cycle_edges(edges).select("src", "dst", "is_cycle"), [(1, 2, True), (2, 1, True), (2, 3, False), (3, 4, False), (4, 4, True)]),
                        (G.topological_depth(edges), [(1, 0), (2, 0), (3, 1), (4, 2)])):
        assert sorted(map(tuple, found.collect())) == want
        assert "BroadcastExchange" not in found._jdf.queryExecution().toString()
