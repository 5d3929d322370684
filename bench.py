"""Benchmark of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from codestrata.operators import pointsto, taint  # noqa: E402
from codestrata.queries import load_all  # noqa: E402
from codestrata.session import local_session  # noqa: E402

HEADLINE = (
    "flow_transitions", "run_stats", "stress_batches", "retention_top_n", "upsert_latest", "text_flags", "rule_matches",
    "rule_summary", "advisory_window_join", "kev_flag", "arg_param_binding", "band_join_fusion", "snapshot_diff",
    "call_resolution", "edge_merge", "entry_tree", "path_enum", "taint_fixpoint", "points_to", "label_matches", "centroids",
    "centroid_scores", "teacher_votes", "grouped_issue_report", "manifest_dependencies", "extract_functions", "project_fingerprint",
)


def chain(spark, n: int = 10_000):
    """The published scale fixture: ``f0 -> f1 -> ... -> f(n-1)``, every function passing its parameter on."""
    ids = spark.range(n).withColumnRenamed("id", "function_id")
    name = F.concat(F.lit("f"), F.col("function_id").cast("string"))
    following = F.concat(F.lit("f"), (F.col("function_id") + 1).cast("string"))
    last = F.col("function_id") == n - 1
    functions = ids.select(
        "function_id", F.lit(0).alias("project_id"), name.alias("name"), F.array(F.lit("value")).alias("params"),
        F.when(last, "return value").otherwise(F.concat(F.lit("result = "), following, F.lit("(value)\nreturn result"))).alias("body"),
        F.when(F.col("function_id") == 0, F.array(F.lit("external-input"))).otherwise(F.array().cast("array<string>")).alias("external_inputs"),
        F.array().cast("array<string>").alias("validations"), F.array().cast("array<string>").alias("side_effects"))
    cfg = functions.select(
        "function_id", F.lit(1).alias("ord"), F.lit("return").alias("kind"), F.array().cast("array<string>").alias("defs"),
        F.array(F.when(last, "value").otherwise("result")).alias("uses"), F.lit("").alias("ownership"), F.lit("").alias("concurrency"))
    edges = ids.where(~last).select(F.lit(0).alias("project_id"), F.col("function_id").alias("src"), (F.col("function_id") + 1).alias("dst"))
    return functions, cfg, edges


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    only = os.environ.get("BENCH_ONLY")
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only.split(","):
            continue
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    if not only or "chain_10k" in only:
        functions, cfg, edges = chain(spark)
        start = time.time()
        facts, stats = taint.taint_fixpoint(functions, cfg, edges)
        tainted = facts.count()
        times["chain_10k_taint"] = round(time.time() - start, 3)
        start = time.time()
        solution = pointsto.points_to(functions, cfg, edges)
        points = solution["pts"].count()
        times["chain_10k_points_to"] = round(time.time() - start, 3)
        print(f"chain: {tainted} tainted variables, {points} points-to facts, converged "
              f"{stats['converged'] and solution['converged']}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
