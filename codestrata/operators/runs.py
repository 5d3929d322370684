"""Statistics over runtime runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import round_half_up
from .windows import latest_per, next_in_order, top_n

UNUSABLE = ("unavailable", "rejected")
BATCH_PATTERN = r"^(stress-bounded-16x-\d+)-\d{2}$"


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles, element ``ceil(n * ratio)`` of the sorted values.

    Works on a histogram: values collapse to counts map-side, a logarithmic bucket narrows the search to one slice of
    each group, and only that slice is ordered.  No group is ever sorted or collected as a whole.
    """
    v = F.col(value).cast("double")
    bucket = (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)).cast("long")
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.withColumn("_b", bucket)
    coarse = hist.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    steps = coarse.select(*keys, "_b", "_n", F.sum("_n").over(w).alias("_cum"), total.alias("_total"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(r))).alias("rank"))
        for name, r in ratios.items()
    ])).alias("_q")
    hit = steps.select(*keys, "_b", "_n", "_cum", wanted).where(
        (F.col("_cum") >= F.col("_q.rank")) & (F.col("_cum") - F.col("_n") < F.col("_q.rank"))
    ).select(*keys, "_b", F.col("_q.name").alias("_name"), (F.col("_q.rank") - F.col("_cum") + F.col("_n")).alias("_need"))
    inside = hist.join(hit, [*keys, "_b"]).withColumn(
        "_run", F.sum("_n").over(
            Window.partitionBy(*keys, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.where(F.col("_run") >= F.col("_need"))
    return found.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ratios
    ])


def run_statistics(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, failure rate, percentiles and resource totals per group."""
    base = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("status") == "passed").alias("passed_count"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.sum("cpu_time_ms").alias("total_cpu_ms"),
        F.max("peak_memory_bytes").alias("peak_memory_bytes"),
    )
    base = base.withColumn("failure_rate", failure_rate(F.col("sample_count"), F.col("passed_count")))
    ranks = nearest_rank(runs, keys, "duration_ms", {"p50_duration_ms": 0.5, "p95_duration_ms": 0.95})
    return base.join(ranks, list(keys), "left")


def failure_rate(total: Column, passed: Column) -> Column:
    return round_half_up((total - passed) / F.greatest(F.lit(1), total) * 100)


def latest_run_per_kind(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest usable run of each experiment kind."""
    return latest_per(runs.where(~F.col("status").isin(*UNUSABLE)), [*keys, "experiment_kind"], ["started_at", "run_id"])


def stress_batches(runs: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Stress runs grouped by batch name, with the training gate."""
    batch = F.regexp_extract("sample_id", BATCH_PATTERN, 1)
    stress = runs.where((F.col("experiment_kind") == "stress") & (batch != "")).withColumn("batch", batch)
    groups = [*keys, "batch"]
    out = stress.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("status") == "passed").alias("passed_count"),
        F.max("peak_memory_bytes").alias("peak_memory_bytes"),
        F.bool_and(F.col("sandbox_kind") != "none").alias("strongly_isolated"),
    )
    out = out.withColumn("failure_rate", failure_rate(F.col("run_count"), F.col("passed_count")))
    out = out.withColumn(
        "eligible", (F.col("run_count") >= 16) & (F.col("failure_rate") <= 5) & F.col("strongly_isolated"))
    return out.join(nearest_rank(stress, groups, "duration_ms", {"p95_duration_ms": 0.95}), groups, "left")


def latest_stress_batch(runs: DataFrame, key: str = "project_id", size: int = 16) -> DataFrame:
    """Newest ``size`` runs of the batch that holds the newest usable stress run of a project."""
    usable = runs.where((F.col("experiment_kind") == "stress") & ~F.col("status").isin(*UNUSABLE))
    usable = usable.withColumn("_batch", F.regexp_extract("sample_id", BATCH_PATTERN, 1))
    newest = usable.groupBy(key).agg(
        F.max_by(F.struct("_batch", "run_id"), F.struct("started_at", "run_id")).alias("_newest"))
    newest = newest.select(
        key, F.col("_newest._batch").alias("_want"), F.col("_newest.run_id").alias("_only"))
    # a newest run outside any batch stands alone
    members = usable.join(newest, key).where(
        F.when(F.col("_want") == "", F.col("run_id") == F.col("_only")).otherwise(F.col("_batch") == F.col("_want")))
    return top_n(
        members.drop("_batch", "_want", "_only"), [key], [F.desc("started_at"), F.desc("run_id")], size)


def transitions(events: DataFrame, run: str, order: Sequence[str], name: str, bucket: Column) -> DataFrame:
    """Consecutive function pairs inside every run."""
    pairs = next_in_order(events, [run], order, [name], bucket)
    return pairs.where(F.col(f"next_{name}").isNotNull()).select(
        run, F.col(name).alias("from_name"), F.col(f"next_{name}").alias("to_name"))


def transition_counts(pairs: DataFrame, run: str) -> DataFrame:
    """How often and in how many runs an edge was observed; runs are counted after a pre-aggregation."""
    per_run = pairs.groupBy("from_name", "to_name", run).agg(F.count(F.lit(1)).alias("_n"))
    return per_run.groupBy("from_name", "to_name").agg(
        F.sum("_n").alias("observations"), F.count(F.lit(1)).alias("run_count"))


def observe_edges(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Static edges with their runtime observation; names are columns ``from_name`` and ``to_name``."""
    joined = edges.join(observed, ["from_name", "to_name"], "left")
    return joined.withColumn("observed", F.col("observations").isNotNull()).fillna(0, ["observations", "run_count"])


def supervision_eligible(kind: Column, status: Column, isolated: Column, trace_count: Column) -> Column:
    """S03 gate: an isolated, passed baseline with a trace may supervise learning."""
    return (F.coalesce(kind, F.lit("baseline")) == "baseline") & (status == "passed") & isolated & (trace_count > 0)


def assertion_verdict(expected: Column, canary: Column, stdout: Column, stderr: Column, status: Column,
                      finding: Column, timed_out: Column, truncated: Column) -> Column:
    """Verdict of one attack sample from the text of its run."""
    text = F.lower(F.concat_ws("\n", stdout, stderr))
    denial = text.rlike(
        r"\b(unauthorized|forbidden|denied|permission denied|access denied|invalid token|expired token|401|403)\b")
    refusal = text.rlike(
        r"\b(invalid input|validation failed|rejected|blocked|sanitized|bad request|unprocessable|400|422)\b")
    leak = F.contains(text, F.lower(canary))
    bounded = ~timed_out & ~truncated & (status != "failed")
    return (
        F.when(status.isin("rejected", "unavailable"), "harness-blocked")
        .when(finding | leak, "failed")
        .when(expected == "explicit-denial", F.when(denial, "passed").otherwise("inconclusive"))
        .when(expected == "bounded-rejection", F.when(bounded, "passed").otherwise("failed"))
        .when(refusal, "passed")
        .otherwise("inconclusive")
    )


def assertion_maturity(results: DataFrame, case_count: int, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage, conclusive rate and replay history; ``frameworks`` is an array column.

    Distinct counts run over pre-aggregated keys, so a hot project or case collapses before the shuffle.
    """
    whole = not keys
    if whole:
        results, keys = results.withColumn("_all", F.lit(0)), ["_all"]
    keys = list(keys)
    per_case = results.groupBy(*keys, "case_id").agg(F.count(F.lit(1)).alias("_n"))
    cases = _agg(per_case, keys, F.count(F.lit(1)).alias("case_hits"), F.min("_n").alias("min_case_replays"))
    projects = _agg(results.groupBy(*keys, "project_id").agg(F.lit(1).alias("_1")), keys, F.count(F.lit(1)).alias("projects"))
    names = results.select(*keys, F.explode("frameworks").alias("_f")).where("_f <> 'all' AND _f <> ''").distinct()
    frameworks = _agg(names, keys, F.count(F.lit(1)).alias("frameworks"))
    totals = _agg(
        results, keys, F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.floor((F.max("created_at") - F.min("created_at")) / F.lit(86400000)).alias("span_days"),
        F.bool_and("isolated").alias("all_isolated"))
    out = totals
    for part in (cases, projects, frameworks):
        out = out.join(part, keys, "left")
    out = out.fillna(0, ["frameworks"])
    coverage = round_half_up(F.col("case_hits") / F.lit(case_count) * 100)
    conclusive = round_half_up((F.col("passed") + F.col("failed")) / F.greatest(F.lit(1), F.col("results")) * 100)
    out = out.withColumn("coverage", coverage).withColumn("conclusive_rate", conclusive)
    eligible = (F.col("coverage") == 100) & (F.col("conclusive_rate") == 100) & F.col("all_isolated")
    mature = (F.col("projects") >= 20) & (F.col("frameworks") >= 5) & (F.col("span_days") >= 30) & (
        F.col("min_case_replays") >= 3)
    out = out.withColumn("eligible", eligible).withColumn(
        "maturity", F.when(eligible & mature, "mature-validation-candidate").when(coverage == 100, "replay-covered")
        .otherwise("seed"))
    return out.drop("_all") if whole else out


def _agg(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)
