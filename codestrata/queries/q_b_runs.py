"""Runs, traces, windows and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.windows import global_ordinal, latest_per, next_in_order, top_n, validation_split
from .registry import query


def day(ts):
    return F.to_date(ts)


def event_pairs(b):
    return R.transitions(b.events, "user_id", ["ts", "event_id"], "event_type", day(F.col("ts")))


_PAIRS = """(SELECT user_id, event_type AS from_name,
    lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_name FROM events)"""


@query("flow_transitions", f"""
    SELECT from_name, to_name, CAST(count(*) AS BIGINT) AS observations,
           CAST(count(DISTINCT user_id) AS BIGINT) AS run_count FROM {_PAIRS}
    WHERE to_name IS NOT NULL GROUP BY from_name, to_name""")
def flow_transitions(b):
    return R.transition_counts(event_pairs(b), "user_id")


@query("observed_edges", f"""
    WITH seen AS (SELECT from_name, to_name, count(*) AS n, count(DISTINCT user_id) AS r FROM {_PAIRS}
                  WHERE to_name IS NOT NULL GROUP BY 1, 2),
         static AS (SELECT DISTINCT event_type AS from_name, CASE event_type WHEN 'view' THEN 'click'
                        WHEN 'click' THEN 'purchase' WHEN 'signup' THEN 'missing' ELSE 'view' END AS to_name FROM events)
    SELECT static.from_name, static.to_name, seen.n IS NOT NULL AS observed,
           CAST(coalesce(n, 0) AS BIGINT) AS observations, CAST(coalesce(r, 0) AS BIGINT) AS run_count
    FROM static LEFT JOIN seen ON static.from_name = seen.from_name AND static.to_name = seen.to_name""")
def observed_edges(b):
    static = b.events.select(F.col("event_type").alias("from_name")).distinct().withColumn(
        "to_name", F.when(F.col("from_name") == "view", "click").when(F.col("from_name") == "click", "purchase")
        .when(F.col("from_name") == "signup", "missing").otherwise("view"))
    return R.observe_edges(static, R.transition_counts(event_pairs(b), "user_id"))


@query("next_event", """
    SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id,
           lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events""")
def next_event(b):
    out = next_in_order(b.events, ["user_id"], ["ts", "event_id"], ["event_id", "value"], day(F.col("ts")))
    return out.select("event_id", "next_event_id", "next_value")


_RANK = "list_sort(list(duration_ms))[CAST(greatest(1, ceil(count(*) * {p})) AS BIGINT)]"


@query("run_stats", f"""
    SELECT project_id, CAST(count(*) AS BIGINT) AS sample_count,
           CAST(count(*) FILTER (WHERE status = 'passed') AS BIGINT) AS passed_count,
           max(duration_ms) AS max_duration_ms, CAST(sum(cpu_time_ms) AS BIGINT) AS total_cpu_ms,
           max(peak_memory_bytes) AS peak_memory_bytes,
           CAST(floor((count(*) - count(*) FILTER (WHERE status = 'passed')) / count(*) * 100 + 0.5) AS BIGINT) AS failure_rate,
           {_RANK.format(p=0.5)} AS p50_duration_ms, {_RANK.format(p=0.95)} AS p95_duration_ms
    FROM runs GROUP BY project_id""")
def run_stats(b):
    return R.run_statistics(b.runs, ["project_id"])


@query("latest_per_kind", """
    SELECT project_id, experiment_kind, run_id, status FROM runs WHERE status NOT IN ('unavailable', 'rejected')
    QUALIFY row_number() OVER (PARTITION BY project_id, experiment_kind ORDER BY started_at DESC, run_id DESC) = 1""")
def latest_per_kind(b):
    return R.latest_run_per_kind(b.runs, ["project_id"]).select("project_id", "experiment_kind", "run_id", "status")


@query("stress_batches", f"""
    SELECT project_id, batch, CAST(count(*) AS BIGINT) AS run_count,
           CAST(count(*) FILTER (WHERE status = 'passed') AS BIGINT) AS passed_count,
           max(peak_memory_bytes) AS peak_memory_bytes, bool_and(sandbox_kind <> 'none') AS strongly_isolated,
           CAST(floor((count(*) - count(*) FILTER (WHERE status = 'passed')) / count(*) * 100 + 0.5) AS BIGINT) AS failure_rate,
           count(*) >= 16 AND floor((count(*) - count(*) FILTER (WHERE status = 'passed')) / count(*) * 100 + 0.5) <= 5
               AND bool_and(sandbox_kind <> 'none') AS eligible,
           {_RANK.format(p=0.95)} AS p95_duration_ms
    FROM (SELECT *, regexp_extract(sample_id, '^(stress-bounded-16x-\\d+)-\\d{{2}}$', 1) AS batch FROM runs
          WHERE experiment_kind = 'stress') WHERE batch <> '' GROUP BY project_id, batch""")
def stress_batches(b):
    return R.stress_batches(b.runs)


@query("latest_stress_batch", """
    WITH u AS (SELECT *, regexp_extract(sample_id, '^(stress-bounded-16x-\\d+)-\\d{2}$', 1) AS batch FROM runs
               WHERE experiment_kind = 'stress' AND status NOT IN ('unavailable', 'rejected')),
         l AS (SELECT project_id, batch FROM u
               QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) = 1)
    SELECT u.project_id, u.run_id, u.duration_ms FROM u JOIN l ON u.project_id = l.project_id AND u.batch = l.batch
    QUALIFY row_number() OVER (PARTITION BY u.project_id ORDER BY u.started_at DESC, u.run_id DESC) <= 16""")
def latest_stress_batch(b):
    return R.latest_stress_batch(b.runs).select("project_id", "run_id", "duration_ms")


@query("retention_top_n", """
    SELECT event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 80""")
def retention_top_n(b):
    return top_n(b.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 80).select("event_type", "event_id")


@query("upsert_latest", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def upsert_latest(b):
    return latest_per(b.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("global_ordinal", """
    SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS ordinal FROM orders""")
def ordinal(b):
    return global_ordinal(b.orders, ["o_totalprice", "o_orderkey"]).select(
        "o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("validation_split", """
    SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) % 5 = 0 AS is_validation FROM embeddings""")
def split(b):
    return validation_split(b.embeddings, ["vec_id"]).select("vec_id", "label", "is_validation")


@query("supervision_gate", """
    SELECT run_id, experiment_kind = 'baseline' AND status = 'passed' AND sandbox_kind <> 'none'
           AND duration_ms % 7 > 0 AS eligible FROM runs""")
def supervision_gate(b):
    return b.runs.select("run_id", R.supervision_eligible(
        F.col("experiment_kind"), F.col("status"), F.col("sandbox_kind") != "none", F.col("duration_ms") % 7
    ).alias("eligible"))


@query("assertion_verdicts", """
    SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN 'harness-blocked'
             WHEN conv_id % 13 = 0 OR contains(lower(text), 'canary') THEN 'failed'
             WHEN conv_id % 3 = 0 THEN CASE WHEN regexp_matches(lower(text), '\\b(unauthorized|forbidden|denied|permission denied|access denied|invalid token|expired token|401|403)\\b') THEN 'passed' ELSE 'inconclusive' END
             WHEN conv_id % 3 = 1 THEN CASE WHEN length(text) < 900 THEN 'passed' ELSE 'failed' END
             WHEN regexp_matches(lower(text), '\\b(invalid input|validation failed|rejected|blocked|sanitized|bad request|unprocessable|400|422)\\b') THEN 'passed'
             ELSE 'inconclusive' END AS verdict
    FROM (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN chr(10) || 'Forbidden 403' WHEN 1 THEN chr(10) || 'blocked' ELSE '' END
                 || CASE WHEN conv_id % 17 = 0 THEN ' CANARY' ELSE '' END AS text FROM conversations)""")
def assertion_verdicts(b):
    tail = F.when(F.col("turn") % 4 == 0, "\nForbidden 403").when(F.col("turn") % 4 == 1, "\nblocked").otherwise("")
    leak = F.when(F.col("conv_id") % 17 == 0, " CANARY").otherwise("")
    c = b.conversations.withColumn("out", F.concat("text", tail, leak))
    kind = F.when(F.col("conv_id") % 3 == 0, "explicit-denial").when(
        F.col("conv_id") % 3 == 1, "bounded-rejection").otherwise("input-rejection")
    return c.select("conv_id", "turn", R.assertion_verdict(
        kind, F.lit("Canary"), F.col("out"), F.lit(""), F.when(F.col("turn") % 7 == 5, "rejected").otherwise("passed"),
        F.col("conv_id") % 13 == 0, F.length("out") >= 900, F.lit(False)).alias("verdict"))


_ASSERT = """(SELECT user_id AS project_id, 'case-' || CAST(event_id % 16 AS VARCHAR) AS case_id,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status, epoch_ms(ts) AS created_at,
    CASE event_id % 6 WHEN 0 THEN 'FastAPI' WHEN 1 THEN 'Django' WHEN 2 THEN 'Express' WHEN 3 THEN 'Spring'
         WHEN 4 THEN 'all' ELSE 'Rails' END AS framework FROM events)"""


@query("assertion_maturity", f"""
    SELECT CAST(count(*) AS BIGINT) AS results, CAST(count(*) FILTER (WHERE status = 'passed') AS BIGINT) AS passed,
           CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed,
           CAST(floor((max(created_at) - min(created_at)) / 86400000) AS BIGINT) AS span_days, true AS all_isolated,
           CAST(count(DISTINCT case_id) AS BIGINT) AS case_hits,
           (SELECT CAST(min(n) AS BIGINT) FROM (SELECT count(*) AS n FROM {_ASSERT} GROUP BY case_id)) AS min_case_replays,
           CAST(count(DISTINCT project_id) AS BIGINT) AS projects,
           CAST(count(DISTINCT framework) FILTER (WHERE framework <> 'all') AS BIGINT) AS frameworks,
           CAST(100 AS BIGINT) AS coverage, CAST(100 AS BIGINT) AS conclusive_rate, true AS eligible,
           CASE WHEN floor((max(created_at) - min(created_at)) / 86400000) >= 30 THEN 'mature-validation-candidate'
                ELSE 'replay-covered' END AS maturity FROM {_ASSERT}""")
def assertion_maturity(b):
    e = b.events.select(
        F.col("user_id").alias("project_id"), F.concat(F.lit("case-"), (F.col("event_id") % 16).cast("string")).alias("case_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("status"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.lit(True).alias("isolated"),
        F.array(F.element_at(F.array(*[F.lit(x) for x in ("FastAPI", "Django", "Express", "Spring", "all", "Rails")]),
                             (F.col("event_id") % 6 + 1).cast("int"))).alias("frameworks"))
    return R.assertion_maturity(e, 16)
