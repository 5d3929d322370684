"""Joins and aggregates over dependencies, facts, issues and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions
from ..operators import advisories as A, concurrency as K, fusion as U, issues as I
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS
from .facts import flow_nodes, function_facts
from .registry import query


def advisory_table(b):
    rng = F.array(F.struct("introduced", "fixed", "last_affected"))
    return b.advs.select(
        "source_id", "external_id", "package_name", "ecosystem", "severity", "kev", F.lit("accepted").alias("status"),
        F.lit("vulnerability").alias("record_kind"), F.array().cast("array<string>").alias("versions"), rng.alias("ranges"),
        F.array("cpe_version").alias("cpe_versions"))


def _key(v):
    return (f"(CAST(split_part({v}, '.', 1) AS BIGINT) * 1000000 + CAST(split_part({v}, '.', 2) AS BIGINT) * 1000 "
            f"+ CAST(split_part({v}, '.', 3) AS BIGINT))")


ORACLE_RELATIONS["amatch"] = f"""
    SELECT project_id, name, version, external_id, kev, exact, verdict FROM (
      SELECT d.project_id, d.name, d.version, a.external_id, a.kev, d.exact, CASE WHEN NOT d.exact THEN 'unknown'
          WHEN a.source_id = 'osv' THEN CASE WHEN {_key('d.version')} >= {_key('a.introduced')} AND (a.fixed IS NULL OR {_key('d.version')} < {_key('a.fixed')})
              AND (a.last_affected IS NULL OR {_key('d.version')} <= {_key('a.last_affected')}) THEN 'affected' ELSE 'not-affected' END
          WHEN a.cpe_version = '*' THEN 'unknown' WHEN a.cpe_version = d.version THEN 'affected' ELSE 'not-affected' END AS verdict
      FROM deps d JOIN advs a ON lower(a.package_name) = d.name
       AND (a.source_id = 'nvd' OR lower(a.ecosystem) = CASE d.ecosystem WHEN 'python' THEN 'pypi' WHEN 'Cargo' THEN 'crates.io' ELSE 'npm' END))
    WHERE verdict <> 'not-affected'"""
ORACLE_DEPENDS["amatch"] = ("deps", "advs")


def matches(b):
    return A.match_advisories(b.deps, advisory_table(b))


@query("advisory_window_join", """
    SELECT project_id, name, version, external_id, CASE WHEN verdict = 'affected' THEN 'confirmed' ELSE 'review' END AS match_status,
           CAST(CASE WHEN verdict = 'affected' THEN 96 WHEN exact THEN 68 ELSE 54 END AS BIGINT) AS match_confidence FROM amatch""")
def advisory_window_join(b):
    return matches(b).select("project_id", "name", "version", "external_id", "match_status", "match_confidence")


@query("kev_flag", "SELECT external_id, kev AS kev_priority, CAST(count(*) AS BIGINT) AS n FROM amatch GROUP BY 1, 2")
def kev_flag(b):
    kev = b.advs.where("kev").select("external_id")
    return A.flag_exploited(matches(b), kev).groupBy("external_id", "kev_priority").agg(F.count(F.lit(1)).alias("n"))


@query("advisory_report", """
    SELECT kev AS kev_priority, CAST(CASE WHEN verdict = 'affected' THEN 96 WHEN exact THEN 68 ELSE 54 END AS BIGINT) AS match_confidence, name, external_id, project_id, version
    FROM amatch ORDER BY kev DESC, 2 DESC, name, external_id, project_id, version LIMIT 500""")
def advisory_report(b):
    """the 500 most urgent matches; the limit is the report."""
    kev = b.advs.where("kev").select("external_id")
    return A.match_report(A.flag_exploited(matches(b), kev)).select(
        "kev_priority", "match_confidence", "name", "external_id", "project_id", "version")


@query("version_order", """
    SELECT l_orderkey, l_linenumber, l_partkey, a < c OR (a = c AND (pre AND NOT pre2)) AS lower_than FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 * 1000 + l_suppkey % 12 AS a, l_suppkey % 5 * 1000 + l_partkey % 12 AS c,
             l_linenumber % 2 = 0 AS pre, l_linenumber % 3 = 0 AS pre2 FROM lineitem)
    """.replace("a < c OR (a = c AND (pre AND NOT pre2))", "a < c OR (a = c AND pre AND NOT pre2)"))
def version_order(b):
    v = lambda x, y, cond: F.concat((F.col(x) % 5).cast("string"), F.lit("."), (F.col(y) % 12).cast("string"), F.lit(".0"),
                                    F.when(cond, "-beta.2").otherwise(""))
    li = b.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", v("l_partkey", "l_suppkey", F.col("l_linenumber") % 2 == 0).alias("x"),
        v("l_suppkey", "l_partkey", F.col("l_linenumber") % 3 == 0).alias("y"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     (versions.current_key(F.col("x")) < versions.current_key(F.col("y"))).alias("lower_than"))


def _fusion_inputs(b):
    fns = b.fn.select(
        "function_id", "path", "name", (F.col("slot") * 10).alias("start_line"), F.split("params_text", ", ").alias("params"),
        F.when(F.col("hint") == "", "inferred").otherwise(F.col("hint")).alias("return_type"), F.lit(70).alias("confidence"))
    facts = b.fn.where("function_id % 3 <> 1").select(
        (F.col("function_id") + 1_000_000).alias("fact_id"), "path", F.concat(F.lit("Cls."), "name").alias("name"), F.col("name").alias("short_name"),
        (F.col("slot") * 10 + F.col("function_id") % 7).alias("start_line"), F.array(F.lit("typed: T")).alias("params"),
        F.when(F.col("function_id") % 2 == 0, "int").otherwise("unknown").alias("return_type"), F.lit(95).alias("confidence"))
    return fns, facts


@query("band_join_fusion", """
    SELECT CAST(function_id AS VARCHAR) AS function_id, CASE WHEN hit THEN 'merged' ELSE 'base' END AS origin,
           CASE WHEN hit AND function_id % 2 = 0 THEN 'int' WHEN hint = '' THEN 'inferred' ELSE hint END AS return_type, CAST(CASE WHEN hit THEN 95 ELSE 70 END AS BIGINT) AS confidence
    FROM (SELECT *, function_id % 3 <> 1 AND function_id % 7 <= 3 AS hit FROM fn)
    UNION ALL SELECT 'compiler:' || CAST(function_id + 1000000 AS VARCHAR), 'added', CASE WHEN function_id % 2 = 0 THEN 'int' ELSE 'unknown' END, CAST(95 AS BIGINT)
    FROM fn WHERE function_id % 3 <> 1 AND function_id % 7 > 3""")
def band_join_fusion(b):
    fns, facts = _fusion_inputs(b)
    return U.fuse_functions(fns, facts).select("function_id", "origin", "return_type", "confidence")


@query("fused_edges", """
    WITH m AS (SELECT function_id, CASE WHEN function_id % 7 <= 3 THEN CAST(function_id AS VARCHAR) ELSE 'compiler:' || CAST(function_id + 1000000 AS VARCHAR) END AS id FROM fn WHERE function_id % 3 <> 1)
    SELECT DISTINCT a.id AS src, c.id AS dst FROM fn f JOIN m a ON a.function_id = f.function_id JOIN m c ON c.function_id = f.project_id * 40 + (f.local_ix + 5) % 40
    WHERE a.id <> c.id AND NOT EXISTS (SELECT 1 FROM edges e WHERE CAST(e.src AS VARCHAR) = a.id AND CAST(e.dst AS VARCHAR) = c.id)""")
def fused_edges(b):
    fns, facts = _fusion_inputs(b)
    other = F.col("project_id") * 40 + (F.col("local_ix") + 5) % 40
    fe = b.fn.where("function_id % 3 <> 1").select((F.col("function_id") + 1_000_000).alias("src"), (other + 1_000_000).alias("dst"),
                                                    other.alias("_o"), F.lit(90).alias("confidence")).where("_o % 3 <> 1").drop("_o")
    return U.fuse_edges(b.edges, fe, U.match_facts(fns, facts)).select("src", "dst")


def concurrent_events(b):
    from .q_e_graph import cfg

    c = cfg(b).where("ord > 0")
    locks = F.when(F.col("concurrency").contains("mutex"), F.array(F.lit("m"))).otherwise(
        F.when(F.col("function_id") % 2 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")))
    return K.launches(c).select(
        "function_id", "ord", F.col("uses").alias("reads"), F.col("defs").alias("writes"), locks.alias("locks"),
        (F.col("function_id") % 4 == 1).alias("atomic"))


ORACLE_RELATIONS["cev"] = """
    SELECT function_id, ord, uses, defs, CASE WHEN contains(concurrency, 'mutex') OR function_id % 2 = 0 THEN 'm' ELSE '' END AS lk, function_id % 4 = 1 AS at
    FROM cfg WHERE contains(concurrency, 'spawn') AND ord > 0"""
ORACLE_DEPENDS["cev"] = ("cfg",)


@query("race_pairs", """
    SELECT DISTINCT a.function_id, a.ord AS first, c.ord AS second, v AS variable FROM cev a JOIN cev c ON a.function_id = c.function_id AND a.ord < c.ord,
        (SELECT unnest(['first', 'second', 'sanitized_value', 'shared_total', 'request', 'value', 'seed', 'payload']) AS v)
    WHERE NOT (a.lk = 'm' AND c.lk = 'm') AND NOT (a.at AND c.at) AND ((a.defs = v AND (c.defs = v OR c.uses = v)) OR (c.defs = v AND a.uses = v))""")
def race_pairs(b):
    return K.race_pairs(concurrent_events(b))


@query("sync_edges", """
    SELECT a.function_id, a.ord AS first, c.ord AS second, 'm' AS primitive FROM cev a JOIN cev c ON a.function_id = c.function_id AND a.ord < c.ord WHERE a.lk = 'm' AND c.lk = 'm'
    UNION ALL SELECT a.function_id, a.ord, c.ord, 'atomic' FROM cev a JOIN cev c ON a.function_id = c.function_id AND a.ord < c.ord WHERE a.at AND c.at""")
def sync_edges(b):
    return K.sync_edges(concurrent_events(b))


@query("structural_pairs", """
    SELECT function_id, 'resource' AS kind, false AS released FROM fn WHERE p_size % 10 = 5
    UNION ALL SELECT function_id, 'lifecycle', false FROM fn WHERE regexp_matches(body, '(?:\\.start\\s*\\(|\\bstart[A-Z_]\\w*\\s*\\()')""")
def structural_pairs(b):
    return I.structural_pairs(b.fn)


@query("exception_lines", """
    SELECT function_id, CAST(CASE WHEN c1 IS NULL THEN 1 ELSE 2 END AS BIGINT) AS line_offset, 'if (first < 10) { throw first }' AS predicate FROM fn WHERE p_size % 10 = 6""")
def exception_lines(b):
    return I.exception_lines(b.fn).withColumnRenamed("offset", "line_offset")


def audited(b):
    return b.issues.withColumn("runtime_confirmed", F.col("project_id") % 2)


@query("evidence_audit", """
    SELECT project_id, total, confirmed, likely, possible, unknown, heuristic_candidates, project_id % 2 AS runtime_confirmed,
           CAST(floor((confirmed * 100 + likely * 72 + possible * 38 + unknown * 12) / total + 0.5) AS BIGINT) AS score,
           CASE WHEN possible + unknown = 0 AND project_id % 2 > 0 THEN 'closed' WHEN confirmed + likely > possible + unknown THEN 'partial' ELSE 'heuristic' END AS audit_status
    FROM (SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status = 'Confirmed') AS confirmed, count(*) FILTER (WHERE status = 'Likely') AS likely,
        count(*) FILTER (WHERE status = 'Possible') AS possible, count(*) FILTER (WHERE status = 'Unknown') AS unknown,
        count(*) FILTER (WHERE contains(evidence, 'heuristic')) AS heuristic_candidates FROM issues GROUP BY project_id)""")
def evidence_audit(b):
    return I.evidence_audit(audited(b))


@query("penalty_scores", """
    SELECT l_orderkey AS order_id, CAST(greatest(0, 100 - sum(CASE l_linenumber % 4 WHEN 0 THEN 28 WHEN 1 THEN 18 WHEN 2 THEN 10 ELSE 4 END)) AS BIGINT) AS score FROM lineitem GROUP BY l_orderkey""")
def penalty_scores(b):
    i = b.lineitem.select(F.col("l_orderkey").alias("order_id"), F.when(F.col("l_linenumber") % 4 == 0, "Critical").when(
        F.col("l_linenumber") % 4 == 1, "High").when(F.col("l_linenumber") % 4 == 2, "Medium").otherwise("Low").alias("severity"))
    return I.penalty_score(i, ["order_id"])


@query("closure_scores", """
    SELECT file_id, CAST(greatest(0, 100 - sum(CASE status WHEN 'Open' THEN 18 WHEN 'Overflow Risk' THEN 14 WHEN 'Blocked' THEN 16 WHEN 'Unknown' THEN 6 ELSE 0 END
        + CASE WHEN function_id % 53 = 0 THEN 4 ELSE 0 END)) AS BIGINT) AS closure_score FROM nodes GROUP BY file_id""")
def closure_scores(b):
    n = flow_nodes(b).withColumn("is_stop", F.col("function_id") % 53 == 0)
    return I.closure_score(n, ["file_id"]).select("file_id", F.col("closure_score").cast("long").alias("closure_score"))


@query("issue_union", """
    SELECT project_id, category, title, evidence, min(issue_id) AS issue_id FROM issues WHERE severity = 'Critical' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT project_id, category, title, evidence, min(issue_id) FROM issues i WHERE severity <> 'Critical' AND NOT EXISTS (
        SELECT 1 FROM issues k WHERE k.severity = 'Critical' AND k.project_id = i.project_id AND k.category = i.category AND k.title = i.title AND k.evidence = i.evidence)
    GROUP BY 1, 2, 3, 4""")
def issue_union(b):
    i = b.issues
    return I.union_issues([i.where("severity = 'Critical'"), i.where("severity <> 'Critical'")]).select(
        "project_id", "category", "title", "evidence", "issue_id")


@query("obligation_union", """
    SELECT project_id, obligation_id, arg_max(domain, (confidence, domain, state)) AS domain, arg_max(state, (confidence, domain, state)) AS state
    FROM (SELECT project_id, 'verify-issue-' || CAST(issue_id AS VARCHAR) AS obligation_id, confidence,
        CASE WHEN issue_id % 3 = 0 THEN 'security' ELSE CASE category WHEN 'security' THEN 'security' WHEN 'environment' THEN 'environment' ELSE 'functionality' END END AS domain,
        CASE WHEN issue_id % 3 = 0 THEN 'proved' WHEN status = 'Confirmed' THEN 'violated' WHEN status = 'Likely' THEN 'observed' ELSE 'unproved' END AS state FROM issues) GROUP BY 1, 2""")
def obligation_union(b):
    o = I.issue_obligations(b.issues)
    proofs = I.issue_obligations(b.issues.where("issue_id % 3 = 0")).withColumn("domain", F.lit("security")).withColumn("state", F.lit("proved"))
    return I.union_obligations([o, proofs]).select("project_id", "obligation_id", "domain", "state")


@query("verification_report", """
    SELECT project_id, CAST(count(*) AS BIGINT) AS obligations, CAST(count(*) FILTER (WHERE status = 'Confirmed') AS BIGINT) AS violated_count,
           CAST(count(*) FILTER (WHERE status = 'Likely') AS BIGINT) AS observed_count,
           CAST(least(48, floor(sum(floor(CASE status WHEN 'Confirmed' THEN 20 WHEN 'Likely' THEN 62 ELSE 28 END * 0.45::DOUBLE * (0.6::DOUBLE + confidence / 250) + 0.5)) / count(*) + 0.5)) AS BIGINT) AS score
    FROM issues GROUP BY project_id""")
def verification_report(b):
    return I.verification_report(I.issue_obligations(b.issues)).select(
        "project_id", "obligations", "violated_count", "observed_count", F.col("score").cast("long").alias("score"))


@query("grouped_issue_report", """
    SELECT project_id, category, title AS title_key, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT evidence) AS BIGINT) AS locations, max(confidence) AS confidence,
           CASE max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
           CASE max(CASE status WHEN 'Confirmed' THEN 4 WHEN 'Likely' THEN 3 WHEN 'Possible' THEN 2 ELSE 1 END) WHEN 4 THEN 'Confirmed' WHEN 3 THEN 'Likely' WHEN 2 THEN 'Possible' ELSE 'Unknown' END AS status
    FROM issues GROUP BY 1, 2, 3""")
def grouped_issue_report(b):
    return I.grouped_report(b.issues)


@query("file_summary", """
    WITH f AS (SELECT file_id, min(path) AS path, count(*) AS n, array_to_string(list_sort(list(DISTINCT category))[1:5], '|') AS role_names FROM facts GROUP BY file_id),
         i AS (SELECT 'src/mod_' || CAST(CAST(floor(l_suppkey / 5) AS BIGINT) % 7 AS VARCHAR) || '/file_' || CAST(l_suppkey AS VARCHAR)
                   || CASE l_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.rs' END AS path FROM lineitem)
    SELECT file_id, n AS function_count, role_names, (SELECT count(*) FROM i WHERE i.path = f.path) AS issue_count FROM f""")
def file_summary(b):
    fns = function_facts(b).select("file_id", "path", F.col("category").alias("role"))
    files = fns.groupBy("file_id").agg(F.min("path").alias("path"))
    k = F.col("l_suppkey")
    ext = F.when(k % 4 == 0, ".ts").when(k % 4 == 1, ".py").when(k % 4 == 2, ".go").otherwise(".rs")
    iss = b.lineitem.select(F.concat(
        F.lit("src/mod_"), (F.floor(k / 5) % 7).cast("string"), F.lit("/file_"), k.cast("string"), ext, F.lit(":12 run()")).alias("evidence"))
    return I.file_summary(files, fns, iss).select("file_id", "function_count", F.array_join("roles", "|").alias("role_names"), "issue_count")


@query("contract_coverage", """
    SELECT f.project_id, CAST(count(*) AS BIGINT) AS functions, CAST(count(c.n) AS BIGINT) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS clauses, CAST(coalesce(sum(s), 0) AS BIGINT) AS security_clauses,
           CAST(coalesce(sum(g), 0) AS BIGINT) AS strong_clauses, CASE WHEN coalesce(sum(n), 0) = 0 THEN 'empty' WHEN count(c.n) = count(*) AND sum(g) > 0 THEN 'contract-ready' ELSE 'partial' END AS status
    FROM fn_base f LEFT JOIN (SELECT l_partkey - l_partkey % 4 // 3 AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_linestatus = 'F') AS g FROM lineitem
        GROUP BY 1) c ON k = f.function_id GROUP BY f.project_id""")
def contract_coverage(b):
    # each fourth function passes its clauses on to the one before and has none
    clauses = b.lineitem.select(
        F.expr("l_partkey - l_partkey % 4 div 3").alias("function_id"), F.when(F.col("l_returnflag") == "A", "security").otherwise("range").alias("kind"),
        F.when(F.col("l_linestatus") == "F", "ast").otherwise("lexical").alias("grade"))
    return I.contract_coverage(b.fn_base.select("project_id", "function_id"), clauses)


@query("repair_gates", """
    WITH r AS (SELECT l_suppkey AS v, l_orderkey * 10 + l_linenumber AS seq, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'stress' ELSE 'security' END AS kind,
            l_linenumber % 2 = 1 AS cand, l_returnflag <> 'A' AND l_discount < 0.09 AS ok, l_quantity < 49 AS same, l_quantity < 40 AS leaked FROM lineitem),
      g AS (SELECT v, cand, arg_max(ok, (seq, l_partkey)) AS ok, arg_max(same, (seq, l_partkey)) AS same FROM r WHERE kind = 'baseline' GROUP BY 1, 2),
      x AS (SELECT v, count(*) FILTER (WHERE kind = 'stress' AND ok) >= 16 AS bench, bool_or(kind = 'security' AND ok AND NOT leaked) AS sec FROM r WHERE cand GROUP BY 1)
    SELECT s_suppkey AS variant, reg AS regression, bench AS benchmark, sec AS security, CASE WHEN s_suppkey % 10 = 3 THEN 'rejected' WHEN s_suppkey % 4 <> 0 AND reg AND bench AND sec THEN 'eligible' ELSE 'proposed' END AS status
    FROM (SELECT s_suppkey, coalesce(a.ok AND c.ok AND a.same = c.same, false) AS reg, coalesce(x.bench, false) AS bench, coalesce(x.sec, false) AS sec FROM supplier
       LEFT JOIN g a ON a.v = s_suppkey AND NOT a.cand LEFT JOIN g c ON c.v = s_suppkey AND c.cand LEFT JOIN x ON x.v = s_suppkey)""")
def repair_gates(b):
    k = F.col("l_partkey") % 3
    runs = b.lineitem.select(
        F.col("l_suppkey").alias("variant"), F.when(F.col("l_linenumber") % 2 == 1, "candidate").otherwise("baseline").alias("side"),
        F.when(k == 0, "baseline").when(k == 1, "stress").otherwise("security").alias("experiment_kind"),
        F.when(F.col("l_returnflag") != "A", "passed").otherwise("failed").alias("status"), (F.col("l_discount") < 0.09).alias("isolated"),
        F.when(F.col("l_quantity") < 49, "same").otherwise("other").alias("stdout"), (F.col("l_quantity") < 40).alias("leaked"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("seq"))
    static = b.supplier.select(F.col("s_suppkey").alias("variant"), (F.col("s_suppkey") % 4 != 0).alias("static_pass"))
    bad = b.supplier.where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("variant"))
    return I.repair_gates(runs, static, bad).select("variant", "regression", "benchmark", "security", "status")
