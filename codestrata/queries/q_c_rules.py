"""Rules over functions (C03, D02, D03, D16, D17, F01, B35, rule evidence)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rule_table as T
from ..operators import rules as R
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS
from .facts import function_facts, q, sql_rx, with_degrees
from .registry import query


def rule_inputs(b):
    f = with_degrees(function_facts(b), b.edges)
    return f.select(
        "*", F.when(F.col("function_id") % 3 == 0, "Parser Fact").otherwise("Heuristic").alias("source"),
        F.when(F.col("function_id") % 3 == 0, "NodeCompilerAdapter").otherwise("LocalHeuristicParser").alias("parser"),
        F.when(F.col("function_id") % 6 == 0, F.array(F.lit("compiler typed"))).otherwise(
            F.array(F.lit("signature rule"))).alias("parse_evidence"),
        F.lit(False).alias("self_call"))


def matches(b):
    return R.rule_matches(rule_inputs(b))


# ---- the same evaluation written as a plain nested loop for the checking engine
_TEXT = ("lower(name || chr(10) || path || chr(10) || language || chr(10) || return_type || chr(10) || data_shape "
         "|| chr(10) || summary || chr(10) || body || chr(10) || source || chr(10) || parser || chr(10) "
         "|| array_to_string(params, ' ') || chr(10) || array_to_string(outputs, ' ') || chr(10) || evidence)")
_STRUCT = {
    "outdegree = 0": "out_degree = 0", "return missing": "NOT real", "sideeffects empty": "len(side_effects) = 0",
    "unknown + typed": "len(list_filter(params, lambda p: regexp_matches(p, '(?i)unknown|any'))) > 0",
    "parser fact": "source = 'Parser Fact'",
    "ast": "regexp_matches(parser || ' ' || evidence, '(?i)ast|compiler|typescript')",
    "heuristic": "source = 'Heuristic'", "entry function": "in_degree = 0 AND out_degree > 0",
    "call edge": "in_degree + out_degree > 0", "unreachable function": "in_degree + out_degree = 0",
    "recursive": "regexp_matches(t, '\\brecurs')",
}


def _signal_sql(s: str) -> str:
    if s in _STRUCT:
        return _STRUCT[s]
    if s in T.PATTERN_SIGNALS:
        return sql_rx("t", T.PATTERN_SIGNALS[s])
    if s in T.STRUCTURAL_SIGNALS:
        return "false"
    if s.replace("_", "").isalnum():
        return sql_rx("t", rf"\b{s}\b")
    return f"contains(t, {q(s)})"


def _context_sql(c: T.Context) -> str:
    terms = [sql_rx("t", p) for p in c.need] + [f"NOT {sql_rx('t', p)}" for p in c.forbid]
    if c.need_or_input:
        terms.append(f"({sql_rx('t', c.need_or_input)} OR len(external_inputs) > 0)")
    if c.signals:
        terms.append("(" + " OR ".join(_signal_sql(s) for s in c.signals) + ")")
    if c.any_of:
        terms.append("(" + " OR ".join(
            sql_rx("t", p) + (f" AND {sql_rx('t', r)}" if r else "") for p, r in c.any_of) + ")")
    if c.extra:
        terms.append({
            "no-validations": "len(validations) = 0", "open-leaf": "out_degree = 0 AND NOT real AND len(side_effects) = 0",
            "graph-root": "in_degree = 0 AND out_degree > 0",
            "weak-token-check": f"(NOT {sql_rx('t', T.WEAK_TOKEN_GOOD)} OR {sql_rx('t', T.WEAK_TOKEN_BAD)})",
            "two-mutations": "(" + " + ".join(f"CAST(contains(t, {q(w)}) AS INT)" for w in T.MUTATION_WORDS) + ") >= 2",
        }[c.extra])
    return " AND ".join(terms)


_SRC = f"""SELECT *, {_TEXT} AS t FROM (SELECT *,
    CASE WHEN function_id % 3 = 0 THEN 'Parser Fact' ELSE 'Heuristic' END AS source,
    CASE WHEN function_id % 3 = 0 THEN 'NodeCompilerAdapter' ELSE 'LocalHeuristicParser' END AS parser,
    CASE WHEN function_id % 6 = 0 THEN 'compiler typed' ELSE 'signature rule' END AS evidence FROM nodes)"""
_ONE = " UNION ALL ".join(
    f"SELECT function_id, project_id, {q(r.rule_id)} AS rule_id, {q(r.category)} AS rule_category, {q(r.severity)} AS severity, "
    f"{r.base} AS base, [{', '.join(map(q, r.tags))}] AS tags, source, confidence, "
    f"list_filter([{', '.join(f'CASE WHEN {_signal_sql(s)} THEN {q(s)} END' for s in r.signals)}], lambda x: x IS NOT NULL) AS matched "
    f"FROM rule_src{' WHERE ' + _context_sql(T.CONTEXTS[r.rule_id]) if r.rule_id in T.CONTEXTS else ''}"
    for r in T.RULES)
ORACLE_RELATIONS["rule_src"] = _SRC
ORACLE_DEPENDS["rule_src"] = ("nodes",)
ORACLE_RELATIONS["rmatch"] = f"""
    SELECT *, CAST(CASE WHEN source = 'Parser Fact' THEN raw ELSE least(68, raw) END AS BIGINT) AS match_confidence,
           CASE WHEN source = 'Parser Fact' THEN 'compiler' ELSE 'heuristic' END AS evidence_grade
    FROM (SELECT *, greatest(45, least(96, floor(CAST(base AS DOUBLE) * 100 + CASE WHEN source = 'Parser Fact' THEN 5 ELSE 0 END
              + least(10, len(matched) * 3) + greatest(-6.0, least(6.0, (confidence - 70) / 4)) + 0.5))) AS raw
          FROM ({_ONE}) WHERE len(matched) > 0)"""
ORACLE_DEPENDS["rmatch"] = ("rule_src",)
_WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'risk' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END"


@query("rule_matches", """
    SELECT function_id, rule_id, severity, evidence_grade, array_to_string(matched, ';') AS matched, match_confidence FROM rmatch""")
def rule_matches(b):
    return matches(b).select(
        "function_id", "rule_id", "severity", "evidence_grade", F.array_join("matched", ";").alias("matched"),
        "match_confidence")


@query("rule_summary", """
    SELECT project_id, CAST(count(*) AS BIGINT) AS total_matches, CAST(count(DISTINCT function_id) AS BIGINT) AS matched_functions,
           CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical_count,
           CAST(count(*) FILTER (WHERE severity = 'risk') AS BIGINT) AS risk_count,
           CAST(count(*) FILTER (WHERE severity = 'warn') AS BIGINT) AS warn_count,
           CAST(count(*) FILTER (WHERE severity = 'info') AS BIGINT) AS info_count FROM rmatch GROUP BY project_id""")
def rule_summary(b):
    return R.rule_summary(matches(b))


@query("rule_top_matches", f"""
    SELECT project_id, function_id, rule_id, CAST(row_number() OVER w AS BIGINT) AS match_rank FROM rmatch
    WINDOW w AS (PARTITION BY project_id ORDER BY {_WEIGHT} DESC, match_confidence DESC, function_id, rule_id)
    QUALIFY row_number() OVER w <= 10""")
def rule_top_matches(b):
    return R.top_matches(matches(b)).select(
        "project_id", "function_id", "rule_id", F.col("match_rank").cast("long").alias("match_rank"))


@query("rule_issues", f"""
    SELECT project_id, function_id, title, category, issue_severity AS severity,
           CASE WHEN evidence_grade <> 'heuristic' AND match_confidence >= 76 THEN 'Likely' ELSE 'Possible' END AS status,
           match_confidence AS confidence
    FROM (SELECT *, rule_id AS title, CASE severity WHEN 'critical' THEN 'Critical' WHEN 'risk' THEN 'High' ELSE 'Medium' END AS issue_severity,
             CASE WHEN rule_category = 'security' THEN 'security' WHEN rule_category IN ('efficiency', 'algorithm') THEN 'performance'
                  WHEN rule_category = 'stability' THEN 'flow'
                  WHEN rule_category = 'language_api' AND (list_contains(tags, 'security') OR severity = 'critical') THEN 'security'
                  ELSE 'quality' END AS category
          FROM rmatch WHERE severity <> 'info'
          QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY {_WEIGHT} DESC, match_confidence DESC, function_id, rule_id) <= 20)""")
def rule_issues(b):
    return R.rule_issues(matches(b)).drop("match_rank")


@query("apply_rule_matches", """
    SELECT function_id, CAST(coalesce(greatest(35, least(96, floor((f.confidence + greatest(50, best)) / 2 + 0.5))), f.confidence) AS BIGINT) AS confidence,
           CAST(len(list_distinct(list_concat(f.risks, coalesce(labels, [])))) AS BIGINT) AS risk_count
    FROM facts f LEFT JOIN (SELECT function_id AS fid, max(match_confidence) AS best,
        list_filter(list_distinct(list(CASE WHEN severity = 'info' THEN NULL
            WHEN rule_id IN ('security-sql-injection', 'security-orm-raw-query') OR regexp_matches(rule_id, 'sqlalchemy|queryraw|java-sql') THEN 'sql-injection'
            WHEN rule_id IN ('security-command-exec', 'language-api-node-exec', 'language-api-python-subprocess') OR regexp_matches(rule_id, 'java-runtime|c-system') THEN 'command-execution'
            WHEN rule_id IN ('security-path-traversal', 'language-api-node-readfile', 'language-api-python-open') THEN 'path-traversal'
            WHEN contains(rule_id, 'c-strcpy') OR rule_id = 'efficiency-unbounded-growth' THEN 'overflow'
            WHEN contains(rule_id, 'device-offline') THEN 'device-offline' WHEN contains(rule_id, 'watchdog') THEN 'watchdog-missing'
            WHEN rule_id = 'stability-infinite-loop' THEN 'infinite-loop' ELSE rule_id END)), lambda x: x IS NOT NULL) AS labels
        FROM rmatch GROUP BY function_id) ON fid = function_id""")
def apply_rule_matches(b):
    out = R.apply_matches(rule_inputs(b), matches(b))
    return out.select("function_id", "confidence", F.size("risks").cast("long").alias("risk_count"))


@query("coverage_by_area", """
    WITH r AS (SELECT p_type AS category, p_name, p_brand FROM part),
         t AS (SELECT DISTINCT p_type AS category, CAST(300 AS INT) AS target_count FROM part),
         c AS (SELECT category, count(*) AS n, count(DISTINCT w) FILTER (WHERE w IN ('red', 'blue', 'small', 'nothing')) AS hit
               FROM (SELECT category, p_name, unnest(string_split(p_name, ' ')) AS w FROM r) GROUP BY category),
         k AS (SELECT category, count(*) AS n FROM r GROUP BY category)
    SELECT t.category, k.n AS rule_count, t.target_count, CAST(4 - c.hit AS INT) AS missing_tags,
           CAST(floor(least(100, floor(k.n * 100.0 / 300 + 0.5)) * 0.68::DOUBLE + floor(c.hit * 100.0 / 4 + 0.5) * 0.32::DOUBLE + 0.5) AS BIGINT) AS coverage
    FROM t JOIN k ON t.category = k.category JOIN c ON t.category = c.category""")
def coverage_by_area(b):
    rules = b.part.select(F.col("p_type").alias("category"), F.split("p_name", " ").alias("tags"))
    targets = b.part.select(F.col("p_type").alias("category")).distinct().select(
        "category", F.lit(300).alias("target_count"),
        F.array(*map(F.lit, ("red", "blue", "small", "nothing"))).alias("required_tags"))
    return R.rule_coverage(rules, targets)


@query("library_audit", """
    WITH e AS (SELECT p_type AS category, p_brand AS domain,
                      CASE p_size % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'extended' ELSE 'planned' END AS maturity FROM part),
         a AS (SELECT category, count(*) AS entry_count, count(*) FILTER (WHERE maturity = 'core') AS core_count,
                      count(*) FILTER (WHERE maturity = 'extended') AS extended_count,
                      count(*) FILTER (WHERE maturity = 'planned') AS planned_count,
                      count(DISTINCT domain) FILTER (WHERE domain IN ('Brand#1', 'Brand#2', 'Brand#99')) AS covered_domains
               FROM e GROUP BY category)
    SELECT category, entry_count, core_count, extended_count, planned_count, covered_domains, percent,
           CASE WHEN percent >= 82 AND entry_count >= 250 THEN 'mature' WHEN percent >= 58 THEN 'partial' ELSE 'needed' END AS status
    FROM (SELECT *, CAST(floor(least(100, floor(entry_count * 100.0 / 250 + 0.5)) * 0.42::DOUBLE
              + floor(covered_domains * 100.0 / 3 + 0.5) * 0.34::DOUBLE
              + least(100, floor(core_count * 100.0 / 155 + 0.5)) * 0.24::DOUBLE + 0.5) AS BIGINT) AS percent FROM a)""")
def library_audit(b):
    maturity = F.when(F.col("p_size") % 3 == 0, "core").when(F.col("p_size") % 3 == 1, "extended").otherwise("planned")
    entries = b.part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("domain"), maturity.alias("maturity"))
    targets = entries.select("category").distinct().select(
        "category", F.lit(250).alias("target_count"),
        F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#99"))).alias("core_domains"))
    return R.library_audit(entries, targets).drop("target_count", "core_domains")


@query("rule_evidence_kinds", """
    SELECT rule_id, unnest(kinds) AS evidence_type FROM (SELECT p_partkey AS rule_id, list_filter([
        CASE WHEN p_type = 'PROMO' THEN 'regex' WHEN p_type = 'ECONOMY' THEN 'ast' ELSE 'type' END,
        CASE WHEN contains(p_name, 'red') THEN 'runtime' END,
        CASE WHEN p_type = 'ECONOMY' OR contains(p_name, 'ring') THEN 'dependency' END], lambda x: x IS NOT NULL) AS kinds FROM part)""")
def rule_evidence_kinds(b):
    word = F.split("p_name", " ")
    tags = F.transform(word, lambda w: F.when(w == "red", "timeout").when(w == "ring", "go").otherwise(w))
    r = b.part.select(
        F.col("p_partkey").alias("rule_id"), tags.alias("tags"), F.lit(0.7).alias("base"),
        F.when(F.col("p_type") == "PROMO", "security").when(F.col("p_type") == "ECONOMY", "language_api")
        .otherwise("math").alias("category"))
    return R.rule_evidence(r).select("rule_id", "evidence_type")
