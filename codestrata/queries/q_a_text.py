"""Scalar function facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow, text
from .facts import flow_nodes, function_facts, with_degrees
from .registry import query


def j(column: str):
    return F.array_join(column, "|").alias(column)


@query("text_flags", """
    SELECT function_id, category, complexity, array_to_string(risks, '|') AS risks,
           array_to_string(validations, '|') AS validations, array_to_string(side_effects, '|') AS side_effects,
           array_to_string(external_inputs, '|') AS external_inputs FROM facts""")
def text_flags(b):
    return function_facts(b).select(
        "function_id", "category", "complexity", j("risks"), j("validations"), j("side_effects"), j("external_inputs"))


@query("function_contract_text", """
    SELECT function_id, array_to_string(params, '|') AS params, return_type, array_to_string(outputs, '|') AS outputs,
           data_shape, confidence FROM facts""")
def function_contract_text(b):
    return function_facts(b).select("function_id", j("params"), "return_type", j("outputs"), "data_shape", "confidence")


@query("parameter_names", """
    SELECT function_id, pos, param, trim(split_part(param, ':', 1)) AS binding_name,
           trim(split_part(param, ':', 1)) AS variable_name,
           CASE WHEN contains(param, ':') THEN trim(split_part(param, ':', 2)) ELSE 'inferred' END AS type_name
    FROM (SELECT function_id, unnest(params) AS param, CAST(generate_subscripts(params, 1) - 1 AS BIGINT) AS pos FROM facts)""")
def parameter_names(b):
    p = function_facts(b).select("function_id", F.posexplode("params").alias("pos", "param"))
    return p.select(
        "function_id", F.col("pos").cast("long").alias("pos"), "param",
        text.binding_name(F.col("param")).alias("binding_name"), text.variable_name(F.col("param")).alias("variable_name"),
        text.parameter_type(F.col("param")).alias("type_name"))


@query("flow_roles", """
    SELECT function_id, CASE WHEN list_contains(risks, 'infinite-loop') THEN 'blocked'
               WHEN list_contains(risks, 'overflow') THEN 'overflow'
               WHEN contains(lower(name), 'recur') THEN 'reflux' WHEN len(validations) > 0 THEN 'valve'
               WHEN list_has_any(side_effects, ['cache-container', 'state-write']) THEN 'tank'
               WHEN list_contains(side_effects, 'async-schedule') THEN 'pump'
               WHEN len(external_inputs) > 0 OR category = 'input' THEN 'source'
               WHEN NOT list_contains(outputs, 'state change/void') THEN 'outlet' ELSE 'pipe' END AS role
    FROM facts""")
def flow_roles(b):
    return function_facts(b).select(
        "function_id",
        flow.flow_role(
            F.col("name"), F.col("category"), F.col("risks"), F.col("validations"), F.col("side_effects"),
            F.col("external_inputs"), F.col("outputs"), F.lit(False)).alias("role"))


@query("node_status", "SELECT function_id, in_degree, out_degree, status FROM nodes")
def node_status(b):
    return flow_nodes(b).select("function_id", "in_degree", "out_degree", "status")


_CAPACITY_SQL = """
    SELECT function_id, status, CASE WHEN list_contains(risks, 'overflow') THEN 'lake'
               WHEN regexp_matches(t, '\\blist\\b|list<|list\\[') THEN 'lake'
               WHEN regexp_matches(t, '\\barray\\b|array<|\\[\\]|flatmap|\\.map\\(') THEN 'reservoir'
               WHEN regexp_matches(t, '\\bbuffer\\b|\\bqueue\\b|\\bcache\\b|map<|set<|new map|new set') THEN 'lake'
               WHEN list_has_any(side_effects, ['cache-container', 'state-write']) THEN 'reservoir'
               WHEN list_contains(side_effects, 'async-schedule') OR complexity >= 6 THEN 'pond'
               WHEN in_degree + out_degree >= 3 OR real THEN 'river' ELSE 'creek' END AS capacity
    FROM (SELECT *, lower(name || ' ' || return_type || ' ' || data_shape || ' ' || body) AS t FROM nodes)"""


@query("node_capacity", f"""
    SELECT function_id, capacity, CAST(CASE capacity WHEN 'lake' THEN 92 WHEN 'reservoir' THEN 84 WHEN 'pond' THEN 70
        WHEN 'river' THEN 52 ELSE 32 END AS BIGINT) AS score FROM ({_CAPACITY_SQL})""")
def node_capacity(b):
    n = flow_nodes(b).withColumn("capacity", _capacity())
    return n.select("function_id", "capacity", flow.capacity_score(F.col("capacity")).alias("score"))


def _capacity():
    return flow.capacity(
        F.col("name"), F.col("return_type"), F.col("data_shape"), F.col("body"), F.col("risks"), F.col("side_effects"),
        F.col("complexity"), F.col("outputs"), F.col("in_degree"), F.col("out_degree"))


STAGES_SQL = """
    SELECT *, CASE role WHEN 'entry' THEN 'spring' WHEN 'intake' THEN 'inlet' WHEN 'filter' THEN 'purifier'
                 WHEN 'transform' THEN 'main-channel' WHEN 'dispatch' THEN 'fork' WHEN 'merge' THEN 'confluence'
                 WHEN 'store' THEN 'lake' WHEN 'result' THEN 'outflow' ELSE 'warning' END AS label,
           CASE WHEN status = 'Blocked' OR list_has_any(risks, ['code-injection', 'command-execution', 'sql-injection',
                    'path-traversal']) THEN 'critical'
                WHEN status IN ('Overflow Risk', 'Open') OR len(risks) > 0 OR confidence < 60 THEN 'risk'
                WHEN status = 'Partially Closed' OR confidence < 75
                     OR (len(external_inputs) > 0 AND len(validations) = 0) THEN 'warn' ELSE 'none' END AS risk_level
    FROM (SELECT *, CASE WHEN function_id % 40 = 0 THEN 'entry'
                 WHEN status IN ('Blocked', 'Overflow Risk') OR len(risks) > 0 THEN 'fault'
                 WHEN len(external_inputs) > 0 OR category = 'input' THEN 'intake'
                 WHEN len(validations) > 0 THEN 'filter'
                 WHEN list_has_any(side_effects, ['cache-container', 'state-write']) THEN 'store'
                 WHEN in_degree > 1 THEN 'merge'
                 WHEN out_degree > 1 OR list_contains(side_effects, 'async-schedule') THEN 'dispatch'
                 WHEN out_degree = 0 AND real THEN 'result' ELSE 'transform' END AS role FROM nodes)"""


def stages(b):
    n = flow_nodes(b)
    n = n.withColumn(
        "role",
        flow.stage_role(
            F.col("function_id") % 40 == 0, F.col("status"), F.col("risks"), F.col("external_inputs"),
            F.col("category"), F.col("validations"), F.col("side_effects"), F.col("in_degree"), F.col("out_degree"),
            F.col("outputs")))
    return n.select(
        "*", flow.stage_label(F.col("role")).alias("label"),
        flow.stage_risk(F.col("status"), F.col("risks"), F.col("confidence"), F.col("external_inputs"),
                        F.col("validations")).alias("risk_level"))


@query("stage_roles", f"SELECT function_id, role, label, risk_level FROM ({STAGES_SQL})")
def stage_roles(b):
    return stages(b).select("function_id", "role", "label", "risk_level")


@query("stage_data", """
    SELECT function_id,
           CASE WHEN len(params) + len(external_inputs) > 0
                THEN array_to_string(list_concat(params, external_inputs)[1:4], '|')
                WHEN in_degree > 0 THEN CAST(in_degree AS VARCHAR) || ' upstream outputs' ELSE 'no explicit input' END AS data_in,
           CASE WHEN real THEN array_to_string(list_filter(outputs, lambda o: o <> 'state change/void')[1:4], '|')
                WHEN len(side_effects) > 0 THEN array_to_string(side_effects[1:4], '|')
                WHEN out_degree > 0 THEN 'passed to ' || CAST(out_degree AS VARCHAR) || ' downstream'
                ELSE 'no recognised return' END AS data_out
    FROM nodes""")
def stage_data(b):
    n = flow_nodes(b)
    return n.select(
        "function_id",
        F.array_join(flow.stage_data_in(F.col("params"), F.col("external_inputs"), F.col("in_degree")), "|").alias("data_in"),
        F.array_join(flow.stage_data_out(F.col("outputs"), F.col("side_effects"), F.col("out_degree")), "|").alias("data_out"))


BASIN_SQL = """CASE
    WHEN regexp_matches(lower(summary || ' ' || path), 'auth|login|token|permission|security|validate|sanitize') THEN 'security'
    WHEN regexp_matches(lower(summary || ' ' || path), 'parse|parser|syntax|ast|compiler|lsp|language') THEN 'language'
    WHEN regexp_matches(lower(summary || ' ' || path), 'database|repository|crud|sql|sqlite|model|schema') THEN 'storage'
    WHEN regexp_matches(lower(summary || ' ' || path), 'runtime|sandbox|process|execute|runner|trace|debug') THEN 'runtime'
    WHEN regexp_matches(lower(summary || ' ' || path), 'task|job|schedule|queue|reminder') THEN 'scheduling'
    WHEN regexp_matches(lower(summary || ' ' || path), 'project|workspace|file|folder|import') THEN 'workspace'
    ELSE 'other' END"""


@query("basin_labels", f"SELECT function_id, {BASIN_SQL} AS basin FROM facts")
def basin_labels(b):
    return function_facts(b).select("function_id", basin_column())


def basin_column():
    return flow.basin(F.col("name"), F.col("params"), F.col("outputs"), F.col("path")).alias("basin")


@query("remedy_hints", """
    WITH r AS (SELECT function_id, unnest(risks) AS r, generate_subscripts(risks, 1) AS i FROM facts),
         h AS (SELECT function_id, min(i) AS i, CASE
               WHEN regexp_matches(r, 'sql|orm|injection') THEN 'parameterize-queries' WHEN regexp_matches(r, 'command|exec|system|code-injection') THEN 'allowlist-commands'
               WHEN regexp_matches(r, 'path|file|read') THEN 'confine-paths' WHEN contains(r, 'csrf') THEN 'csrf-token' WHEN contains(r, 'cors') THEN 'explicit-origins'
               WHEN contains(r, 'jwt') THEN 'verify-token-claims' WHEN regexp_matches(r, 'lock|deadlock|concurrency') THEN 'lock-order-timeout'
               WHEN regexp_matches(r, 'device|hardware|watchdog|offline') THEN 'heartbeat-watchdog' WHEN regexp_matches(r, 'overflow|capacity') THEN 'capacity-limit'
               WHEN regexp_matches(r, 'timeout|retry') THEN 'timeout-backoff' END AS hint FROM r GROUP BY function_id, hint),
         l AS (SELECT function_id, array_to_string(list(hint ORDER BY i)[1:4], '|') AS hints FROM h WHERE hint IS NOT NULL GROUP BY function_id)
    SELECT function_id, coalesce(hints, '') AS hint_list, CASE WHEN return_type IN ('inferred', 'unknown') THEN 1 ELSE 0 END AS needs_type FROM facts LEFT JOIN l USING (function_id)""")
def remedy_hints(b):
    f = function_facts(b)
    return f.select(
        "function_id", F.array_join(text.remedy_hints(F.col("risks")), "|").alias("hint_list"),
        F.when(F.array_contains(
            text.recommendations({
                "return_type": F.col("return_type"), "external_inputs": F.col("external_inputs"),
                "validations": F.col("validations"), "risks": F.col("risks"), "complexity": F.col("complexity"),
                "calls": F.array(F.lit("x"))}), "type-evidence"), 1).otherwise(0).alias("needs_type"))


@query("token_sets", """
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
           coalesce(array_to_string(list_sort(t)[1:5], '|'), '') AS first_tokens
    FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_.$#/@+-]+'),
                 lambda x: length(x) >= 3)) AS t FROM documents)""")
def token_sets(b):
    t = b.documents.select("doc_id", text.token_set(F.col("text")).alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"),
        F.array_join(F.slice(F.array_sort("t"), 1, 5), "|").alias("first_tokens"))


@query("keyword_ratio", """
    SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END
                    + CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END
                    + CASE WHEN contains(lower(text), 'copyright') THEN 1 ELSE 0 END
                    + CASE WHEN contains(lower(text), 'http') THEN 1 ELSE 0 END) / 4.0 AS ratio FROM documents""")
def keyword_ratio(b):
    return b.documents.select(
        "doc_id", text.keyword_ratio(F.col("text"), ["the", "tion", "copyright", "http"]).alias("ratio"))


@query("loose_package_match", """
    SELECT p.p_partkey AS left_key, n.n_nationkey AS right_key
    FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25
    WHERE contains(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), 'brand' || CAST(n.n_nationkey AS VARCHAR))
       OR contains('brand' || CAST(n.n_nationkey AS VARCHAR), regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'))""")
def loose_package_match(b):
    n = b.nation.select(
        F.col("n_nationkey").alias("right_key"),
        F.concat(F.lit("Node:BRAND_"), F.col("n_nationkey").cast("string")).alias("cand"))
    n = n.withColumn("cand", F.regexp_replace("cand", "^Node:", "node:"))
    p = b.part.select(F.col("p_partkey").alias("left_key"), "p_brand", (F.col("p_partkey") % 25).alias("k"))
    return p.join(n, p.k == n.right_key).where(
        text.loose_package_match(F.col("p_brand"), F.col("cand"))).select("left_key", "right_key")


@query("file_classes", """
    SELECT page_id, regexp_matches(lower(url), '(^|/)(test|tests|__tests__|spec)(/|$)|\\.(test|spec)\\.') AS is_test,
           regexp_matches(lower(url), '(package\\.json|requirements\\.txt|pyproject\\.toml|go\\.mod|cargo\\.toml)$') AS is_manifest,
           regexp_matches(lower(url), '(package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock|cargo\\.lock|poetry\\.lock|go\\.sum)$') AS is_lock
    FROM (SELECT page_id, 'repo/' || CASE page_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/a.spec.' ELSE 'src/' END
          || CASE page_id % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'yarn.lock' WHEN 2 THEN 'go.mod' ELSE 'main.ts' END AS url
          FROM pages)""")
def file_classes(b):
    url = F.concat(
        F.lit("repo/"), F.when(F.col("page_id") % 6 == 0, "tests/").when(F.col("page_id") % 6 == 1, "src/a.spec.")
        .otherwise("src/"),
        F.when(F.col("page_id") % 5 == 0, "package.json").when(F.col("page_id") % 5 == 1, "yarn.lock")
        .when(F.col("page_id") % 5 == 2, "go.mod").otherwise("main.ts"))
    return b.pages.select("page_id", url.alias("url")).select(
        "page_id", flow.is_test_file(F.col("url")).alias("is_test"), flow.is_manifest(F.col("url")).alias("is_manifest"),
        flow.is_lock_file(F.col("url")).alias("is_lock"))


@query("network_score", """
    SELECT function_id, CAST(CASE WHEN function_id % 40 < 5 THEN 80 ELSE 0 END
        + CASE WHEN in_degree = 0 THEN 24 ELSE 0 END + CASE WHEN len(external_inputs) > 0 THEN 28 ELSE 0 END
        + CASE WHEN real THEN 18 ELSE 0 END + CASE WHEN len(validations) > 0 THEN 16 ELSE 0 END
        + CASE WHEN len(risks) > 0 THEN 22 ELSE 0 END + (in_degree + out_degree) * 6 + least(12, complexity) AS BIGINT) AS score
    FROM nodes ORDER BY score DESC, function_id LIMIT 36""")
def network_score(b):
    """the 36 best-connected functions; the limit is the report."""
    n = flow_nodes(b)
    return n.select(
        "function_id",
        flow.network_score(F.col("function_id") % 40 < 5, F.col("in_degree"), F.col("out_degree"),
                           F.col("external_inputs"), F.col("outputs"), F.col("validations"), F.col("risks"),
                           F.col("complexity")).alias("score")).orderBy(F.desc("score"), "function_id").limit(36)
