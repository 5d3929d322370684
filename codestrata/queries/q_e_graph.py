"""Edges, reachability, cycles, paths, taint and points-to on the derived call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taint as V
from ..operators import binding, edges as E, graph as G, pointsto as P, taint as T
from ..session import cut
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS
from .facts import function_facts, sql_rx
from .registry import query


def cfg(b):
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "").alias(c)
    return b.cfg.select("function_id", "project_id", "ord", "kind", split("defs"), split("uses"), "ownership", "concurrency")


def cfg_edges(b):
    base = b.cfg.where("ord < 4").select("function_id", F.col("ord").alias("from_ord"), (F.col("ord") + 1).alias("to_ord"), "kind")
    skip = base.where("from_ord = 2 AND kind = 'branch'").select("function_id", F.lit(1).cast("long").alias("from_ord"),
                                                                 F.lit(3).cast("long").alias("to_ord"))
    return base.drop("kind").unionByName(skip)


def entries(b):
    return b.fn_base.where("local_ix = 0").select("project_id", F.col("function_id").alias("node"))


def stops(b):
    return b.fn_base.where("function_id % 11 = 5").select("project_id", F.col("function_id").alias("node"))


@query("degrees", "SELECT node, in_degree, out_degree FROM deg")
def degrees(b):
    return E.degrees(b.edges)


@query("call_resolution", "SELECT src, dst FROM edges")
def call_resolution(b):
    return E.resolve_calls(b.fn).select("src", "dst")


@query("call_edges", """
    SELECT src, dst, least(a.confidence, c.confidence) AS confidence FROM edges e JOIN facts a ON a.function_id = src JOIN facts c ON c.function_id = dst""")
def call_edges(b):
    f = function_facts(b)
    return E.build_edges(f, E.resolve_calls(b.fn)).select("src", "dst", "confidence")


@query("isolated_nodes", "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def isolated_nodes(b):
    fns = b.customer.select(F.col("c_custkey").alias("function_id"))
    links = b.events.select(F.col("user_id").alias("src"), F.col("user_id").alias("dst"))
    return E.isolated(fns, links).select(F.col("function_id").alias("node"))


@query("terminal_nodes", "SELECT function_id FROM fn_base WHERE function_id NOT IN (SELECT src FROM edges)")
def terminal_nodes(b):
    return E.terminals(b.fn_base, b.edges).select("function_id")


@query("unresolved_calls", """
    SELECT function_id AS src, CASE p_size % 10 WHEN 0 THEN 'eval' WHEN 1 THEN 'run' WHEN 2 THEN 'push' WHEN 3 THEN 'set' WHEN 4 THEN 'query' WHEN 5 THEN 'open'
        WHEN 6 THEN 'if' WHEN 7 THEN 'validate' ELSE 'save' END AS callee FROM fn WHERE p_size % 10 <> 8""")
def unresolved_calls(b):
    return E.unresolved_calls(b.fn).select("src", "callee")


@query("edge_merge", """
    WITH RECURSIVE e AS (SELECT l_suppkey % 20 AS src, l_partkey % 20 AS dst, CAST(l_quantity AS BIGINT) AS volume, l_linenumber = 1 AS primary_edge, l_discount AS confidence,
            row_number() OVER (PARTITION BY l_suppkey % 20, l_partkey % 20 ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS i FROM lineitem),
      f AS (SELECT src, dst, volume, i FROM e WHERE i = 1
            UNION ALL SELECT e.src, e.dst, least(100, greatest(f.volume, e.volume) + 4), e.i FROM f JOIN e ON e.src = f.src AND e.dst = f.dst AND e.i = f.i + 1)
    SELECT a.src, a.dst, a.primary_edge, a.confidence, a.n AS relation_count, f.volume
    FROM (SELECT src, dst, bool_or(primary_edge) AS primary_edge, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY src, dst) a
    JOIN f ON f.src = a.src AND f.dst = a.dst AND f.i = a.n""")
def edge_merge(b):
    e = b.lineitem.select(
        (F.col("l_suppkey") % 20).alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.col("l_quantity").cast("long").alias("volume"),
        (F.col("l_linenumber") == 1).alias("primary"), F.col("l_discount").alias("confidence"), F.lit(1).alias("relation_count"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("ord"))
    return E.merge_edges(e, ["src", "dst"]).select(
        "src", "dst", F.col("primary").alias("primary_edge"), "confidence", "relation_count", F.col("volume").cast("long").alias("volume"))


_REACH = """WITH RECURSIVE r AS (SELECT function_id AS node, 0 AS depth FROM fn_base WHERE {seed}
    UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < {cap}{stop})"""


@query("entry_tree", _REACH.format(seed="local_ix = 0", cap=9, stop="") + " SELECT node, min(depth) AS depth FROM r GROUP BY node")
def entry_tree(b):
    return G.entry_tree(b.edges, entries(b)).select("node", "depth")


@query("reach_with_stops", _REACH.format(seed="local_ix = 0", cap=60, stop=" AND node % 11 <> 5")
       + " SELECT node, min(depth) AS depth, node % 11 = 5 AS stop FROM r GROUP BY node")
def reach_with_stops(b):
    return G.trace(b.edges, entries(b), stops(b)).select("node", "depth", "stop")


@query("impact_nodes", _REACH.format(seed="function_id % 11 = 5", cap=60, stop="") + " SELECT node, min(depth) AS depth FROM r GROUP BY node")
def impact_nodes(b):
    return G.impact(b.edges, stops(b))[0].select("node", "depth")


@query("impact_edges", _REACH.format(seed="function_id % 11 = 5", cap=60, stop="") + " SELECT src, dst FROM edges WHERE src IN (SELECT node FROM r)")
def impact_edges(b):
    return G.impact(b.edges, stops(b))[1].select("src", "dst")


@query("data_flow_order", _REACH.format(seed="local_ix = 0", cap=60, stop="") + """
    SELECT function_id, depth IS NOT NULL AS reachable, depth FROM fn_base LEFT JOIN (SELECT node, min(depth) AS depth FROM r GROUP BY node) ON node = function_id""")
def data_flow_order(b):
    f = b.fn.select("project_id", "function_id", "path", "slot")
    return G.data_flow_order(f, b.edges, entries(b)).select("function_id", "reachable", "depth")


@query("depth_relax", """
    WITH RECURSIVE r AS (SELECT function_id AS node, 0 AS depth, 0 AS step FROM fn_base WHERE local_ix = 0
      UNION SELECT dst, least(9, depth + 1), step + 1 FROM r JOIN edges ON src = node WHERE step < 10)
    SELECT function_id AS node, coalesce(d, CAST(1 + local_ix % 6 AS INT)) AS depth FROM fn_base LEFT JOIN (SELECT node, min(depth) AS d FROM r GROUP BY node) ON node = function_id""")
def depth_relax(b):
    nodes = b.fn_base.select(F.col("function_id").alias("node"), (1 + F.col("local_ix") % 6).cast("int").alias("default_depth"))
    return G.relax_depth(nodes, b.edges, entries(b).select("node", F.lit(0).alias("depth")))


ORACLE_RELATIONS["closure"] = """
    SELECT s, t FROM (WITH RECURSIVE c AS (SELECT src AS s, dst AS t FROM edges UNION SELECT c.s, edges.dst FROM c JOIN edges ON edges.src = c.t) SELECT * FROM c)"""
ORACLE_DEPENDS["closure"] = ("edges",)


@query("cycle_edges", "SELECT src, dst, EXISTS (SELECT 1 FROM closure WHERE s = dst AND t = src) AS is_cycle FROM edges")
def cycle_edges(b):
    return G.cycle_edges(b.edges).select("src", "dst", "is_cycle")


@query("strong_components", """
    SELECT node, least(node, coalesce((SELECT min(a.t) FROM closure a JOIN closure z ON z.s = a.t AND z.t = a.s WHERE a.s = node), node)) AS component
    FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)""")
def strong_components(b):
    return G.strong_components(b.edges)


@query("topological_depth", """
    WITH RECURSIVE comp AS (SELECT node, least(node, coalesce((SELECT min(a.t) FROM closure a JOIN closure z ON z.s = a.t AND z.t = a.s WHERE a.s = node), node)) AS component
        FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)),
      dag AS (SELECT DISTINCT a.component AS s, c.component AS t FROM edges JOIN comp a ON a.node = src JOIN comp c ON c.node = dst WHERE a.component <> c.component),
      lv AS (SELECT DISTINCT component AS n, 0 AS depth FROM comp UNION SELECT t, depth + 1 FROM lv JOIN dag ON s = n)
    SELECT node, max(depth) AS depth FROM comp JOIN lv ON n = component GROUP BY node""")
def topological_depth(b):
    return G.topological_depth(b.edges)


_PATHS = """WITH RECURSIVE p AS (SELECT function_id AS start, function_id AS node, [function_id] AS path FROM fn_base WHERE local_ix < 4
    UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN edges ON src = node WHERE len(path) < 14 AND NOT list_contains(path, dst))"""


@query("path_enum", _PATHS + """ SELECT start, node, array_to_string(path, '>') AS path FROM p WHERE len(path) > 1 AND node % 5 = 4""")
def path_enum(b):
    starts = b.fn_base.where("local_ix < 4").select("project_id", F.col("function_id").alias("node"))
    goals = b.fn_base.where("function_id % 5 = 4").select("project_id", F.col("function_id").alias("node"))
    p = G.expand_paths(b.edges, starts, goals)
    return p.select("start", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("upstream_chain", """
    WITH RECURSIVE u AS (SELECT function_id AS target, function_id AS node, [function_id] AS path FROM fn_base WHERE function_id % 8 = 3
      UNION ALL SELECT target, src, list_append(path, src) FROM u JOIN edges ON dst = node WHERE NOT list_contains(path, src)),
      hit AS (SELECT target, min(len(path)) AS n FROM u WHERE node NOT IN (SELECT dst FROM edges) GROUP BY target)
    SELECT f.function_id AS target, CAST(coalesce(n, 1) AS BIGINT) AS chain_length FROM fn_base f LEFT JOIN hit ON target = f.function_id WHERE f.function_id % 8 = 3""")
def upstream_chain(b):
    t = b.fn_base.where("function_id % 8 = 3").select(F.col("function_id").alias("node"))
    return G.upstream_chain(b.edges, t).select("target", F.size("chain").cast("long").alias("chain_length"))


@query("main_path", _PATHS.replace("local_ix < 4", "local_ix = 1").replace("len(path) < 14", "len(path) < 9") + """
    , best AS (SELECT start, max(len(path)) AS n FROM p GROUP BY start)
    SELECT f.project_id, CASE WHEN count(e.dst) >= 2 THEN CAST(1 + count(e.dst) AS BIGINT) ELSE CAST(max(n) AS BIGINT) END AS path_length
    FROM fn_base f LEFT JOIN edges e ON e.src = f.function_id JOIN best ON best.start = f.function_id WHERE f.local_ix = 1 GROUP BY f.project_id""")
def main_path(b):
    e = b.fn_base.where("local_ix = 1").select("project_id", F.col("function_id").alias("node"))
    return G.main_path(b.edges, e).select("project_id", F.size("path").cast("long").alias("path_length"))


# ---- taint and points-to; the SQL side knows the derived bodies, the Spark side parses them
ORACLE_RELATIONS["san"] = "SELECT *, regexp_matches(name, 'sanitize|validate') AS san, p_size % 4 <> 2 AS has_param FROM facts"
ORACLE_DEPENDS["san"] = ("facts",)
ORACLE_RELATIONS["tmove"] = """
    SELECT cfg.function_id AS fn, uses AS var, cfg.function_id AS to_fn, defs AS to_var,
           san OR contains(uses, 'sanitize') OR contains(defs, 'sanitize') AS clean FROM cfg JOIN san ON san.function_id = cfg.function_id WHERE uses <> '' AND defs <> ''
    UNION ALL SELECT a.function_id, a.arg0, c.function_id, c.arg0, CASE WHEN c.san THEN true END FROM san a JOIN san c ON c.function_id = a.c1 WHERE c.has_param
    UNION ALL SELECT a.function_id, 'first', c.function_id, c.arg0, CASE WHEN c.san THEN true END FROM san a JOIN san c ON c.function_id = a.c2 WHERE c.has_param AND (a.c1 IS NULL OR a.c1 <> a.c2)
    UNION ALL SELECT c.function_id, 'shared_total', a.function_id, 'first', false FROM san a JOIN san c ON c.function_id = a.c1 WHERE NOT c.san
    UNION ALL SELECT c.function_id, 'shared_total', a.function_id, 'second', false FROM san a JOIN san c ON c.function_id = a.c2 WHERE NOT c.san AND (a.c1 IS NULL OR a.c1 <> a.c2)"""
ORACLE_DEPENDS["tmove"] = ("cfg", "san")
ORACLE_RELATIONS["tfact"] = """
    SELECT fn AS function_id, var AS variable, NOT bool_or(exposed) AS sanitized FROM (
        WITH RECURSIVE f AS (
          SELECT function_id AS fn, trim(split_part(p, ':', 1)) AS var, true AS exposed FROM (SELECT function_id, unnest(params) AS p FROM san
             WHERE len(external_inputs) > 0 OR regexp_matches(name || ' ' || array_to_string(params, ' '), '(?i)request|input|stdin|argv|query|param|header|cookie|upload|socket|message|event'))
          UNION SELECT to_fn, to_var, CASE WHEN clean IS NULL THEN exposed ELSE NOT clean END FROM f JOIN tmove ON tmove.fn = f.fn AND tmove.var = f.var)
        SELECT * FROM f) GROUP BY fn, var"""
ORACLE_DEPENDS["tfact"] = ("tmove", "san")


def taint_facts(b):
    return T.taint_fixpoint(function_facts(b), cfg(b), b.edges)[0]


@query("taint_fixpoint", "SELECT function_id, variable, sanitized FROM tfact")
def taint_fixpoint(b):
    return taint_facts(b)


SINK_VERDICT_SQL = """
    SELECT function_id, sink_kind, coalesce(n, 0) AS tainted_variables, CASE WHEN ex THEN 'exposed' WHEN n IS NOT NULL THEN 'sanitized' ELSE 'candidate' END AS status
    FROM (SELECT function_id, CASE WHEN regexp_matches(t, '(?i)execute|query|rawsql|cursor\\.execute') THEN 'sql' WHEN regexp_matches(t, '(?i)exec|spawn|system\\s*\\(|runtime\\.getruntime') THEN 'command'
            WHEN regexp_matches(t, '(?i)writefile|open\\s*\\(|sendfile|path\\.join') THEN 'file' WHEN regexp_matches(t, '(?i)fetch|request|http|socket') THEN 'network'
            WHEN regexp_matches(t, '(?i)innerhtml|render|template') THEN 'dom-template' END AS sink_kind
          FROM (SELECT function_id, name || ' ' || body || ' ' || array_to_string(side_effects, ' ') AS t FROM facts))
    LEFT JOIN (SELECT function_id AS f, count(*) AS n, bool_or(NOT sanitized) AS ex FROM tfact GROUP BY 1) ON f = function_id WHERE sink_kind IS NOT NULL"""


@query("sink_verdict", SINK_VERDICT_SQL)
def sink_verdict(b):
    f = cut(function_facts(b))
    return T.sink_verdicts(f, T.taint_fixpoint(f, cfg(b), b.edges)[0])


ORACLE_RELATIONS["pcopy"] = """
    SELECT DISTINCT * FROM (
      SELECT function_id AS fn, uses AS var, function_id AS to_fn, defs AS to_var FROM cfg WHERE uses <> '' AND defs <> '' AND uses <> defs
      UNION ALL SELECT function_id, 'first', function_id, '$return' FROM fn WHERE p_size % 2 = 0
      UNION ALL SELECT a.function_id, a.arg0, c.function_id, c.arg0 FROM san a JOIN san c ON c.function_id = a.c1 WHERE c.has_param
      UNION ALL SELECT a.function_id, 'first', c.function_id, c.arg0 FROM san a JOIN san c ON c.function_id = a.c2 WHERE c.has_param AND (a.c1 IS NULL OR a.c1 <> a.c2)
      UNION ALL SELECT c1, '$return', function_id, 'first' FROM san WHERE c1 IS NOT NULL
      UNION ALL SELECT c2, '$return', function_id, 'second' FROM san WHERE c2 IS NOT NULL AND (c1 IS NULL OR c1 <> c2))"""
ORACLE_DEPENDS["pcopy"] = ("cfg", "fn", "san")
ORACLE_RELATIONS["pts"] = """
    SELECT fn, var, obj FROM (WITH RECURSIVE p AS (
        SELECT function_id AS fn, trim(split_part(x, ':', 1)) AS var, 'param:' || CAST(function_id AS VARCHAR) || ':' || trim(split_part(x, ':', 1)) AS obj
        FROM (SELECT function_id, unnest(params) AS x FROM san WHERE function_id NOT IN (SELECT dst FROM edges))
        UNION SELECT function_id, arg0, 'heap:' || CAST(function_id AS VARCHAR) || ':' || arg0 || ':0' FROM fn WHERE p_size % 4 = 2
        UNION SELECT to_fn, to_var, obj FROM p JOIN pcopy ON pcopy.fn = p.fn AND pcopy.var = p.var) SELECT * FROM p)"""
ORACLE_DEPENDS["pts"] = ("pcopy", "san", "edges", "fn")


def solution(b):
    return P.points_to(function_facts(b), cfg(b), b.edges)


@query("points_to", "SELECT fn, var, obj FROM pts")
def points_to(b):
    return solution(b)["pts"]


@query("alias_sets", "SELECT obj AS object_id, count(*) AS variables FROM pts GROUP BY obj HAVING count(*) > 1")
def alias_sets(b):
    return P.alias_sets(solution(b))


@query("escaped_objects", "SELECT DISTINCT obj AS object_id FROM pts WHERE var = '$return'")
def escaped_objects(b):
    return P.escapes(solution(b))


@query("ownership_obligations", """
    SELECT o.obj AS object_id, CASE WHEN esc THEN 'escaped-owner' ELSE 'exclusive-owner' END AS kind, CASE WHEN NOT esc AND n = 1 THEN 'proved-by-abstraction' ELSE 'unknown' END AS status
    FROM (SELECT obj, count(*) AS n, bool_or(var = '$return') AS esc FROM pts WHERE starts_with(obj, 'heap:') GROUP BY obj) o""")
def ownership_obligations(b):
    return P.ownership(solution(b))


@query("call_contexts", """
    SELECT CAST(src AS VARCHAR) || '>' || CAST(dst AS VARCHAR) AS context_id, src AS caller, dst AS callee, 1 AS depth FROM edges
    UNION ALL SELECT CAST(a.src AS VARCHAR) || '>' || CAST(a.dst AS VARCHAR) || '>' || CAST(c.src AS VARCHAR) || '>' || CAST(c.dst AS VARCHAR), a.src, c.dst, 2
    FROM edges a JOIN edges c ON a.dst = c.src""")
def call_contexts(b):
    return P.call_contexts(b.edges).drop("inner_id")


@query("context_points_to")
def context_points_to(b):
    f = cut(function_facts(b).select("project_id", "function_id", "name", "params", "body"))
    return P.context_heaps(f, cfg(b), b.edges, P.points_to(f, cfg(b), b.edges))["pts"]


@query("ssa_numbering", """
    SELECT function_id, defs AS variable, ord, row_number() OVER (PARTITION BY function_id, defs ORDER BY ord) AS version FROM cfg WHERE defs <> ''""")
def ssa_numbering(b):
    return P.assignments(cfg(b)).select("function_id", "variable", "ord", "version")


@query("copy_aliases", "SELECT function_id, uses AS owner, defs AS alias FROM cfg WHERE uses <> '' AND defs <> '' AND uses <> defs")
def copy_aliases(b):
    return P.aliases(cfg(b))


@query("phi_candidates", """
    SELECT a.function_id, CAST(3 AS BIGINT) AS block, 'first' AS variable, CAST(2 AS BIGINT) AS inputs FROM cfg a JOIN cfg c ON a.function_id = c.function_id AND c.ord = 2
    WHERE a.ord = 2 AND a.kind = 'branch' AND (SELECT count(*) FROM cfg x WHERE x.function_id = a.function_id AND x.defs = 'first') >= 2""")
def phi_candidates(b):
    return P.phi_candidates(cfg(b), cfg_edges(b))


@query("heap_objects", """
    SELECT 'heap:' || CAST(function_id AS VARCHAR) || ':seed:0' AS object_id, function_id, CAST(0 AS BIGINT) AS release_count FROM fn WHERE p_size % 4 = 2""")
def heap_objects(b):
    return P.heap_objects(cfg(b)).select("object_id", "function_id", "release_count")


ORACLE_RELATIONS["abind"] = """
    SELECT a.function_id AS src, c.function_id AS dst, CAST(0 AS BIGINT) AS position, a.arg0 AS name,
           CASE c.p_size % 4 WHEN 0 THEN 'request: string' WHEN 1 THEN 'value' WHEN 2 THEN 'unknown' ELSE 'payload: string' END AS parameter FROM fn a JOIN fn c ON c.function_id = a.c1
    UNION ALL SELECT a.function_id, c.function_id, 1, '7', CASE c.p_size % 4 WHEN 0 THEN 'limit: number' WHEN 1 THEN 'value' WHEN 2 THEN 'unknown' ELSE 'user' END FROM fn a JOIN fn c ON c.function_id = a.c1
    UNION ALL SELECT a.function_id, c.function_id, 0, 'first', CASE c.p_size % 4 WHEN 0 THEN 'request: string' WHEN 1 THEN 'value' WHEN 2 THEN 'unknown' ELSE 'payload: string' END
    FROM fn a JOIN fn c ON c.function_id = a.c2 WHERE a.c1 IS NULL OR a.c1 <> a.c2"""
ORACLE_DEPENDS["abind"] = ("fn",)


@query("arg_param_binding", "SELECT * FROM abind")
def arg_param_binding(b):
    return binding.bind_arguments(function_facts(b), b.edges).select("src", "dst", "position", "name", "parameter")


@query("call_table", """
    SELECT function_id AS src, callee1 AS callee, 'first' AS assignee, arg0 || '|7' AS args FROM fn WHERE c1 IS NOT NULL
    UNION ALL SELECT function_id, callee2, 'second', 'first' FROM fn WHERE c2 IS NOT NULL AND (c1 IS NULL OR c1 <> c2)""")
def call_table(b):
    return binding.call_table(b.fn).where("assignee IN ('first', 'second')").select(
        "src", "callee", "assignee", F.array_join("args", "|").alias("args"))


@query("dynamic_dispatch", """
    SELECT function_id, CASE p_size % 10 WHEN 1 THEN 'subprocess' WHEN 2 THEN 'queue' WHEN 3 THEN 'cache' ELSE 'db' END AS receiver,
           CASE p_size % 10 WHEN 1 THEN 'run' WHEN 2 THEN 'push' WHEN 3 THEN 'set' ELSE 'query' END AS method, CAST(0 AS BIGINT) AS target_count, 'unresolved' AS status
    FROM fn WHERE p_size % 10 IN (1, 2, 3, 4)""")
def dynamic_dispatch(b):
    return binding.dynamic_dispatch(b.fn).select("function_id", "receiver", "method", "target_count", "status")


@query("guarded_ranges", """
    SELECT function_id, 'first' AS subject, '>=' AS operator, 10.0::DOUBLE AS boundary FROM fn WHERE p_size % 10 = 6""")
def guarded_ranges(b):
    return binding.guarded_ranges(b.fn)


@query("call_range_check", """
    SELECT src, dst, 'ok' AS verdict FROM (SELECT function_id AS src, c1 AS dst FROM fn WHERE c1 IS NOT NULL) JOIN fn c ON c.function_id = dst WHERE c.p_size % 4 = 0 AND dst % 2 = 0
    UNION ALL SELECT src, dst, 'violated' FROM (SELECT function_id AS src, c1 AS dst FROM fn WHERE c1 IS NOT NULL) JOIN fn c ON c.function_id = dst WHERE c.p_size % 4 = 0 AND dst % 2 = 1""")
def call_range_check(b):
    ranges = b.fn_base.select("function_id", F.lit("limit").alias("subject"), F.lit(">=").alias("operator"),
                              F.when(F.col("function_id") % 2 == 0, 5.0).otherwise(8.0).alias("boundary"))
    return binding.check_call_ranges(function_facts(b), b.edges, ranges).select("src", "dst", "verdict")


@query("use_after_consume", """
    SELECT a.function_id AS src, a.c1 AS dst, a.arg0 AS argument,
           regexp_matches(CASE a.p_size % 10 WHEN 8 THEN '' ELSE '' END, 'x') AS used_after
    FROM fn a JOIN fn c ON c.function_id = a.c1 WHERE c.p_size % 6 = 0
    UNION ALL SELECT a.function_id, a.c2, 'first', a.p_size % 2 = 0 FROM fn a JOIN fn c ON c.function_id = a.c2 WHERE c.p_size % 6 = 0 AND (a.c1 IS NULL OR a.c1 <> a.c2)""")
def use_after_consume(b):
    return binding.use_after_consume(b.fn, b.edges, cfg(b))


def edge_items(b, f):
    items = binding.bind_arguments(f, b.edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("items"))
    return b.edges.join(items, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("items", F.lit(0)).alias("items"), (F.col("src") % 7 == 0).alias("observed"),
        F.when(F.col("src") % 7 == 0, "runtime").otherwise("ast").alias("grade"), "confidence")


def paths(b):
    f = cut(function_facts(b))
    facts, _ = T.taint_fixpoint(f, cfg(b), b.edges)
    return T.taint_paths(f, b.edges, T.sink_verdicts(f, facts), edge_items(b, f))


def _cases(pairs, column):
    return " ".join(f"WHEN {sql_rx(column, pattern)} THEN '{kind}'" for kind, pattern in pairs)


_CLEAN = " ".join(
    f"WHEN sink_kind IN ({', '.join(repr(k) for k in kinds)}) THEN {sql_rx('t', in_text)}" + (f" OR {sql_rx('code', in_code)}" if in_code else "")
    for kinds, in_text, in_code in V.PATH_SANITIZERS)
ORACLE_RELATIONS["vdict"] = SINK_VERDICT_SQL
ORACLE_DEPENDS["vdict"] = ("facts", "tfact")
ORACLE_RELATIONS["psrc"] = f"""
    SELECT function_id AS node, CASE {_cases(V.PATH_SOURCES, 't')} WHEN {sql_rx('t', V.PATH_PARAMETER)} OR declared THEN 'parameter' ELSE 'unknown' END AS source_kind
    FROM (SELECT function_id, len(external_inputs) > 0 AS declared, lower(concat_ws(' ', name, summary, array_to_string(external_inputs, ' '), body)) AS t FROM facts)
    WHERE declared OR {sql_rx('t', V.PATH_SOURCE_API)} OR (function_id NOT IN (SELECT dst FROM edges) AND {sql_rx('t', V.PATH_ROOT_INPUT)})"""
ORACLE_DEPENDS["psrc"] = ("facts", "edges")
ORACLE_RELATIONS["psink"] = f"""
    SELECT * FROM (SELECT project_id, function_id AS sink, CASE {_cases(V.PATH_SINKS, 't')} END AS sink_kind
      FROM (SELECT project_id, function_id, lower(concat_ws(' ', name, summary, array_to_string(risks, ' '), array_to_string(side_effects, ' '), body)) AS t FROM facts)) WHERE sink_kind IS NOT NULL"""
ORACLE_DEPENDS["psink"] = ("facts",)
ORACLE_RELATIONS["ppath"] = """
    SELECT psink.project_id, start, sink, source_kind, sink_kind, path FROM (
        WITH RECURSIVE w AS (SELECT node AS start, node, [node] AS path FROM psrc
          UNION ALL SELECT start, dst, list_append(path, dst) FROM w JOIN edges ON src = w.node WHERE len(path) < 14 AND NOT list_contains(path, dst))
        SELECT * FROM w WHERE len(path) > 1) AS walk JOIN psink ON sink = walk.node JOIN psrc ON psrc.node = start"""
ORACLE_DEPENDS["ppath"] = ("psrc", "psink", "edges")
ORACLE_RELATIONS["tpath"] = f"""
    WITH clean AS (SELECT start, path, count(*) FILTER (WHERE CASE {_CLEAN} ELSE nv OR {sql_rx('t', V.PATH_SANITIZER)} END) AS sanitizers
           FROM (SELECT start, path, sink_kind, unnest(path) AS n FROM ppath)
           JOIN (SELECT function_id, len(validations) > 0 AS nv, lower(concat_ws(' ', name, summary, array_to_string(validations, ' '))) AS t, lower(body) AS code FROM facts) ON function_id = n
           GROUP BY start, path),
         item AS (SELECT src, dst, count(*) AS items FROM abind GROUP BY 1, 2),
         hop AS (SELECT start, path, bool_and(coalesce(items, 0) > 0) AS bound, bool_and(edges.src % 7 = 0) AS observed, min(CASE WHEN edges.src % 7 = 0 THEN 4 ELSE 1 END) AS grade_rank, min(confidence) AS conf
           FROM (SELECT start, path, unnest(list_zip(path[1:len(path)-1], path[2:len(path)])) AS e FROM ppath) JOIN edges ON edges.src = e[1] AND edges.dst = e[2]
           LEFT JOIN item ON item.src = edges.src AND item.dst = edges.dst GROUP BY start, path),
         st AS (SELECT ppath.*, sanitizers, grade_rank, least(a.confidence, z.confidence, conf) AS low,
             CASE WHEN v.status = 'exposed' THEN 'exposed' WHEN v.status = 'sanitized' OR sanitizers > 0 THEN 'sanitized' WHEN observed OR bound THEN 'exposed' ELSE 'candidate' END AS status
           FROM ppath JOIN clean USING (start, path) JOIN hop USING (start, path) LEFT JOIN vdict v ON v.function_id = sink
           JOIN facts a ON a.function_id = start JOIN facts z ON z.function_id = sink)
    SELECT project_id, start, sink, source_kind, sink_kind, path, CAST(sanitizers AS BIGINT) AS sanitizers, status, CASE grade_rank WHEN 4 THEN 'runtime' ELSE 'ast' END AS grade,
           CAST(greatest(28, least(100, low - CASE WHEN status = 'candidate' THEN 18 ELSE 0 END)) AS BIGINT) AS confidence FROM st"""
ORACLE_DEPENDS["tpath"] = ("ppath", "abind", "vdict", "facts", "edges")


@query("taint_paths", "SELECT project_id, start, sink, source_kind, sink_kind, array_to_string(path, '>') AS path, sanitizers, status, grade, confidence FROM tpath")
def taint_paths(b):
    p = paths(b)
    return p.select("project_id", "start", "sink", "source_kind", "sink_kind", F.array_join(F.transform(
        "path", lambda x: x.cast("string")), ">").alias("path"), "sanitizers", "status", "grade", "confidence")


@query("exposed_paths", """
    SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, len(path) DESC, path) AS path_rank, start, sink, confidence
    FROM tpath WHERE status = 'exposed' QUALIFY path_rank <= 8""")
def exposed_paths(b):
    return T.exposed_report(paths(b)).select("project_id", "path_rank", "start", "sink", "confidence")


@query("annotated_edges", _PATHS + """
    , h AS (SELECT start % 3 AS r, unnest(list_zip(path[1:len(path)-1], path[2:len(path)])) AS e FROM p WHERE len(path) > 1 AND node % 5 = 4)
    SELECT src, dst, CASE max(CASE r WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) WHEN 3 THEN 'exposed' WHEN 2 THEN 'candidate' WHEN 1 THEN 'sanitized' ELSE 'none' END AS taint_status, count(r) AS path_count
    FROM edges LEFT JOIN h ON e[1] = src AND e[2] = dst GROUP BY src, dst""")
def annotated_edges(b):
    starts = b.fn_base.where("local_ix < 4").select("project_id", F.col("function_id").alias("node"))
    goals = b.fn_base.where("function_id % 5 = 4").select("project_id", F.col("function_id").alias("node"))
    p = G.expand_paths(b.edges, starts, goals).withColumn(
        "status", F.when(F.col("start") % 3 == 0, "exposed").when(F.col("start") % 3 == 1, "candidate").otherwise("sanitized"))
    return T.annotate_edges(b.edges, p).select("src", "dst", "taint_status", "path_count")


@query("security_clauses", """
    SELECT coalesce(s.s_suppkey, l_suppkey) AS function_id, CASE WHEN l_returnflag = 'A' THEN 'exposed' ELSE 'guarded' END AS status,
      CASE l_linestatus WHEN 'F' THEN 'compiler' ELSE 'ast' END AS evidence_grade, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders
    FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_partkey GROUP BY 1, 2, 3""")
def security_clauses(b):
    p = b.lineitem.select(
        F.col("l_partkey").alias("sink"), F.col("l_suppkey").alias("start"), F.col("l_orderkey").alias("path_id"),
        F.when(F.col("l_linestatus") == "F", "runtime").otherwise("ast").alias("grade"), F.when(F.col("l_returnflag") == "A", "exposed").otherwise("guarded").alias("status"),
        F.lit(1).alias("confidence"))
    clauses = T.security_clauses(p, b.supplier.select(F.col("s_suppkey").alias("function_id")))
    return clauses.groupBy("function_id", "status", "evidence_grade").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path_id").alias("orders"))
