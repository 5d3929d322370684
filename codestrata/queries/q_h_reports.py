"""Reports (B18, B48, B49, B53, C25, C27, D04, D05, D07, D12-D14, D27-D29, D34-D42, D44, D47-D49, E09, F05-F07, H14, M09, M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import reports as P
from .facts import flow_nodes, function_facts, sql_flags, sql_rx, with_degrees
from .q_a_text import BASIN_SQL, STAGES_SQL, basin_column, stages
from .registry import query


@query("verb_classes", """
    SELECT function_id, CASE WHEN starts_with(name, 'parse') THEN 'parse' WHEN starts_with(name, 'build') THEN 'assemble' WHEN starts_with(name, 'validate') THEN 'validate'
        WHEN starts_with(name, 'run') THEN 'execute' WHEN starts_with(name, 'load') THEN 'read' WHEN starts_with(name, 'fetch') THEN 'read' WHEN starts_with(name, 'score') THEN 'compute'
        WHEN starts_with(name, 'handle') THEN 'execute' WHEN starts_with(name, 'execute') THEN 'read' WHEN starts_with(name, 'render') THEN 'format' ELSE 'summary' END AS verb FROM fn""")
def verb_classes(b):
    return b.fn.select("function_id", P.verb_class(F.col("name")).alias("verb"))


@query("algorithm_tags", f"""
    WITH t AS (SELECT function_id, {sql_flags([('recursion', 'c1 IS NOT NULL AND function_id % 4 = 0'), *[(n, sql_rx('lower(body)', p)) for n, p in P.ALGORITHM_TAGS.items()]])} AS found, lower(body) AS body FROM fn),
         s AS (SELECT function_id, CASE WHEN regexp_matches(body, 'for\\s*\\(|for\\s+.+\\s+in\\s+|while\\s*\\(') AND NOT list_has_any(found, ['breadth-first', 'depth-first']) THEN list_append(found, 'linear-scan') ELSE found END AS found FROM t)
    SELECT function_id, CASE WHEN len(found) = 0 THEN 'sequential' ELSE array_to_string(found, '|') END AS tags FROM s""")
def algorithm_tags(b):
    # every fourth function goes by the name it calls first, so that it calls itself
    name = F.when(F.col("function_id") % 4 == 0, F.coalesce("callee1", "name")).otherwise(F.col("name"))
    tags = P.algorithm_tags(F.col("body"), P.is_recursive(name, F.col("body")))
    return b.fn.select("function_id", F.array_join(tags, "|").alias("tags"))


@query("structure_tags", """
    SELECT function_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(body), '\\b(map|dict|dictionary|hashmap|record)\\b|\\{\\s*\\w+\\s*:') THEN 'mapping' END,
        CASE WHEN regexp_matches(lower(body), '\\b(set|hashset)\\b') THEN 'set' END, CASE WHEN regexp_matches(lower(body), '\\b(queue|deque|channel)\\b') THEN 'queue' END,
        CASE WHEN regexp_matches(lower(body), '\\b(model|entity|row|session|query)\\b') THEN 'entity' END], lambda x: x IS NOT NULL), '|') AS tags FROM fn""")
def structure_tags(b):
    return b.fn.select("function_id", F.array_join(P.structure_tags(F.col("body")), "|").alias("tags"))


@query("certainty_bands", """
    SELECT function_id, CASE WHEN function_id % 3 = 0 AND confidence >= 88 THEN 'proved' WHEN function_id % 3 = 0 AND confidence >= 72 THEN 'likely' ELSE 'candidate' END AS certainty FROM facts""")
def certainty_bands(b):
    f = function_facts(b)
    src = F.when(F.col("function_id") % 3 == 0, "Parser Fact").otherwise("Heuristic")
    return f.select("function_id", P.certainty(F.when(F.col("function_id") % 3 == 0, "Compiler").otherwise("scan"), src, F.col("confidence"),
                                               F.lit(True), F.lit(True)).alias("certainty"))


_MODULE = " , ".join(
    "(0" + "".join(
        f" + CASE WHEN contains(n, ' {w} ') THEN 18 ELSE 0 END + CASE WHEN contains(p, ' {w} ') THEN 7 ELSE 0 END + CASE WHEN contains(c, ' {w} ') THEN 2 ELSE 0 END" for w in words.split())
    + (f" + CASE WHEN category IN ({', '.join(repr(x) for x in cats)}) THEN 5 ELSE 0 END" if cats else "") + ")"
    for words, cats in P.MODULE_SIGNALS.values())
_W = "trim(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"
MODULE_SQL = f"""SELECT *, CASE WHEN list_max(s) = 0 THEN 'general_processing' ELSE [{', '.join(repr(m) for m in P.MODULE_SIGNALS)}][list_position(s, list_max(s))] END AS module
    FROM (SELECT *, [{_MODULE}] AS s FROM (SELECT *, ' ' || {_W.format(c='name')} || ' ' AS n, ' ' || {_W.format(c='path')} || ' ' AS p,
        ' ' || {_W.format(c="(summary || ' ' || array_to_string(params, ' ') || ' ' || return_type)")} || ' ' AS c FROM facts))"""


@query("module_labels", f"SELECT function_id, module FROM ({MODULE_SQL})")
def module_labels(b):
    return P.module_labels(function_facts(b)).select("function_id", "module")


@query("module_rollup", f"""
    WITH m AS MATERIALIZED (SELECT function_id, project_id, file_id, confidence, module FROM ({MODULE_SQL})),
      x AS MATERIALIZED (SELECT e.project_id, a.module AS ma, c.module AS mb FROM edges e JOIN m a ON a.function_id = src JOIN m c ON c.function_id = dst WHERE a.module <> c.module),
      g AS (SELECT project_id, module, count(*) AS functions, count(DISTINCT file_id) AS files, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS confidence FROM m GROUP BY 1, 2)
    SELECT g.project_id, g.module, functions, files, confidence, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM g
    LEFT JOIN (SELECT project_id, mb, count(*) AS n FROM x GROUP BY 1, 2) i ON i.project_id = g.project_id AND i.mb = g.module
    LEFT JOIN (SELECT project_id, ma, count(*) AS n FROM x GROUP BY 1, 2) o ON o.project_id = g.project_id AND o.ma = g.module""")
def module_rollup(b):
    return P.module_rollup(P.module_labels(function_facts(b)), b.edges)


@query("basin_rollup", f"""
    SELECT project_id, basin, CAST(count(*) AS BIGINT) AS members, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS confidence, bool_or(len(risks) > 0) AS has_risk,
           CASE WHEN count(*) >= 12 THEN 'lake' ELSE 'reservoir' END AS capacity FROM (SELECT *, {BASIN_SQL} AS basin FROM facts) GROUP BY 1, 2""")
def basin_rollup(b):
    return P.basin_rollup(function_facts(b).select("*", basin_column()))


@query("type_conflicts", """
    SELECT p_type AS project_id, name, CAST(count(DISTINCT type) AS BIGINT) AS type_count FROM (SELECT p_type, 'arg' || CAST(p_size % 7 AS VARCHAR) AS name,
        CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'T' || CAST(p_size % 3 AS VARCHAR) END AS type FROM part) GROUP BY 1, 2
    HAVING count(DISTINCT type) > 2 OR (bool_or(type = 'unknown') AND count(DISTINCT type) > 1)""")
def type_conflicts(b):
    k = F.col("p_size")
    f = b.part.select(F.col("p_type").alias("project_id"), F.array(F.concat(
        F.lit("arg"), (k % 7).cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(": T"), (k % 3).cast("string"))))).alias("params"))
    return P.type_conflicts(f)


@query("entry_functions", """
    SELECT project_id, arg_min(function_id, (-score, function_id)) AS function_id, max(score) AS score FROM (SELECT *, CAST(out_degree * 12 - in_degree * 4
        + CASE WHEN regexp_matches(lower(name), '\\b(main|start|run|init|bootstrap|analyze|execute|handler|controller)\\b') THEN 30 ELSE 0 END
        + CASE WHEN len(external_inputs) > 0 THEN 12 ELSE 0 END + CASE WHEN category IN ('input', 'simulate') THEN 8 ELSE 0 END AS BIGINT) AS score FROM factsd) GROUP BY project_id""")
def entry_functions(b):
    return P.entry_functions(with_degrees(function_facts(b), b.edges)).select("project_id", "function_id", "score")


@query("main_files", """
    SELECT source AS project_id, arg_min(doc_id, (-score, doc_id)) AS file_id, max(score) AS score FROM (SELECT source, doc_id, CAST(doc_id % 4 * 3 + CASE WHEN doc_id % 6 = 0 THEN 34 WHEN doc_id % 6 = 1 THEN 8 ELSE 0 END
        + CASE WHEN doc_id % 9 = 0 THEN 18 ELSE 0 END AS BIGINT) AS score FROM documents) GROUP BY source""")
def main_files(b):
    k = F.col("doc_id")
    files = b.documents.select(F.col("source").alias("project_id"), k.alias("file_id"), F.when(k % 6 == 0, "src/main.py").when(
        k % 6 == 1, "package.json").otherwise("x.py").alias("path"), F.when(k % 9 == 0, "bootstrap now").otherwise("nothing").alias("content"))
    fns = files.select("file_id", F.explode(F.sequence(F.lit(0), (F.col("file_id") % 4).cast("int"))).alias("i")).where("i > 0")
    return P.main_files(files, fns)


@query("confluences", f"""
    SELECT function_id, CASE WHEN label = 'lake' THEN 'lake' WHEN in_degree > 1 THEN 'confluence' ELSE 'fork' END AS kind, in_degree + out_degree AS degree,
           CASE risk_level WHEN 'critical' THEN 4 WHEN 'risk' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS risk_weight FROM ({STAGES_SQL}) WHERE in_degree > 1 OR out_degree > 1 OR label = 'lake'""")
def confluences(b):
    return P.confluences(stages(b)).drop("project_id")


@query("stage_summary", f"""
    SELECT project_id, CAST(count(*) AS BIGINT) AS stages, CAST(count(*) FILTER (WHERE label = 'lake') AS BIGINT) AS stores, CAST(count(*) FILTER (WHERE risk_level <> 'none') AS BIGINT) AS risky,
           CAST(count(*) FILTER (WHERE role = 'result') AS BIGINT) AS results FROM ({STAGES_SQL}) GROUP BY project_id""")
def stage_summary(b):
    return P.stage_summary(stages(b))


def map_edges(b):
    return b.edges.select("src", "dst", (F.col("ord") == 0).alias("is_primary"), (F.col("src") % 3).alias("relation_count"),
                          F.when(F.col("dst") % 5 == 0, "Open").when(F.col("dst") % 5 == 1, "Blocked").otherwise("Closed").alias("status"))


@query("issue_edges", "SELECT src, dst FROM edges WHERE ord = 0 AND dst % 5 IN (0, 1)")
def issue_edges(b):
    return P.issue_edges(map_edges(b), True, True).select("src", "dst")


@query("map_overview", """
    WITH k AS (SELECT src, dst FROM edges WHERE ord = 0 OR src % 3 >= 2) SELECT function_id AS node FROM fn_base WHERE function_id IN (SELECT src FROM k UNION SELECT dst FROM k) OR function_id NOT IN (SELECT dst FROM edges)""")
def map_overview(b):
    return P.overview(b.fn_base.select(F.col("function_id").alias("node")), map_edges(b))[0]


@query("project_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring brand#2')")
def project_search(b):
    return P.search(b.part, ["p_name", "p_brand", "p_type"], "Ring BRAND#2").select("p_partkey")


@query("language_histogram", "SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def language_histogram(b):
    return P.histogram(b.documents, ["source"], "lang")


@query("corridors", """
    SELECT l_linenumber % 3 AS src_depth, l_suppkey % 4 AS dst_depth, l_partkey % 2 AS band, CAST(count(*) AS BIGINT) AS members, arg_max(l_orderkey * 10000 + l_partkey, (l_quantity, -(l_orderkey * 10000 + l_partkey))) AS representative
    FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3""")
def corridors(b):
    e = b.lineitem.select((F.col("l_linenumber") % 3).alias("src_depth"), (F.col("l_suppkey") % 4).alias("dst_depth"), (F.col("l_partkey") % 2).alias("band"),
                          (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("edge_id"), F.col("l_quantity").alias("volume"), (F.col("l_returnflag") == "A").alias("is_cycle"))
    return P.corridors(e)


_SEGMENTS = """s AS (SELECT o_custkey % 100 AS map_id, o_orderkey AS id, o_orderkey % 97 AS x1, o_custkey % 89 AS y1, o_orderkey % 97 + o_custkey % 11 AS x2, o_custkey % 89 + o_orderkey % 13 AS y2, o_orderkey % 5000 AS a, 10000 + o_orderkey % 4999 AS b FROM orders),
      o AS (SELECT l.map_id, sign((l.y2 - l.y1) * (r.x1 - l.x2) - (l.x2 - l.x1) * (r.y1 - l.y2)) AS p, sign((l.y2 - l.y1) * (r.x2 - l.x2) - (l.x2 - l.x1) * (r.y2 - l.y2)) AS q,
         sign((r.y2 - r.y1) * (l.x1 - r.x2) - (r.x2 - r.x1) * (l.y1 - r.y2)) AS u, sign((r.y2 - r.y1) * (l.x2 - r.x2) - (r.x2 - r.x1) * (l.y2 - r.y2)) AS v
        FROM s l JOIN s r ON l.map_id = r.map_id AND l.id < r.id AND l.a <> r.a AND l.a <> r.b AND l.b <> r.a AND l.b <> r.b),
      c AS (SELECT map_id, CAST(count(*) AS BIGINT) AS crossings FROM o WHERE p <> q AND u <> v GROUP BY map_id)"""


def _segments(b):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return b.orders.select((c % 100).alias("map_id"), k.alias("seg_id"), (k % 97).alias("x1"), (c % 89).alias("y1"), (k % 97 + c % 11).alias("x2"),
                           (c % 89 + k % 13).alias("y2"), (k % 5000).alias("a"), (10000 + k % 4999).alias("b"))


@query("map_crossings", f"WITH {_SEGMENTS} SELECT map_id, crossings FROM c")
def map_crossings(b):
    return P.crossings(_segments(b), 10.0)


_PLACES = """p AS (SELECT p_partkey % 40 AS map_id, p_partkey AS id, CAST(p_partkey * 7919 % 1511 AS DOUBLE) AS x, CAST(p_size * 37 + p_partkey * 31 % 997 AS DOUBLE) AS y,
      CASE p_size % 5 WHEN 0 THEN 52 WHEN 1 THEN 50 WHEN 2 THEN 42 WHEN 3 THEN 40 ELSE 34 END AS radius, p_brand AS basin, p_type LIKE 'PROMO%' AS agg FROM part)"""


def _places(b):
    k, s = F.col("p_partkey"), F.col("p_size")
    radius = F.when(s % 5 == 0, 52).when(s % 5 == 1, 50).when(s % 5 == 2, 42).when(s % 5 == 3, 40).otherwise(34)
    return b.part.select((k % 40).alias("map_id"), (k * 7919 % 1511).cast("double").alias("x"), (s * 37 + k * 31 % 997).cast("double").alias("y"),
                         radius.alias("radius"), F.col("p_brand").alias("basin"), F.col("p_type").startswith("PROMO").alias("is_aggregate"))


@query("map_overlaps", f"""
    WITH {_PLACES}
    SELECT l.map_id, CAST(count(*) AS BIGINT) AS overlaps FROM p l JOIN p r ON l.map_id = r.map_id AND l.id < r.id
      AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) < (l.radius + r.radius + 10) * (l.radius + r.radius + 10) GROUP BY 1""")
def map_overlaps(b):
    return P.overlaps(_places(b), 32.0)


@query("map_quality", f"""
    WITH {_SEGMENTS}, {_PLACES},
      w AS (SELECT l.map_id, count(*) AS n FROM p l JOIN p r ON l.map_id = r.map_id AND l.id < r.id
        AND (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) < (l.radius + r.radius + 10) * (l.radius + r.radius + 10) GROUP BY 1),
      e AS (SELECT ps AS map_id, count(*) FILTER (WHERE l_quantity > 25) AS prim, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM (SELECT *, l_partkey % 40 AS ps FROM lineitem) GROUP BY 1),
      n AS (SELECT map_id, count(*) AS placed, count(*) FILTER (WHERE agg) AS aggs, count(DISTINCT basin) AS basins FROM p GROUP BY 1),
      q AS (SELECT n.*, coalesce(prim, 0) AS prim, coalesce(bad, 0) AS bad, coalesce(w.n, 0) AS ov, coalesce(crossings, 0) AS cr FROM n LEFT JOIN e USING (map_id) LEFT JOIN w USING (map_id) LEFT JOIN c USING (map_id)),
      z AS (SELECT *, greatest(0, least(100, 94 - ov * 9 - least(18, cr * 2) - greatest(0, 8 - prim) * 2 - greatest(0, placed - 44))) AS score FROM q)
    SELECT map_id, CAST(ov AS BIGINT) AS overlaps, CAST(cr AS BIGINT) AS crossings, CAST(aggs AS BIGINT) AS aggregates, CAST(basins AS BIGINT) AS basins, CAST(prim AS BIGINT) AS primary_channels, CAST(bad AS BIGINT) AS issue_segments,
      CAST(score AS BIGINT) AS readability, CASE WHEN score >= 82 THEN 'clear' WHEN score >= 64 THEN 'usable' ELSE 'untidy' END AS status FROM z""")
def map_quality(b):
    nodes = _places(b)
    edges = b.lineitem.select((F.col("l_partkey") % 40).alias("map_id"), F.when(F.col("l_returnflag") == "R", "Blocked").otherwise("Flowing").alias("status"),
                              (F.col("l_quantity") > 25).alias("primary"))
    return P.map_quality(P.overlaps(nodes, 32.0), P.crossings(_segments(b), 10.0), edges, nodes).select(
        "map_id", "overlaps", "crossings", "aggregates", "basins", "primary_channels", "issue_segments", F.col("readability").cast("long").alias("readability"), "status")


def snapshots(b):
    return b.orders.select(
        (F.col("o_custkey") % 200).alias("group_id"), F.col("o_custkey").alias("project_hash"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "stable").otherwise("draft").alias("status"))


_BASE = """(SELECT *, coalesce(own, anys, anyo) AS baseline_id FROM (SELECT o_orderkey AS snapshot_id,
    (arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS own,
    (arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS anys,
    (arg_max(o_orderkey, (o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS anyo FROM orders))"""


@query("baseline_snapshots", f"SELECT snapshot_id, baseline_id FROM {_BASE}")
def baseline_snapshots(b):
    return P.baseline_snapshots(snapshots(b)).select("snapshot_id", "baseline_id")


def _snap_values(b, p):
    k = F.col("o_orderkey")
    cols = {"vectors": k % 50 + 1, "accepted": k % 30 + 1, "coverage": k % 100, "irrigation": k % 90, "issues": k % 7, "isolated": k % 5}
    return b.orders.select(k.alias("id"), *[v.cast("double").alias(f"{p}_{n}") for n, v in cols.items()],
                           F.array((k % 20).cast("double"), (k % 33).cast("double")).alias(f"{p}_dims"))


@query("snapshot_comparison", f"""
    SELECT snapshot_id, drift, regression, improvement, CASE WHEN regression >= 24 THEN 'regressed' WHEN drift >= 32 THEN 'watch' WHEN improvement >= 12 THEN 'improved' ELSE 'stable' END AS status FROM (
     SELECT snapshot_id, CASE WHEN k IS NULL THEN 0 ELSE CAST(greatest(0, least(100, floor(m * 1.6::DOUBLE + abs(s % 50 - k % 50) / (k % 50 + 1) * 22 + abs(s % 30 - k % 30) / (k % 30 + 1) * 18 + 0.5))) AS BIGINT) END AS drift,
      CASE WHEN k IS NULL THEN 0 ELSE CAST(greatest(0, least(100, floor(greatest(0, k % 100 - s % 100) * 1.8::DOUBLE + greatest(0, k % 90 - s % 90) * 2 + greatest(0, s % 7 - k % 7) * 5 + greatest(0, s % 5 - k % 5) / greatest(1, k % 5) * 18 + 0.5))) AS BIGINT) END AS regression,
      CASE WHEN k IS NULL THEN 0 ELSE CAST(greatest(0, least(100, floor(greatest(0, s % 100 - k % 100) * 1.5::DOUBLE + greatest(0, s % 90 - k % 90) * 1.8::DOUBLE + greatest(0, s % 30 - k % 30) / (k % 30 + 1) * 18 + greatest(0, k % 7 - s % 7) * 5 + 0.5))) AS BIGINT) END AS improvement
     FROM (SELECT *, CASE WHEN len(g) > 0 THEN list_sum(g) / len(g) ELSE 0 END AS m FROM (SELECT snapshot_id, snapshot_id AS s, baseline_id AS k, list_filter([abs(snapshot_id % 20 - baseline_id % 20), abs(snapshot_id % 33 - baseline_id % 33)], lambda x: x >= 4) AS g FROM {_BASE})))""")
def snapshot_comparison(b):
    base = P.baseline_snapshots(snapshots(b)).select("snapshot_id", "baseline_id")
    cur = base.join(_snap_values(b, "c").withColumnRenamed("id", "snapshot_id"), "snapshot_id")
    return P.compare_snapshots(cur, _snap_values(b, "b").withColumnRenamed("id", "baseline_id")).select(
        "snapshot_id", "drift", "regression", "improvement", "status")


@query("capacity_projection", """
    SELECT s_suppkey AS project_id, memory_bytes, cpu_threads, process_count, CASE WHEN free / memory_bytes >= 2 THEN 'comfortable' WHEN free / memory_bytes >= 1.2 THEN 'acceptable' ELSE 'strained' END AS memory_band FROM (
      SELECT s_suppkey, CAST(ceil(220 * 1048576 + sb * 14 + fn * 614400 + ed * 225280 + greatest(pk, 96 * 1048576 + sb * 8 + fn * 184320)) AS BIGINT) AS memory_bytes, CAST(greatest(1, least(16, ceil(1 + fn / 1200 + ed / 3000 + 0.5))) AS BIGINT) AS cpu_threads,
        CAST(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 ELSE least(8, 1 + ceil(fl / 250)) END AS BIGINT) AS process_count, CAST(s_suppkey % 7 + 1 AS BIGINT) * 1073741824 AS free FROM (
        SELECT l_suppkey AS s_suppkey, CAST(sum(l_extendedprice) AS BIGINT) AS sb0, CAST(count(*) AS BIGINT) AS fn, CAST(count(*) * 2 AS BIGINT) AS ed, CAST(count(*) AS BIGINT) AS fl, CAST(count(*) * 1000 AS BIGINT) AS sb, CAST(max(l_partkey) * 100000 AS BIGINT) AS pk FROM lineitem GROUP BY 1))""")
def capacity_projection(b):
    n = F.count(F.lit(1))
    p = b.lineitem.groupBy(F.col("l_suppkey").alias("project_id")).agg(
        n.alias("functions"), (n * 2).alias("edges"), n.alias("files"), (n * 1000).alias("source_bytes"), (F.max("l_partkey") * 100000).alias("peak_memory"))
    p = p.select("*", F.lit(1).alias("run_count"), (F.col("project_id") % 3).alias("processes"), F.lit(0.5).alias("cpu_ratio"), F.lit(8).alias("cpus"),
                 ((F.col("project_id") % 7 + 1) * 1073741824).alias("free_memory"), F.lit(10 ** 12).alias("free_disk"))
    return P.capacity_projection(p).select("project_id", "memory_bytes", "cpu_threads", "process_count", "memory_band")


@query("experiments", """
    SELECT project_id, experiment_kind, run_id, CASE WHEN sandbox_kind = 'none' THEN 'blocked' WHEN status = 'timeout' THEN 'risk' WHEN experiment_kind IN ('fault', 'security') THEN 'watch' WHEN status = 'passed' THEN 'pass' ELSE 'risk' END AS state,
        CASE WHEN experiment_kind = 'baseline' AND status = 'passed' AND sandbox_kind <> 'none' THEN 'verified' ELSE 'observed' END AS claim
    FROM (SELECT * FROM runs WHERE status NOT IN ('unavailable', 'rejected') QUALIFY row_number() OVER (PARTITION BY project_id, experiment_kind ORDER BY started_at DESC, run_id DESC) = 1)""")
def experiments(b):
    return P.experiments(b.runs)


@query("twin_report", """
    SELECT project_id, CAST(count(*) AS BIGINT) AS executed, CAST(count(*) FILTER (WHERE experiment_kind = 'baseline' AND status = 'passed' AND sandbox_kind <> 'none') AS BIGINT) AS verified
    FROM (SELECT * FROM runs WHERE status NOT IN ('unavailable', 'rejected') QUALIFY row_number() OVER (PARTITION BY project_id, experiment_kind ORDER BY started_at DESC, run_id DESC) = 1) GROUP BY project_id""")
def twin_report(b):
    return P.twin_report(P.experiments(b.runs)).drop("at_risk")


@query("test_report", """
    WITH k AS (SELECT project_id, status, started_at, unnest(CASE experiment_kind WHEN 'stress' THEN ['performance', 'load'] WHEN 'baseline' THEN ['functional', 'regression'] ELSE [] END) AS test_kind FROM runs),
      g AS (SELECT project_id, test_kind, count(*) AS samples, count(*) FILTER (WHERE status <> 'passed') AS failures FROM k GROUP BY 1, 2), l AS (SELECT project_id, max(started_at) AS last FROM runs GROUP BY 1)
    SELECT project_id, test_kind, samples, failures, CASE WHEN st = 'passed' AND last < 9800000 THEN 'not-run' ELSE st END AS state FROM (SELECT *, CASE WHEN test_kind = 'load' AND samples < 5 THEN 'blocked' WHEN test_kind = 'regression' AND project_id % 2 = 1 THEN 'blocked'
        WHEN failures > 0 THEN 'failed' ELSE 'passed' END AS st FROM g JOIN l USING (project_id))""")
def test_report(b):
    projects = b.runs.select("project_id").distinct().select("project_id", F.lit(9_800_000).alias("updated_at"), (F.col("project_id") % 2 == 0).alias("has_tests"))
    return P.test_report(b.runs, projects)


@query("readiness", """
    SELECT file_id, CAST(ready AS INT) AS ready_guards, CAST(greatest(8, least(92, 42 + ready * 9 - (CASE WHEN v THEN 0 ELSE 1 END + CASE WHEN r THEN 0 ELSE 1 END) * 10 - (CASE WHEN h THEN 1 ELSE 0 END + CASE WHEN o THEN 1 ELSE 0 END) * 12
        - (CASE WHEN NOT h AND op THEN 1 ELSE 0 END + CASE WHEN v THEN 0 ELSE 1 END + CASE WHEN ug THEN 1 ELSE 0 END) * 5 - st * 4)) AS BIGINT) AS readiness FROM (
      SELECT *, CASE WHEN v THEN 1 ELSE 0 END + CASE WHEN e THEN 1 ELSE 0 END + CASE WHEN o THEN 0 ELSE 1 END + CASE WHEN r THEN 1 ELSE 0 END + CASE WHEN st > 0 OR bl THEN 0 ELSE 1 END AS ready FROM (
        SELECT file_id, bool_or(len(validations) > 0) AS v, bool_or(list_contains(validations, 'exception-handling')) AS e, bool_or(real) AS r, bool_or(list_contains(risks, 'overflow')) AS o,
          bool_or(function_id % 53 = 0 OR list_contains(risks, 'infinite-loop')) AS h, bool_or(status = 'Blocked') AS bl, bool_or(status = 'Open') AS op, count(*) FILTER (WHERE function_id % 53 = 0) AS st,
          bool_or(len(external_inputs) > 0 AND len(validations) = 0) AS ug FROM nodes GROUP BY file_id))""")
def readiness(b):
    return P.readiness(flow_nodes(b).withColumn("is_stop", F.col("function_id") % 53 == 0), ["file_id"]).select("file_id", "ready_guards", "readiness")


@query("certification", """
    SELECT adapter, score, CASE WHEN adapter % 10 = 9 THEN 'missing' WHEN score = 100 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT adapter, CAST(floor((CASE WHEN adapter % 10 = 9 THEN 0 ELSE 1 END + ok + tr + fs + rs + iso) / 6 * 100 + 0.5) AS BIGINT) AS score FROM (
      SELECT user_id AS adapter, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok, CASE WHEN event_id % 5 >= 2 THEN 1 ELSE 0 END AS tr, CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS fs, 1 AS rs, CASE WHEN event_id % 7 > 0 THEN 1 ELSE 0 END AS iso
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1))""")
def certification(b):
    k = F.col("event_id")
    runs = b.events.select(F.col("user_id").alias("adapter"), k.alias("finished_at"), (F.col("event_type") != "error").alias("passed"), (k % 5).alias("trace_count"),
                           (k % 3 > 0).alias("file_seen"), F.lit(True).alias("resources_seen"), (k % 7 > 0).alias("isolated"))
    tools = b.events.select(F.col("user_id").alias("adapter")).distinct().withColumn("available", F.col("adapter") % 10 != 9)
    return P.certify(runs, tools)


@query("speed_options", """
    SELECT project_id, 'cache' AS option, min(function_id) AS target, 'verify-carefully' AS recommendation FROM facts WHERE regexp_matches(body, '(?i)\\bfetch|readFile|query|select|calculate|score\\b') GROUP BY project_id
    UNION ALL SELECT project_id, 'capacity', min(function_id), 'verify' FROM facts WHERE list_contains(risks, 'overflow') GROUP BY project_id""")
def speed_options(b):
    return P.speed_options(function_facts(b)).select("project_id", "option", "target", "recommendation")


@query("explanation_coverage", """
    SELECT project_id, CAST(100 AS BIGINT) AS module_coverage, CAST(floor(count(*) FILTER (WHERE function_id % 7 <> 0) * 100.0 / count(*) + 0.5) AS BIGINT) AS evidence_coverage,
           CAST(floor(count(*) FILTER (WHERE function_id % 4 <> 0) * 100.0 / count(*) + 0.5) AS BIGINT) AS flow_coverage, CAST(count(*) FILTER (WHERE function_id % 3 = 0) AS BIGINT) AS uncertain FROM fn_base GROUP BY project_id""")
def explanation_coverage(b):
    k = F.col("function_id")
    f = b.fn_base.select("project_id", F.lit("m").alias("module"), F.when(k % 7 != 0, "scan").otherwise("").alias("source"), (k % 4 != 0).alias("reachable"),
                         F.when(k % 3 == 0, "candidate").otherwise("likely").alias("certainty"))
    return P.explanation_coverage(f)


@query("completion", """
    SELECT project_id, overall, conformance, CASE WHEN overall >= 80 THEN 'release' WHEN overall >= 60 THEN 'beta' WHEN overall >= 40 THEN 'alpha' ELSE 'seed' END AS stage FROM (
      SELECT l_orderkey AS project_id, CAST(floor(sum(p * w) / sum(w) + 0.5) AS BIGINT) AS overall, CAST(floor(avg(p) + 0.5) AS BIGINT) AS conformance FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 2 AS p,
        CASE l_linenumber WHEN 1 THEN 9 WHEN 2 THEN 15 WHEN 3 THEN 11 WHEN 4 THEN 8 ELSE 6 END AS w FROM lineitem) GROUP BY l_orderkey)""")
def completion(b):
    k = F.col("l_linenumber")
    areas = b.lineitem.select(F.col("l_orderkey").alias("project_id"), (F.col("l_quantity").cast("long") * 2).alias("percent"), F.when(k == 1, "workspace").when(
        k == 2, "parser").when(k == 3, "knowledge").when(k == 4, "twin").otherwise("product").alias("area"))
    return P.completion(areas)


@query("layer_coverage", """
    SELECT layer, tables, row_count, coverage, CASE WHEN coverage >= 72 THEN 'active' WHEN coverage >= 42 THEN 'seeded' ELSE 'missing' END AS status FROM (
      SELECT lang AS layer, CAST(count(*) AS BIGINT) AS tables, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, CAST(least(100, floor(count(*) FILTER (WHERE documents.doc_id % 3 > 0) / count(*) * 54 + least(1, coalesce(sum(n), 0) / (count(*) * 3)) * 46 + 0.5)) AS BIGINT) AS coverage
      FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = documents.doc_id GROUP BY lang)""")
def layer_coverage(b):
    cat = b.documents.select(F.col("lang").alias("layer"), F.col("doc_id").alias("table_name"), F.when(F.col("doc_id") % 3 > 0, "seeded").otherwise("missing").alias("maturity"))
    rows = b.labels.groupBy(F.col("doc_id").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))
    return P.layer_coverage(cat, rows)


@query("query_panel", """
    WITH a AS (SELECT project_id, count(*) FILTER (WHERE len(external_inputs) > 0 AND len(validations) = 0) AS unvalidated_inputs, count(*) FILTER (WHERE len(risks) > 0) AS risky_functions,
        count(*) FILTER (WHERE in_degree + out_degree = 0) AS isolated_functions, count(*) FILTER (WHERE status IN ('Open', 'Blocked', 'Overflow Risk')) AS problem_nodes, count(*) FILTER (WHERE confidence < 70) AS low_confidence, max(complexity) AS max_complexity FROM nodes GROUP BY 1)
    SELECT project_id, name, CAST(value AS BIGINT) AS value, CASE WHEN name = 'problem_nodes' THEN CASE WHEN value >= 5 THEN 'high' WHEN value >= 2 THEN 'medium' ELSE 'low' END WHEN name = 'low_confidence' THEN CASE WHEN value >= 6 THEN 'high' WHEN value >= 2 THEN 'medium' ELSE 'low' END
        WHEN name = 'max_complexity' THEN CASE WHEN value >= 8 THEN 'high' WHEN value >= 5 THEN 'medium' ELSE 'low' END ELSE 'info' END AS severity
    FROM (UNPIVOT a ON unvalidated_inputs, risky_functions, isolated_functions, problem_nodes, low_confidence, max_complexity INTO NAME name VALUE value)""")
def query_panel(b):
    return P.query_panel(flow_nodes(b), b.edges)


@query("table_counts", """
    SELECT project_id, row_count, table_name FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS row_count, 'functions' AS table_name FROM fn_base GROUP BY 1 UNION ALL SELECT project_id, CAST(count(*) AS BIGINT), 'edges' FROM edges GROUP BY 1)""")
def table_counts(b):
    return P.table_counts({"functions": b.fn_base, "edges": b.edges})


@query("evidence_batches", """
    SELECT batch, accepted, isolated, quality, CASE WHEN isolated * 4 > accepted + isolated THEN 'blocked' WHEN isolated > 0 THEN 'guarded' ELSE 'hydrated' END AS state FROM (SELECT l_suppkey % 10 AS batch, CAST(count(*) FILTER (WHERE l_discount < 0.08) AS BIGINT) AS accepted,
        CAST(count(*) FILTER (WHERE l_discount >= 0.08) AS BIGINT) AS isolated, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS quality FROM lineitem GROUP BY 1)""")
def evidence_batches(b):
    return P.evidence_batches(b.lineitem.select((F.col("l_suppkey") % 10).alias("batch"), (F.col("l_discount") < 0.08).alias("accepted"), F.col("l_quantity").alias("quality")))


@query("dimension_maturity", """
    SELECT dimension, evidence, eligible, passed_eligible, static_passed, score, CASE WHEN score >= 82 AND passed_eligible >= 12 THEN 'mature' WHEN score >= 55 THEN 'candidate' ELSE 'seed' END AS stage FROM (
      SELECT *, CAST(least(100, floor(least(60, passed_eligible * 4.0) + least(20, static_passed * 0.5) + least(20, evidence * 0.1) + 0.5)) AS BIGINT) AS score FROM (
        SELECT user_id % 14 AS dimension, CAST(count(*) AS BIGINT) AS evidence, CAST(count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase')) AS BIGINT) AS eligible,
          CAST(count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase') AND event_id % 9 = 0) AS BIGINT) AS passed_eligible, CAST(count(*) FILTER (WHERE event_type = 'signup' AND event_id % 9 = 0) AS BIGINT) AS static_passed FROM events GROUP BY 1))""")
def dimension_maturity(b):
    t = F.col("event_type")
    e = b.events.select((F.col("user_id") % 14).alias("dimension"), F.when(t == "view", "runtime").when(t == "click", "benchmark").when(t == "purchase", "repair").when(
        t == "signup", "static").otherwise("candidate").alias("level"), (F.col("event_id") % 9 == 0).alias("passed"))
    return P.maturity(e)


@query("stress_scores", """
    SELECT l_suppkey AS suite, CAST(floor(sum(CAST(l_quantity AS BIGINT) * 2 * l_linenumber) / sum(l_linenumber) + 0.5) AS BIGINT) AS overall, CAST(count(*) FILTER (WHERE CAST(l_quantity AS BIGINT) * 2 >= 70) AS BIGINT) AS passed FROM lineitem GROUP BY 1""")
def stress_scores(b):
    return P.stress_score(b.lineitem.select(F.col("l_suppkey").alias("suite"), (F.col("l_quantity").cast("long") * 2).alias("score"), F.col("l_linenumber").alias("weight")))


@query("stage_lookup", f"SELECT function_id, role AS stage_role, language AS file_language FROM ({STAGES_SQL})")
def stage_lookup(b):
    f = function_facts(b).select("function_id", "file_id")
    files = b.fn.groupBy("file_id").agg(F.first("language").alias("language"))
    return P.stage_lookup(f, stages(b), files).select("function_id", "stage_role", "file_language")


_ENTRY_KINDS = ("version_constraint", "sdk_api", "fault_sample", "benchmark", "repair_recipe", "environment", "hardware", "library_entry")
_ENTRY_SQL = "CASE (l_orderkey + l_suppkey * l_linenumber) % 40 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ENTRY_KINDS)) + " ELSE 'other' END"


@query("data_quality", f"""
    WITH e AS (SELECT l_suppkey AS library_id, {_ENTRY_SQL} AS kind FROM lineitem),
         c AS (SELECT library_id, CAST(floor((least(100, count(*) FILTER (WHERE kind = 'version_constraint') / 18 * 100) + least(100, count(*) FILTER (WHERE kind = 'sdk_api') / 18 * 100)
             + least(100, count(*) FILTER (WHERE kind = 'fault_sample') / 20 * 100) + least(100, count(*) FILTER (WHERE kind = 'benchmark') / 16 * 100)
             + least(100, count(*) FILTER (WHERE kind = 'repair_recipe') / 16 * 100) + least(100, count(*) FILTER (WHERE kind = 'environment') / 10 * 100)
             + least(100, count(*) FILTER (WHERE kind = 'hardware') / 10 * 100)) / 7 + 0.5::DOUBLE) AS BIGINT) AS coverage,
             CASE WHEN bool_or(kind = 'benchmark') THEN 44 ELSE 0 END AS b, CASE WHEN bool_or(kind = 'repair_recipe') THEN 22 ELSE 0 END AS r FROM e GROUP BY 1)
    SELECT library_id, coverage, score, CASE WHEN score >= 82 THEN 'validated' WHEN score >= 55 THEN 'reviewable' ELSE 'seed' END AS status FROM (
      SELECT *, CAST(floor(coverage * 0.34::DOUBLE + 42 * 0.2::DOUBLE + 24 * 0.12::DOUBLE + b * 0.14::DOUBLE + r * 0.12::DOUBLE + 30 * 0.08::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score FROM c)""")
def data_quality(b):
    from ..operators.rules import data_quality as quality

    entries = b.lineitem.select(F.col("l_suppkey").alias("library_id"), F.expr(_ENTRY_SQL).alias("kind"))
    return quality(entries).select("library_id", "coverage", "score", "status")


_SCENARIOS = (
    ("s1", "runtime", "view", ("Trace A", "seven")), ("s2", "security", "click", ("trace n", "acct 1", "none")),
    ("s3", "repair", "purchase", ()), ("s4", "runtime", "error", ("acct",)))
_PROJECT_TEXT = "'Project of nation ' || CAST(s_nationkey AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN ' ACCT 1' ELSE ' seven' END"
_DIM_SQL = "CASE l_returnflag WHEN 'A' THEN 'runtime' WHEN 'N' THEN 'security' ELSE 'repair' END"


@query("scenario_coverage", f"""
    WITH s AS (SELECT * FROM (VALUES ('s1', 'runtime', 'view', ['trace a', 'seven']), ('s2', 'security', 'click', ['trace n', 'acct 1', 'none']),
           ('s3', 'repair', 'purchase', CAST([] AS VARCHAR[])), ('s4', 'runtime', 'error', ['acct'])) AS t(sid, dim, tab, required)),
         p AS (SELECT s_suppkey AS project_id, lower({_PROJECT_TEXT}) AS t FROM supplier),
         v AS (SELECT user_id % 120 + 1 AS project_id, event_type AS tab, value / 100 >= 0.48 AS runtime, (event_id % 100) / 100 >= 0.48 AS security FROM events),
         e AS (SELECT l_suppkey AS project_id, 's' || CAST(l_linenumber AS VARCHAR) AS sid, {_DIM_SQL} AS dim, l_linestatus = 'F' AS passed, l_quantity > 25 AS eligible,
                 CAST(l_quantity AS BIGINT) AS confidence, lower('Trace ' || l_returnflag) AS t FROM lineitem),
         vc AS (SELECT p.project_id, s.sid, count(v.tab) AS n FROM p CROSS JOIN s LEFT JOIN v ON v.project_id = p.project_id
                 AND (v.tab = s.tab OR (s.dim = 'runtime' AND v.runtime) OR (s.dim = 'security' AND v.security)) GROUP BY 1, 2),
         ec AS (SELECT p.project_id, s.sid, count(*) FILTER (WHERE e.passed) AS checked, count(*) FILTER (WHERE e.passed AND e.eligible) AS mature,
                 coalesce(avg(e.confidence) FILTER (WHERE e.passed), 0) AS c, coalesce(list(DISTINCT e.t) FILTER (WHERE e.t IS NOT NULL), []) AS texts
                 FROM p CROSS JOIN s LEFT JOIN e ON e.project_id = p.project_id AND (e.sid = s.sid OR e.dim = s.dim) GROUP BY 1, 2),
         h AS (SELECT p.project_id, s.sid, s.dim, len(list_filter(required, lambda w: contains(p.t, w) OR len(list_filter(texts, lambda x: contains(x, w))) > 0)) AS hits,
                 n, checked, mature, c, CASE WHEN tab = 'view' THEN p.project_id % 101 WHEN tab = 'error' THEN 100 ELSE 0 END AS ready
                 FROM p CROSS JOIN s JOIN vc ON vc.project_id = p.project_id AND vc.sid = s.sid JOIN ec ON ec.project_id = p.project_id AND ec.sid = s.sid)
    SELECT project_id, sid AS scenario_id, dim AS dimension, n AS vector_count, hits AS required_hits, checked, mature, coverage,
           CASE WHEN coverage >= 82 AND mature > 0 THEN 'passed' WHEN coverage >= 58 THEN 'ready' ELSE 'blocked' END AS status
    FROM (SELECT *, CAST(greatest(0, least(100, floor(ready * 0.28::DOUBLE + least(100, n * 8) * 0.22::DOUBLE + least(100, hits * 34) * 0.18::DOUBLE + c * 0.32::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS coverage FROM h)""")
def scenario_coverage(b):
    projects = b.supplier.select(F.col("s_suppkey").alias("project_id"), F.expr(_PROJECT_TEXT).alias("text"))
    ready = projects.select("project_id", F.inline(F.array(
        F.struct(F.lit("view").alias("source_table"), (F.col("project_id") % 101).alias("readiness")),
        F.struct(F.lit("error").alias("source_table"), F.lit(100).cast("long").alias("readiness")))))
    vectors = b.events.select(
        (F.col("user_id") % 120 + 1).alias("project_id"), F.col("event_type").alias("source_table"),
        F.create_map(F.lit("runtime"), F.col("value") / 100, F.lit("security"), (F.col("event_id") % 100) / 100).alias("dims"))
    evidence = b.lineitem.select(
        F.col("l_suppkey").alias("project_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("scenario_id"),
        F.expr(_DIM_SQL).alias("dimension"), (F.col("l_linestatus") == "F").alias("passed"), (F.col("l_quantity") > 25).alias("eligible"),
        F.col("l_quantity").cast("long").alias("confidence"), F.concat(F.lit("Trace "), "l_returnflag").alias("text"))
    return P.scenario_coverage(projects, _SCENARIOS, ready, vectors, evidence)
