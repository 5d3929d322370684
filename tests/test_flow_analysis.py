"""Taint, points-to, races and paths on small hand-built programs."""

from pyspark.sql import functions as F

from codestrata.operators import concurrency, graph, pointsto, taint

FN = ("function_id string, project_id int, name string, params array<string>, body string, external_inputs array<string>, "
      "validations array<string>, side_effects array<string>")
CFG = ("function_id string, ord int, kind string, defs array<string>, uses array<string>, ownership string, concurrency string")
EDGE = "project_id int, src string, dst string"


def fn(spark, *rows):
    return spark.createDataFrame([(i, 0, n, p, b, x, v, []) for i, n, p, b, x, v in rows], FN)


def pts(solution):
    out = {}
    for r in solution["pts"].collect():
        out.setdefault((r["fn"], r["var"]), set()).add(r["obj"])
    return out


def test_points_to_through_call(spark):
    functions = fn(
        spark, ("c", "caller", [], "x = open('f')\ny = identity(x)\n", [], []), ("i", "identity", ["p"], "return p\n", [], []))
    cfg = spark.createDataFrame([("c", 0, "statement", ["x"], [], "open", "")], CFG)
    s = pointsto.points_to(functions, cfg, spark.createDataFrame([(0, "c", "i")], EDGE))
    found = pts(s)
    heap = {"heap:c:x:0"}
    assert found[("c", "x")] == heap and found[("i", "p")] == heap and found[("c", "y")] == heap
    assert s["converged"]
    sets = {r["object_id"]: r["variables"] for r in pointsto.alias_sets(s).collect()}
    assert sets["heap:c:x:0"] >= 3
    assert {r["object_id"] for r in pointsto.escapes(s).collect()} == heap


def test_container_slots_and_fields_stay_apart(spark):
    body = "list[0] = a\nlist[1] = b\nx = list[0]\nholder.left = a\nholder.right = b\ny = holder.left\n"
    functions = fn(spark, ("f", "f", ["list", "a", "b", "holder"], body, [], []))
    cfg = spark.createDataFrame([("f", 0, "entry", [], [], "", "")], CFG)
    s = pointsto.points_to(functions, cfg, spark.createDataFrame([], EDGE))
    found = pts(s)
    assert found[("f", "x")] == {"param:f:a"} and found[("f", "y")] == {"param:f:a"}
    heap = {(r["slot"], r["obj"]) for r in s["heap"].collect()}
    assert ("[0]", "param:f:a") in heap and ("[1]", "param:f:b") in heap and (".right", "param:f:b") in heap


def test_context_heaps_keep_call_sites_apart(spark):
    functions = fn(
        spark, ("a", "a", ["x"], "r = same(x)\n", [], []), ("b", "b", ["z"], "r = same(z)\n", [], []), ("s", "same", ["p"], "return p\n", [], []))
    cfg = spark.createDataFrame([("s", 0, "entry", [], [], "", "")], CFG)
    edges = spark.createDataFrame([(0, "a", "s"), (0, "b", "s")], EDGE)
    s = pointsto.points_to(functions, cfg, edges)
    assert pts(s)[("s", "p")] == {"param:a:x", "param:b:z"}
    ctx = pts(pointsto.context_heaps(functions, cfg, edges, s))
    assert ctx[("a>s", "p")] == {"param:a:x"} and ctx[("b>s", "p")] == {"param:b:z"}


def test_contexts_take_over_the_constraints(spark, monkeypatch):
    functions = fn(spark, ("a", "a", ["x"], "r = same(x)\n", [], []), ("s", "same", ["p"], "return p\n", [], []))
    cfg = spark.createDataFrame([("s", 0, "entry", [], [], "", "")], CFG)
    edges = spark.createDataFrame([(0, "a", "s")], EDGE)
    s = pointsto.points_to(functions, cfg, edges)
    made = []
    monkeypatch.setattr(pointsto, "constraints", lambda *_: made.append(1))
    assert pts(pointsto.context_heaps(functions, cfg, edges, s))[("a>s", "p")] == {"param:a:x"}
    assert not made


def test_taint_crosses_calls_and_sanitizers_hold(spark):
    functions = fn(
        spark, ("r", "read_request", ["request"], "dangerous(request)\nclean(request)\n", ["external-input"], []),
        ("d", "dangerous", ["value"], "exec(value)\n", [], []), ("s", "sanitize_clean", ["value"], "", [], []),
        ("k", "clean", ["value"], "exec(value)\n", [], []))
    cfg = spark.createDataFrame([("r", 0, "entry", [], [], "", "")], CFG)
    edges = spark.createDataFrame([(0, "r", "d"), (0, "r", "k")], EDGE)
    facts, info = taint.taint_fixpoint(functions, cfg, edges)
    got = {(r["function_id"], r["variable"]): r["sanitized"] for r in facts.collect()}
    assert got == {("r", "request"): False, ("d", "value"): False, ("k", "value"): False} and info["converged"]
    status = {r["function_id"]: r["status"] for r in taint.sink_verdicts(functions, facts).collect()}
    assert status["d"] == "exposed" and "s" not in status


def test_taint_chain_longer_than_plain_rounds(spark):
    n = 60
    ids = spark.range(n).withColumnRenamed("id", "i")
    name = F.concat(F.lit("f"), F.col("i").cast("string"))
    functions = ids.select(
        F.col("i").alias("function_id"), F.lit(0).alias("project_id"), name.alias("name"), F.array(F.lit("v")).alias("params"),
        F.concat(F.lit("r = f"), (F.col("i") + 1).cast("string"), F.lit("(v)\nreturn r")).alias("body"),
        F.when(F.col("i") == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("external_inputs"),
        F.array().cast("array<string>").alias("validations"), F.array().cast("array<string>").alias("side_effects"))
    cfg = functions.select("function_id", F.lit(0).alias("ord"), F.lit("return").alias("kind"), F.array().cast("array<string>").alias("defs"),
                           F.array(F.lit("r")).alias("uses"), F.lit("").alias("ownership"), F.lit("").alias("concurrency"))
    edges = ids.where(f"i < {n - 1}").select(F.lit(0).alias("project_id"), F.col("i").alias("src"), (F.col("i") + 1).alias("dst"))
    facts, info = taint.taint_fixpoint(functions, cfg, edges)
    assert facts.where("variable = 'v'").count() == n and info["converged"] and info["rounds"] < n


RACE = "function_id string, ord int, reads array<string>, writes array<string>, locks array<string>, atomic boolean"


def test_race_needs_missing_lock(spark):
    rows = [("open", 1, [], ["shared"], [], False), ("open", 2, ["shared"], [], [], False),
            ("held", 1, [], ["shared"], ["m"], False), ("held", 2, ["shared"], [], ["m"], False)]
    events = spark.createDataFrame(rows, RACE)
    pairs = [tuple(r) for r in concurrency.race_pairs(events).collect()]
    assert pairs == [("open", 1, 2, "shared")]
    assert [r["primitive"] for r in concurrency.sync_edges(events).collect()] == ["m"]


GRAPH = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 3, 4), (0, 4, 5), (0, 6, 5), (0, 5, 7), (0, 7, 5)]


def brute_paths(edges, starts, goals, limit):
    out, stack = set(), [(s,) for s in starts]
    while stack:
        path = stack.pop()
        if len(path) > 1 and path[-1] in goals:
            out.add(path)
        if len(path) < limit:
            stack += [(*path, d) for _, s, d in edges if s == path[-1] and d not in path]
    return out


def test_paths_match_brute_force(spark):
    edges = spark.createDataFrame([(*e, i) for i, e in enumerate(GRAPH)], "project_id int, src int, dst int, ord int")
    node = lambda xs: spark.createDataFrame([(0, x) for x in xs], "project_id int, node int")
    got = {tuple(r["path"]) for r in graph.expand_paths(edges, node([1, 6]), node([5, 7]), 6).collect()}
    assert got == brute_paths(GRAPH, [1, 6], {5, 7}, 6)


def test_components_match_mutual_reachability(spark):
    edges = spark.createDataFrame(GRAPH, "project_id int, src int, dst int")
    nodes = {x for _, a, b in GRAPH for x in (a, b)}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for _, a, b in GRAPH:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    assert {r["node"]: r["component"] for r in graph.strong_components(edges).collect()} == want


def test_taint_paths_status(spark):
    cols = "function_id int, project_id int, name string, params array<string>, body string, summary string, external_inputs array<string>, " \
           "validations array<string>, side_effects array<string>, risks array<string>, outputs array<string>, return_type string, confidence long"
    rows = [
        (1, 0, "handle", ["request"], "step(request)", "handle request", ["external-input"], [], [], [], ["x"], "x", 80),
        (2, 0, "step", ["v"], "exec(v)", "step v", [], [], [], ["command-execution"], ["x"], "x", 70),
        (3, 0, "guard", ["v"], "exec(v)", "guard validate v", [], ["input-validation"], [], ["command-execution"], ["x"], "x", 90)]
    functions = spark.createDataFrame(rows, cols)
    edges = spark.createDataFrame([(0, 1, 2, 0), (0, 1, 3, 1)], "project_id int, src int, dst int, ord int")
    items = spark.createDataFrame([(1, 2, 1, True, "runtime", 75), (1, 3, 0, False, "ast", 60)],
                                  "src int, dst int, items int, observed boolean, grade string, confidence long")
    verdicts = spark.createDataFrame([], "function_id int, sink_kind string, tainted_variables long, status string")
    got = {r["sink"]: (r["status"], r["grade"], r["confidence"]) for r in taint.taint_paths(functions, edges, verdicts, items).collect()}
    assert got == {2: ("exposed", "runtime", 70), 3: ("sanitized", "ast", 60)}


