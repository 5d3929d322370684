"""Taint: variable-level fixpoint, source-to-sink paths, edge annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import taint as T, text
from ..functions.common import round_half_up
from ..session import cut
from .binding import argument_pairs, edge_calls
from .graph import expand_paths

PLAIN_ROUNDS = 4
COMPACT_EVERY = 6


def flow_rules(functions: DataFrame, cfg: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Everything the fixpoint needs, as plain tables.

    seeds ``fn, var``: parameters of source functions.
    moves ``fn, var, to_fn, to_var, clean``: a tainted left side taints the right side; ``clean`` steps sanitize it.
    keeps is part of moves with ``clean = null``: the sanitized state carries over unchanged.
    returns ``fn, var``: variables whose taint makes the function's result tainted.
    results ``callee, to_fn, to_var, clean``: assignees of calls.
    """
    # read several times below: evaluate the facts once
    functions = cut(functions.select("project_id", "function_id", "name", "params", "body", "external_inputs", "validations"))
    f = functions.select(
        "function_id", "params", T.is_variable_source(F.col("name"), F.col("external_inputs"), F.col("params")).alias("_src"),
        T.is_variable_sanitizer(F.col("name"), F.col("validations")).alias("sanitizer"))
    seeds = f.where("_src").select(
        F.col("function_id").alias("fn"), F.explode(F.transform("params", text.variable_name)).alias("var")).where("var <> ''")
    marks = f.select("function_id", "sanitizer")
    nodes = cfg.join(marks, "function_id").select(
        "function_id", "kind", "defs", "uses", "sanitizer", T.statement_sanitizes(F.col("uses"), F.col("defs")).alias("_own"))
    local = nodes.select(
        F.col("function_id").alias("fn"), F.explode("uses").alias("var"), F.col("function_id").alias("to_fn"), "defs",
        (F.col("sanitizer") | F.col("_own")).alias("clean")).select("fn", "var", "to_fn", F.explode("defs").alias("to_var"), "clean")
    returns = nodes.where("kind = 'return' AND NOT sanitizer").select(
        F.col("function_id").alias("fn"), F.explode("uses").alias("var")).distinct()
    calls = cut(edge_calls(functions, edges).select("src", "dst", "params", "assignee", "args"))  # read twice below
    targets = marks.select(F.col("function_id").alias("dst"), F.col("sanitizer").alias("_s"))
    passed = argument_pairs(calls).join(targets, "dst").select(
        F.col("src").alias("fn"), F.col("variable").alias("var"), F.col("dst").alias("to_fn"),
        F.col("parameter").alias("to_var"), F.when(F.col("_s"), True).cast("boolean").alias("clean"))
    results = calls.where("assignee IS NOT NULL").join(targets, "dst").select(
        F.col("dst").alias("callee"), F.col("src").alias("to_fn"), F.col("assignee").alias("to_var"), F.col("_s").alias("clean"))
    return seeds, local.unionByName(passed), returns, results.distinct()


def taint_fixpoint(functions: DataFrame, cfg: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, dict]:
    """Tainted variables and whether every way of tainting them is sanitized.

    A variable is a fact as soon as any rule reaches it; it counts as exposed when one rule reaches it unsanitized.
    Both parts only ever grow, so each round joins the facts that are new or newly exposed with the rules.  When the
    facts are still moving after ``PLAIN_ROUNDS``, chains of forced steps are shortened by pointer doubling, which
    brings the number of further rounds near the logarithm of the longest call chain.  Without ``max_rounds`` the rounds
    go on until no fact moves; with it, ``converged`` tells whether they got there.
    """
    seeds, moves, returns, results = flow_rules(functions, cfg, edges)
    # a step whose clean flag is false exposes the target whatever its source is; null hands the state over
    # the result of a call is one more move: from the callee's returned variables to the assignee
    through = returns.withColumnRenamed("fn", "callee").join(results, "callee").select(
        F.col("callee").alias("fn"), "var", "to_fn", "to_var", "clean")
    moves = cut(moves.unionByName(through).distinct())
    facts = cut(seeds.distinct().withColumn("exposed", F.lit(True)))
    rules, delta, rounds, converged = moves, facts, 0, False
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        if rounds == PLAIN_ROUNDS + 1:
            rules, delta = cut(moves.unionByName(shorten_copies(moves)).distinct()), facts
        # two hops per round: the fixed cost of a round is paid half as often, the fixpoint is the same
        near = _hop(delta, rules)
        arriving = near.unionByName(_hop(near, rules)).groupBy("fn", "var").agg(F.bool_or("exposed").alias("exposed"))
        known = facts.groupBy("fn", "var").agg(F.bool_or("exposed").alias("_old"))
        delta = cut(arriving.join(known, ["fn", "var"], "left").where(
            F.col("_old").isNull() | (F.col("exposed") & ~F.col("_old"))).select("fn", "var", "exposed"))
        if delta.isEmpty():
            converged = True
            break
        facts = facts.unionByName(delta)
        if rounds % COMPACT_EVERY == 0:
            facts = cut(facts.groupBy("fn", "var").agg(F.bool_or("exposed").alias("exposed")))
    final = facts.groupBy("fn", "var").agg(F.bool_or("exposed").alias("exposed"))
    out = final.select(F.col("fn").alias("function_id"), F.col("var").alias("variable"), (~F.col("exposed")).alias("sanitized"))
    return out, {"rounds": rounds, "converged": converged}


def _hop(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts one rule away; a neutral rule hands the state over, the others set it."""
    moved = facts.join(rules, ["fn", "var"]).select(
        F.col("to_fn").alias("fn"), F.col("to_var").alias("var"),
        F.when(F.col("clean").isNull(), F.col("exposed")).otherwise(~F.col("clean")).alias("exposed"))
    return moved.groupBy("fn", "var").agg(F.bool_or("exposed").alias("exposed"))


def shorten_copies(moves: DataFrame) -> DataFrame:
    """Shortcuts over chains in which every step is the only way on.

    Taking a step twice, four times, ... only over nodes with a single successor keeps the table linear in size: each
    round a node's pointer jumps to its pointer's pointer.  Effects compose from the end: a cleaning or exposing last
    step decides, a neutral one passes the effect before it on.
    """
    out_degree = moves.groupBy("fn", "var").agg(F.count(F.lit(1)).alias("_n"))
    single = moves.join(out_degree.where("_n = 1").select("fn", "var"), ["fn", "var"]).where(
        ~((F.col("fn") == F.col("to_fn")) & (F.col("var") == F.col("to_var"))))
    pointer = cut(single.select("fn", "var", "to_fn", "to_var", "clean"))
    collected = pointer.where("false")
    # no chain is longer than the number of forced steps; every pass doubles twice
    for _ in range(max(1, pointer.count()).bit_length() // 2 + 1):
        twice = _compose(pointer, pointer)
        both = cut(twice.withColumn("_four", F.lit(False)).unionByName(_compose(twice, twice).withColumn("_four", F.lit(True))))
        if both.isEmpty():
            break
        collected = collected.unionByName(both.drop("_four"))
        pointer = both.where("_four").drop("_four")
    return collected


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Steps of ``first`` followed by steps of ``second``; the last effect that is not neutral decides."""
    then = second.select(
        F.col("fn").alias("to_fn"), F.col("var").alias("to_var"), F.col("to_fn").alias("_fn"), F.col("to_var").alias("_var"),
        F.col("clean").alias("_clean"))
    return first.join(then, ["to_fn", "to_var"]).select(
        "fn", "var", F.col("_fn").alias("to_fn"), F.col("_var").alias("to_var"), F.coalesce("_clean", "clean").alias("clean")).where(
        ~((F.col("fn") == F.col("to_fn")) & (F.col("var") == F.col("to_var"))))


def sink_verdicts(functions: DataFrame, facts: DataFrame, boundary_kinds: DataFrame | None = None) -> DataFrame:
    """Sensitive functions as exposed, sanitized or candidate.

    ``boundary_kinds`` (``function_id, kind``, first boundary per function) makes further functions sensitive.
    """
    kind = T.variable_sink_kind(F.col("name"), F.col("body"), F.col("side_effects"))
    sinks = functions.select("function_id", kind.alias("_kind"))
    if boundary_kinds is not None:
        sinks = sinks.join(boundary_kinds, "function_id", "left").withColumn("_kind", F.coalesce("_kind", "kind"))
    sinks = sinks.where("_kind IS NOT NULL").select("function_id", F.col("_kind").alias("sink_kind"))
    per_fn = facts.groupBy("function_id").agg(
        F.count(F.lit(1)).alias("tainted_variables"), F.bool_or(~F.col("sanitized")).alias("_exposed"))
    joined = sinks.join(per_fn, "function_id", "left")
    return joined.select(
        "function_id", "sink_kind", F.coalesce("tainted_variables", F.lit(0)).alias("tainted_variables"),
        F.when(F.col("_exposed"), "exposed").when(F.col("tainted_variables").isNotNull(), "sanitized")
        .otherwise("candidate").alias("status"))


def path_ends(functions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and sink functions of the path analysis."""
    called = edges.select(F.col("dst").alias("function_id")).distinct().withColumn("_called", F.lit(True))
    f = functions.join(called, "function_id", "left")
    source = T.path_source_kind(F.col("name"), F.col("summary"), F.col("external_inputs"), F.col("body"), F.col("_called").isNull())
    sink = T.path_sink_kind(F.col("name"), F.col("summary"), F.col("risks"), F.col("side_effects"), F.col("body"))
    sources = f.select("project_id", F.col("function_id").alias("node"), source.alias("kind")).where("kind IS NOT NULL")
    sinks = f.select("project_id", F.col("function_id").alias("node"), sink.alias("kind")).where("kind IS NOT NULL")
    return sources, sinks


def taint_paths(functions: DataFrame, edges: DataFrame, verdicts: DataFrame, edge_items: DataFrame, max_nodes: int = 14,
                limit: int | None = None) -> DataFrame:
    """Source-to-sink paths with status, grade and confidence.

    ``edge_items``: ``src, dst, items, observed, grade, confidence`` (bindings and observation of an edge);
    ``verdicts``: :func:`sink_verdicts`.  ``limit`` keeps the first paths of each project in breadth-first order.
    """
    functions = cut(functions.select(
        "project_id", "function_id", "name", "summary", "external_inputs", "validations", "risks", "side_effects", "body", "confidence"))
    sources, sinks = (cut(ends) for ends in path_ends(functions, edges))
    verdicts, edge_items = cut(verdicts), cut(edge_items)
    paths = expand_paths(edges, sources, sinks, max_nodes).withColumnRenamed("node", "sink")
    paths = paths.join(sinks.select(F.col("node").alias("sink"), F.col("kind").alias("sink_kind"), "project_id"), "sink").join(
        sources.select(F.col("node").alias("start"), F.col("kind").alias("source_kind")), "start")
    paths = cut(paths.withColumn("path_id", F.xxhash64("path")))
    # facts about the nodes and edges of a path, gathered by aggregation per path (at most ``max_nodes`` rows each)
    on_path = paths.select("path_id", "sink_kind", F.explode("path").alias("function_id"))
    info = functions.select("function_id", "name", "summary", "validations", "body", "confidence")
    marked = on_path.join(info, "function_id").select(
        "path_id", T.is_path_sanitizer(F.col("name"), F.col("summary"), F.col("validations"), F.col("body"), F.col("sink_kind"))
        .alias("_clean"))
    cleaned = marked.groupBy("path_id").agg(F.count_if("_clean").alias("sanitizers"))
    hops = paths.select("path_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
            F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("_h")).select("path_id", "_h.*")
    edge_info = hops.join(edge_items, ["src", "dst"]).groupBy("path_id").agg(
        F.bool_and(F.col("items") > 0).alias("_bound"), F.bool_and("observed").alias("_observed"),
        F.min(T.grade_rank(F.col("grade"))).alias("_rank"), F.min("confidence").alias("_edge_conf"))
    ends = functions.select("function_id", F.col("confidence").alias("_c"))
    joined = (
        paths.join(cleaned, "path_id", "left").join(edge_info, "path_id", "left")
        .join(verdicts.select(F.col("function_id").alias("sink"), F.col("status").alias("_v")), "sink", "left")
        .join(ends.withColumnRenamed("function_id", "start").withColumnRenamed("_c", "_sc"), "start")
        .join(ends.withColumnRenamed("function_id", "sink").withColumnRenamed("_c", "_tc"), "sink"))
    status = (
        F.when(F.col("_v") == "exposed", "exposed")
        .when((F.col("_v") == "sanitized") | (F.col("sanitizers") > 0), "sanitized")
        .when(F.col("_observed") | F.col("_bound"), "exposed").otherwise("candidate"))
    joined = joined.withColumn("status", status)
    lowest = F.least("_sc", "_tc", "_edge_conf") - F.when(F.col("status") == "candidate", 18).otherwise(0)
    out = joined.select(
        "project_id", "path_id", "start", "sink", "source_kind", "sink_kind", "path", "edge_ords", "sanitizers", "status",
        T.grade_of_rank(F.coalesce("_rank", F.lit(0))).alias("grade"),
        F.greatest(F.lit(28), F.least(F.lit(100), round_half_up(lowest.cast("double")))).alias("confidence"))
    if limit:
        from .windows import top_n

        out = top_n(out, ["project_id"], [F.col("start"), F.size("path"), F.col("edge_ords")], limit)
    return out


def annotate_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """C11: status of an edge from the paths that use it: exposed before candidate before sanitized before none."""
    rank = F.when(F.col("status") == "exposed", 3).when(F.col("status") == "candidate", 2).otherwise(1)
    hops = paths.select(rank.alias("_rank"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
            F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("_h"))
    per_edge = hops.groupBy(F.col("_h.src").alias("src"), F.col("_h.dst").alias("dst")).agg(
        F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("path_count"))
    joined = edges.join(per_edge, ["src", "dst"], "left").fillna(0, ["path_count"])
    names = F.array(*map(F.lit, ("none", "sanitized", "candidate", "exposed")))
    return joined.withColumn(
        "taint_status", F.element_at(names, (F.coalesce("_rank", F.lit(0)) + 1).cast("int"))).drop("_rank")


def exposed_report(paths: DataFrame, n: int = 8) -> DataFrame:
    """exposed paths by confidence, then length; the ``n`` of the report per project."""
    from .windows import top_n

    order = [F.desc("confidence"), F.desc(F.size("path")), F.col("path")]
    return top_n(paths.where("status = 'exposed'"), ["project_id"], order, n, "path_rank")


def security_clauses(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """One clause per path on the sink function, else on the source function."""
    known = functions.select("function_id")
    sink = known.select(F.col("function_id").alias("sink"), F.col("function_id").alias("_sink"))
    source = known.select(F.col("function_id").alias("start"), F.col("function_id").alias("_start"))
    owner = F.coalesce("_sink", "_start")
    return paths.join(sink, "sink", "left").join(source, "start", "left").where(owner.isNotNull()).select(
        owner.alias("function_id"), "path_id", F.lit("security").alias("kind"),
        F.when(F.col("grade") == "runtime", "compiler").otherwise(F.col("grade")).alias("evidence_grade"),
        "status", "confidence")
