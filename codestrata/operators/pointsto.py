"""Points-to analysis as inclusion constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..session import cut
from .binding import argument_pairs, edge_calls
from .windows import occurrence_number

NAME = r"([A-Za-z_$][\w$]*)"
# Statements that store to or load from fields and containers, and returns.
FIELD_STORE = rf"\b{NAME}\.{NAME}\s*=\s*{NAME}"
FIELD_LOAD = rf"\b{NAME}\s*=\s*{NAME}\.{NAME}"
SLOT_STORE = rf"\b{NAME}\s*\[\s*([^\]]+)\s*\]\s*=\s*{NAME}"
APPEND = rf"\b{NAME}\.(?:push|append|add)\s*\(\s*{NAME}\s*\)"
SLOT_LOAD = rf"\b{NAME}\s*=\s*{NAME}\s*\[\s*([^\]]+)\s*\]"
RETURN = rf"\breturn\s+{NAME}"
ANY_SLOT = "[*]"
PLAIN_ROUNDS = 4
ALLOCATE, RELEASE = "open|acquire|new", "close|free|release|drop|dispose"


def assignments(cfg: DataFrame) -> DataFrame:
    """Static single assignment numbers: the n-th definition of each variable of a function."""
    defs = cfg.select("function_id", "ord", F.posexplode("defs").alias("pos", "variable"), "uses")
    return occurrence_number(defs, ["function_id", "variable"], ["ord", "pos"], "version")


def aliases(cfg: DataFrame) -> DataFrame:
    """A definition with a single, different use copies it."""
    return cfg.where(F.size("uses") == 1).select(
        "function_id", F.get("uses", F.lit(0)).alias("owner"), F.explode("defs").alias("alias")).where("owner <> alias")


def phi_candidates(cfg: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """Blocks with two or more predecessors and the variables those define that have two or more versions."""
    joins = cfg_edges.groupBy("function_id", "to_ord").agg(F.count(F.lit(1)).alias("predecessors")).where("predecessors >= 2")
    before = cfg_edges.join(joins, ["function_id", "to_ord"]).join(
        cfg.select("function_id", F.col("ord").alias("from_ord"), F.explode("defs").alias("variable")), ["function_id", "from_ord"])
    versions = assignments(cfg).groupBy("function_id", "variable").agg(F.max("version").alias("versions")).where("versions >= 2")
    return before.select("function_id", "to_ord", "variable", "predecessors").distinct().join(
        versions, ["function_id", "variable"]).select(
        "function_id", F.col("to_ord").alias("block"), "variable", F.least("predecessors", "versions").alias("inputs"))


def heap_objects(cfg: DataFrame) -> DataFrame:
    """Definitions at an acquiring statement with the number of releasing uses of the same name."""
    made = cfg.where(F.col("ownership").rlike(ALLOCATE)).select("function_id", "ord", F.explode("defs").alias("owner"))
    freed = cfg.where(F.col("ownership").rlike(RELEASE)).select(
        "function_id", F.explode(F.array_distinct("uses")).alias("owner")).groupBy("function_id", "owner").agg(
        F.count(F.lit(1)).alias("release_count"))
    return made.join(freed, ["function_id", "owner"], "left").fillna(0, ["release_count"]).select(
        F.concat_ws(":", F.lit("heap"), "function_id", "owner", "ord").alias("object_id"), "function_id", "owner", "ord",
        "release_count")


def _zip(body: Column, pattern: str, groups: dict[str, int]) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), g).alias(n) for n, g in groups.items()])


def slot_name(raw: Column) -> Column:
    value = F.trim(raw)
    return F.when(value.rlike(r"^(?:\d+|[\"'][^\"']+[\"'])$"), F.concat(F.lit("["), value, F.lit("]"))).otherwise(ANY_SLOT)


def heap_accesses(functions: DataFrame) -> DataFrame:
    """Field and container stores and loads: ``fn, op, base, slot, value``."""
    body = F.col("body")
    forms = [
        ("store", FIELD_STORE, {"base": 1, "slot": 2, "value": 3}, lambda s: F.concat(F.lit("."), s)),
        ("load", FIELD_LOAD, {"value": 1, "base": 2, "slot": 3}, lambda s: F.concat(F.lit("."), s)),
        ("store", SLOT_STORE, {"base": 1, "slot": 2, "value": 3}, slot_name),
        ("load", SLOT_LOAD, {"value": 1, "base": 2, "slot": 3}, slot_name),
        ("store", APPEND, {"base": 1, "value": 2}, None),
    ]
    arrays = [_tagged(_zip(body, pattern, groups), op, name) for op, pattern, groups, name in forms]
    return functions.select(F.col("function_id").alias("fn"), F.inline(F.concat(*arrays))).distinct()


def _tagged(zipped: Column, op: str, name) -> Column:
    def row(z: Column) -> Column:
        slot = F.lit(ANY_SLOT) if name is None else name(z["slot"])
        return F.struct(F.lit(op).alias("op"), z["base"].alias("base"), slot.alias("slot"), z["value"].alias("value"))

    return F.transform(zipped, row)


def constraints(functions: DataFrame, cfg: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(addresses, copies, accesses)``.

    addresses ``fn, var, obj, owner``; copies ``fn, var, to_fn, to_var``; accesses: :func:`heap_accesses`.
    """
    functions = cut(functions.select("project_id", "function_id", "name", "params", "body"))
    called = edges.select(F.col("dst").alias("function_id")).distinct()
    outside = functions.join(called, "function_id", "left_anti").select(
        F.col("function_id").alias("fn"), F.explode(F.transform("params", text.variable_name)).alias("var")).where("var <> ''")
    params = outside.select("fn", "var", F.concat_ws(":", F.lit("param"), "fn", "var").alias("obj"), F.col("fn").alias("owner"))
    heap = heap_objects(cfg).select(
        F.col("function_id").alias("fn"), F.col("owner").alias("var"), F.col("object_id").alias("obj"),
        F.col("function_id").alias("owner"))
    copy = aliases(cfg).select(F.col("function_id").alias("fn"), F.col("owner").alias("var"),
                               F.col("function_id").alias("to_fn"), F.col("alias").alias("to_var"))
    back = functions.select(F.col("function_id").alias("fn"), F.explode(
        F.regexp_extract_all("body", F.lit(RETURN), 1)).alias("var")).select(
        "fn", "var", F.col("fn").alias("to_fn"), F.lit("$return").alias("to_var"))
    calls = cut(edge_calls(functions, edges).select("src", "dst", "params", "assignee", "args"))  # read twice below
    args = argument_pairs(calls).select(F.col("src").alias("fn"), F.col("variable").alias("var"),
                                        F.col("dst").alias("to_fn"), F.col("parameter").alias("to_var"))
    result = calls.where("assignee IS NOT NULL").select(
        F.col("dst").alias("fn"), F.lit("$return").alias("var"), F.col("src").alias("to_fn"), F.col("assignee").alias("to_var"))
    copies = copy.unionByName(back).unionByName(args).unionByName(result).distinct()
    return params.unionByName(heap).distinct(), copies, heap_accesses(functions)


def _hop(facts: DataFrame, copies: DataFrame) -> DataFrame:
    return facts.join(copies, ["fn", "var"]).select(F.col("to_fn").alias("fn"), F.col("to_var").alias("var"), "obj").distinct()


def _shortcuts(copies: DataFrame) -> DataFrame:
    """Pointer doubling over variables with one outgoing copy: long copy chains take logarithmic rounds."""
    degree = copies.groupBy("fn", "var").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("fn", "var")
    loop = (F.col("fn") == F.col("to_fn")) & (F.col("var") == F.col("to_var"))
    pointer = cut(copies.join(degree, ["fn", "var"]).where(~loop).select("fn", "var", "to_fn", "to_var"))
    out = pointer.where("false")

    def compose(p: DataFrame) -> DataFrame:
        then = p.select(F.col("fn").alias("to_fn"), F.col("var").alias("to_var"), F.col("to_fn").alias("_f"), F.col("to_var").alias("_v"))
        return p.join(then, ["to_fn", "to_var"]).select(
            "fn", "var", F.col("_f").alias("to_fn"), F.col("_v").alias("to_var")).where(~loop)

    for _ in range(max(1, pointer.count()).bit_length() // 2 + 1):
        twice = compose(pointer)
        both = cut(twice.withColumn("_four", F.lit(False)).unionByName(compose(twice).withColumn("_four", F.lit(True))))
        if both.isEmpty():
            break
        out = out.unionByName(both.drop("_four"))
        pointer = both.where("_four").drop("_four")
    return out


def points_to(functions: DataFrame, cfg: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> dict[str, DataFrame]:
    """Smallest solution of the inclusion constraints, semi-naive.

    ``pts`` holds ``fn, var, obj``; ``heap`` holds ``base_obj, slot, obj``.  Each round follows copies from new facts
    only; stores and loads are joined again when either side has grown.
    """
    addresses, copies, accesses = constraints(functions, cfg, edges)
    addresses, copies, accesses = cut(addresses), cut(copies), cut(accesses)
    return solve(addresses, copies, accesses, max_rounds) | {"accesses": accesses}


def solve(addresses: DataFrame, copies: DataFrame, accesses: DataFrame, max_rounds: int | None = None,
          any_slot: bool = True) -> dict[str, DataFrame]:
    """Fixpoint over prepared constraints; after ``PLAIN_ROUNDS`` long copy chains get shortcuts.

    Without ``max_rounds`` it runs until nothing is new; with it, ``converged`` tells whether it got there.
    """
    stores = accesses.where("op = 'store'").select("fn", F.col("base").alias("var"), "slot", "value")
    loads = accesses.where("op = 'load'").select("fn", F.col("base").alias("var"), "slot", "value")
    has_heap = not accesses.isEmpty()
    quick = copies
    pts = cut(addresses.select("fn", "var", "obj").distinct())
    heap = cut(pts.select(F.col("obj").alias("base_obj"), F.lit("").alias("slot"), "obj").where("false"))
    delta, rounds, converged = pts, 0, False
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        if rounds == PLAIN_ROUNDS + 1:
            quick, delta = cut(copies.unionByName(_shortcuts(copies)).distinct()), cut(pts)
        near = _hop(delta, quick)  # two hops per round, see the taint fixpoint
        new = near.unionByName(_hop(near, quick))
        heap_grew = False
        if has_heap:
            values = pts.select("fn", F.col("var").alias("value"), "obj")
            # a store matters when its base or its value is new; both cases are found from the changed side
            touched = delta.select("fn", "var").distinct()
            hot = stores.join(touched, ["fn", "var"], "left_semi").unionByName(
                stores.join(touched.withColumnRenamed("var", "value"), ["fn", "value"], "left_semi")).distinct()
            bases = hot.join(pts, ["fn", "var"]).select("fn", "slot", "value", F.col("obj").alias("base_obj"))
            if not bases.isEmpty():
                cells = bases.join(values, ["fn", "value"]).select("base_obj", "slot", "obj").distinct()
                fresh = cut(cells.join(heap, ["base_obj", "slot", "obj"], "left_anti"))
                heap_grew = not fresh.isEmpty()
                if heap_grew:
                    heap = cut(heap.unionByName(fresh))
            warm = loads if heap_grew else loads.join(touched, ["fn", "var"], "left_semi")
            reading = warm.join(pts, ["fn", "var"]).select("fn", "slot", "value", F.col("obj").alias("base_obj"))
            wanted = reading
            if any_slot:  # a container load also sees what was stored at an unknown position
                elsewhere = reading.where(F.col("slot").startswith("[")).withColumn("slot", F.lit(ANY_SLOT))
                wanted = reading.unionByName(elsewhere).distinct()
            new = new.unionByName(wanted.join(heap, ["base_obj", "slot"]).select("fn", F.col("value").alias("var"), "obj"))
        delta = cut(new.distinct().join(pts, ["fn", "var", "obj"], "left_anti"))
        if delta.isEmpty() and not heap_grew:
            converged = True
            break
        pts = cut(pts.unionByName(delta)) if rounds % 4 == 0 else pts.unionByName(delta)
    return {"pts": pts, "heap": heap, "addresses": addresses, "copies": copies, "rounds": rounds, "converged": converged}


def escapes(solution: dict[str, DataFrame]) -> DataFrame:
    """Objects that leave a function through its result."""
    return solution["pts"].where("var = '$return'").select(F.col("obj").alias("object_id")).distinct()


def alias_sets(solution: dict[str, DataFrame]) -> DataFrame:
    """Number of variables that may name an object, when there is more than one."""
    return solution["pts"].groupBy(F.col("obj").alias("object_id")).agg(
        F.count(F.lit(1)).alias("variables")).where("variables > 1")


def separation(solution: dict[str, DataFrame]) -> DataFrame:
    """Pairs of allocation sites of one function that share a variable (violated).

    Pairs are built from shared variables, not from all allocations of a function; every pair that does not appear is
    kept apart by the abstraction.
    """
    heap = solution["addresses"].where(F.col("obj").startswith("heap:")).select("obj", "owner").distinct()
    named = solution["pts"].join(heap, "obj")
    left = named.select("fn", "var", "owner", F.col("obj").alias("left_object"))
    right = named.select("fn", "var", "owner", F.col("obj").alias("right_object"))
    return left.join(right, ["fn", "var", "owner"]).where("left_object < right_object").groupBy(
        "owner", "left_object", "right_object").agg(F.count(F.lit(1)).alias("shared_variables"))


def ownership(solution: dict[str, DataFrame]) -> DataFrame:
    """State of the single-owner obligation of every allocation."""
    heap = solution["addresses"].where(F.col("obj").startswith("heap:")).select(F.col("obj").alias("object_id")).distinct()
    owners = solution["pts"].groupBy(F.col("obj").alias("object_id")).agg(F.count(F.lit(1)).alias("owners"))
    gone = escapes(solution).withColumn("_escaped", F.lit(True))
    joined = heap.join(owners, "object_id", "left").join(gone, "object_id", "left")
    escaped = F.coalesce("_escaped", F.lit(False))
    return joined.select(
        "object_id", F.when(escaped, "escaped-owner").otherwise("exclusive-owner").alias("kind"),
        F.when(~escaped & (F.col("owners") == 1), "proved-by-abstraction").otherwise("unknown").alias("status"))


def call_contexts(edges_called: DataFrame, depth: int = 2) -> DataFrame:
    """Call strings of length one and two: ``context_id, caller, callee, depth``."""
    one = edges_called.select(
        F.concat_ws(">", "src", "dst").alias("context_id"), F.col("src").alias("caller"), F.col("dst").alias("callee"),
        F.lit(1).alias("depth"), F.concat_ws(">", "src", "dst").alias("inner_id"))
    if depth < 2:
        return one
    inner = one.select(F.col("context_id").alias("inner_id"), F.col("caller").alias("_mid"), F.col("callee").alias("_leaf"))
    two = one.drop("inner_id").join(inner, F.col("callee") == F.col("_mid")).select(
        F.concat_ws(">", "context_id", "inner_id").alias("context_id"), "caller", F.col("_leaf").alias("callee"),
        F.lit(2).alias("depth"), "inner_id")
    return one.unionByName(two)


def context_heaps(functions: DataFrame, cfg: DataFrame, edges: DataFrame, solution: dict[str, DataFrame], depth: int = 2,
                  max_rounds: int | None = None) -> dict[str, DataFrame]:
    """A private points-to state of the callee for every call string.

    The same solver runs on constraints whose function is the context; arguments and results seed it, allocations of
    the callee get one copy per context. ``solution``: :func:`points_to` of the same functions, whose copies and accesses
    are taken over.
    """
    calls = cut(edge_calls(functions, edges).where("args IS NOT NULL").select("src", "dst", "params", "args"))
    contexts = cut(call_contexts(calls.select("src", "dst").distinct(), depth))
    copies, accesses = solution["copies"], solution["accesses"]
    passed = argument_pairs(calls).join(
        solution["pts"].select(F.col("fn").alias("src"), F.col("var").alias("variable"), "obj"), ["src", "variable"]).select(
        F.concat_ws(">", "src", "dst").alias("inner_id"), F.col("parameter").alias("var"), "obj")
    returned = calls.select("src", "dst").distinct().join(
        solution["pts"].where("var = '$return'").select(F.col("fn").alias("dst"), "obj"), "dst").select(
        F.concat_ws(">", "src", "dst").alias("inner_id"), F.lit("$return").alias("var"), "obj")
    # both depths take the seeds of their innermost call
    seeds = contexts.select("context_id", "inner_id").join(passed.unionByName(returned).distinct(), "inner_id").select(
        F.col("context_id").alias("fn"), "var", "obj")
    own = solution["addresses"].where(F.col("obj").startswith("heap:")).withColumnRenamed("fn", "callee").join(
        contexts.select("context_id", "callee"), "callee").select(
        F.col("context_id").alias("fn"), "var", F.concat_ws(":", F.lit("ctx"), "context_id", "obj").alias("obj"))
    spread = contexts.select("context_id", F.col("callee").alias("fn"))
    inner = copies.where("fn = to_fn").join(spread, "fn").select(
        F.col("context_id").alias("fn"), "var", F.col("context_id").alias("to_fn"), "to_var")
    heap = accesses.join(spread, "fn").select(F.col("context_id").alias("fn"), "op", "base", "slot", "value")
    addresses = seeds.unionByName(own).distinct().withColumn("owner", F.col("fn"))
    out = solve(cut(addresses), cut(inner), cut(heap), max_rounds, any_slot=False)
    out["contexts"] = contexts
    return out
