"""Reachability, depth, cycles and bounded paths on call graphs.

Graphs are edge tables with ``project_id, src, dst``; every operator works on all projects at once.  Loops keep one
small frontier table per round, cut its lineage with a reliable checkpoint and stop when the frontier is empty.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..session import cut_dealt as cut
from .windows import first_per


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("project_id", "src", "dst").distinct()


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stops: DataFrame | None = None) -> DataFrame:
    """Reached nodes with their smallest distance from a seed.

    ``seeds``: ``project_id, node``.  A node in ``stops`` (``node``) is reached but not expanded.
    """
    links = cut(_links(edges))
    if stops is not None:
        links = links.join(stops.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select(
            "project_id", "src", "dst")
    frontier = cut(seeds.select("project_id", "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = links.join(frontier.select("project_id", F.col("node").alias("src")), ["project_id", "src"]).select(
            "project_id", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(seen.select("project_id", "node"), ["project_id", "node"], "left_anti").withColumn(
            "depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        # the union of checkpointed rounds stays a flat list of scans; compact it now and then
        seen = seen.unionByName(fresh)
        if depth % 8 == 0:
            seen = cut(seen)
        frontier = fresh
    return seen


def entry_tree(edges: DataFrame, entries: DataFrame, max_depth: int = 9) -> DataFrame:
    """Functions within ``max_depth`` calls of the entry, with their smallest depth.

    A depth-first walk with a visited set would number nodes by visiting order; distance is order-free.
    """
    return bfs_depth(edges, entries, max_depth)


def trace(edges: DataFrame, starts: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Everything a run from ``starts`` can touch when it halts at breakpoints."""
    reached = bfs_depth(edges, starts, stops=breakpoints)
    marks = breakpoints.select("node").distinct().withColumn("_stop", F.lit(True))
    return reached.join(marks, "node", "left").select(
        "project_id", "node", "depth", F.coalesce("_stop", F.lit(False)).alias("stop"))


def data_flow_order(functions: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Distance from the entry first, functions out of reach after it, ties by file and line.

    Yields a sortable key per function instead of a global position.
    """
    depth = bfs_depth(edges, entries).select(F.col("node").alias("function_id"), "depth")
    joined = functions.join(depth, "function_id", "left")
    return joined.select(
        "project_id", "function_id", F.col("depth").isNotNull().alias("reachable"), "depth",
        F.struct(F.coalesce("depth", F.lit(2147483647)).alias("level"), F.col("path"), F.col("slot")).alias("order_key"))


def impact(edges: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes downstream of a stop set and the edges that leave any of them."""
    reached = bfs_depth(edges, stops)
    touched = edges.join(reached.select(F.col("node").alias("src")), "src", "left_semi")
    return reached, touched


def relax_depth(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, cap: int = 9, rounds: int = 10) -> DataFrame:
    """Depths pushed along edges from seeded nodes, ``min(depth + 1)``, capped; defaults stay where none arrives.

    ``nodes``: ``node, default_depth``; ``seeds``: ``node, depth``.
    """
    links = cut(_links(edges))
    known = cut(seeds.select("node", F.least(F.col("depth"), F.lit(cap)).alias("depth")))
    for _ in range(rounds):
        pushed = links.join(known.withColumnRenamed("node", "src"), "src").select(
            F.col("dst").alias("node"), F.least(F.col("depth") + 1, F.lit(cap)).alias("depth"))
        merged = known.unionByName(pushed).groupBy("node").agg(F.min("depth").alias("depth"))
        merged = cut(merged)
        changed = merged.join(known.withColumnRenamed("depth", "_old"), "node", "left").where(
            F.col("_old").isNull() | (F.col("_old") > F.col("depth")))
        if changed.isEmpty():
            known = merged
            break
        known = merged
    return nodes.join(known, "node", "left").select("node", F.coalesce("depth", "default_depth").alias("depth"))


#: Share of the nodes that contraction must remove to be tried; below it the other ways are quicker. Results do not hang on it.
CONTRACT = 0.25


def _single_in(links: DataFrame) -> tuple[DataFrame, list[DataFrame]] | None:
    """Nodes with one predecessor, each with the root of its chain, found by pointer doubling.

    ``links``: ``src, dst, w`` with one row per pair. Yields v, root, dist (summed weights from the root), cyclic (v lies on a cycle
    of such nodes, whose smallest is the root then), and the jumps of 1, 2, 4 ... steps (v, up). None if too few nodes qualify.
    """
    tree = cut(links.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("up"), F.min("w").alias("dist")).where("_n = 1").drop("_n"))
    size = tree.count()
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    if not size or size < CONTRACT * nodes:
        return None
    jump, jumps, steps = tree.withColumn("low", F.col("v")), [tree.select("v", "up")], 1
    while True:
        ahead = jump.select(F.col("v").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("low").alias("_low"))
        jump = cut(jump.join(ahead, "up", "left").select(
            "v", F.coalesce("_up", "up").alias("up"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_up").isNotNull().alias("_moved")))
        steps *= 2
        if steps > 2 * size or jump.where("_moved").isEmpty():
            break
        jumps.append(cut(jump.where("_moved").select("v", "up")))
    # after so many steps what has not met a root is on a cycle or behind one, and all it points to lies on the cycle
    on = jump.join(tree.select(F.col("v").alias("up")), "up", "left_semi").select(F.col("up").alias("_c")).distinct()
    lows = cut(on.join(jump.select(F.col("v").alias("_c"), F.col("low").alias("_rep")), "_c"))
    found = jump.join(lows, F.col("up") == F.col("_c"), "left").select("v", F.coalesce("_rep", "up").alias("root"), "dist")
    marks = lows.select(F.col("_c").alias("v"), F.lit(True).alias("_on"))
    return cut(found.join(marks, "v", "left").select("v", "root", "dist", F.coalesce("_on", F.lit(False)).alias("cyclic"))), jumps


def _moved_ends(links: DataFrame, chains: DataFrame) -> DataFrame:
    """Links into nodes of several predecessors, from the roots of their sources: src, at (the old source), dst, w."""
    rest = links.join(chains.select(F.col("v").alias("dst")), "dst", "left_anti")
    ends = chains.select(F.col("v").alias("src"), "root", "dist")
    return rest.join(ends, "src", "left").select(
        F.coalesce("root", "src").alias("src"), F.col("src").alias("at"), "dst", (F.col("w") + F.coalesce("dist", F.lit(0))).alias("w"))


def _components(links: DataFrame, tries: int = 2) -> DataFrame:
    """node, component for every node of ``links`` (``src, dst``); components are named by any of their nodes.

    A node with a single predecessor goes where that one goes, so chains and trees of them are contracted to their roots; turned
    round, the same holds for single successors. Such a node belongs to the component of its root if one that hangs on it
    leads back there. Only a core that no longer shrinks is searched hop by hop.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if links.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    found = _single_in(links.withColumn("w", F.lit(1)))
    if found is None:
        turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return _components(turned, tries - 1) if tries > 1 else _coloured(links)
    chains, jumps = found
    rest = cut(_moved_ends(links.withColumn("w", F.lit(1)), chains))
    core = cut(rest.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    inner = cut(_components(core)) if not core.isEmpty() else None
    named = chains.select("v", "root", "cyclic", F.col("root").alias("_to"))
    ends = rest.select("src", "at", "dst", F.col("src").alias("_a"), F.col("dst").alias("_b"))
    if inner is not None:
        comp = inner.withColumnRenamed("component", "_c")
        named = named.join(comp.withColumnRenamed("node", "root"), "root", "left").withColumn("_to", F.coalesce("_c", "root")).drop("_c")
        ends = ends.join(comp.withColumnRenamed("node", "src"), "src", "left").withColumn("_a", F.coalesce("_c", "src")).drop("_c")
        ends = ends.join(comp.withColumnRenamed("node", "dst"), "dst", "left").withColumn("_b", F.coalesce("_c", "dst")).drop("_c")
    back = cut(ends.where("_a = _b").select(F.col("at").alias("v")).distinct().join(chains.select("v"), "v", "left_semi"))
    if not back.isEmpty():
        for jump in jumps:  # whoever leads back takes along all that it hangs on: 1, 2, 4 ... steps up
            back = cut(back.unionByName(back.join(jump, "v").select(F.col("up").alias("v"))).distinct())
    inside = named.join(back.withColumn("_in", F.lit(True)), "v", "left")
    part = inside.select(F.col("v").alias("node"), F.when(F.col("cyclic") | F.coalesce("_in", F.lit(False)), F.col("_to")).otherwise(F.col("v")).alias("component"))
    roots = nodes.join(part.select("node"), "node", "left_anti")
    if inner is None:
        roots = roots.select("node", F.col("node").alias("component"))
    else:
        roots = roots.join(inner, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return part.unionByName(roots)


def strong_components(edges: DataFrame) -> DataFrame:
    """Component id (its smallest node) of every node, by contraction of chains and colouring of the core."""
    comp = cut(_components(cut(_links(edges).where("src <> dst").select("src", "dst"))))
    names = comp.groupBy("component").agg(F.min("node").alias("_name"))
    return comp.join(names, "component").select("node", F.col("_name").alias("component")).hint("merge")


def _coloured(links: DataFrame) -> DataFrame:
    """Components by trimming and colouring: nodes without a live predecessor or successor are alone; the rest propagate
    their smallest ancestor until nothing moves, and the nodes of a colour that reach its root backwards inside the colour
    form one component.  A colour is an ancestor itself, so each round also takes over the colour of one's colour.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    done: DataFrame | None = None
    live = cut(nodes)
    while not live.isEmpty():
        # nodes without predecessors or successors among the live ones are components of their own
        while True:
            heads = links.select(F.col("src").alias("node")).distinct()
            tails = links.select(F.col("dst").alias("node")).distinct()
            inner = cut(live.join(heads, "node", "left_semi").join(tails, "node", "left_semi"))
            single = cut(live.join(inner, "node", "left_anti"))
            if single.isEmpty():
                break
            part = single.select("node", F.col("node").alias("component"))
            done = part if done is None else done.unionByName(part)
            links = cut(links.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(
                inner.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            live = inner
        if live.isEmpty():
            break
        colour = cut(live.select("node", F.col("node").alias("colour")))
        while True:
            further = colour.select(F.col("node").alias("colour"), F.col("colour").alias("_further"))
            colour = colour.join(further, "colour").select("node", F.least("colour", "_further").alias("colour"))
            arriving = links.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
                F.min("colour").alias("_c"))
            nxt = cut(colour.join(arriving, "node", "left").select(
                "node", F.least("colour", F.coalesce("_c", "colour")).alias("colour"),
                (F.col("_c") < F.col("colour")).alias("_moved")))
            moved = not nxt.where("_moved").isEmpty()
            colour = nxt.select("node", "colour")
            if not moved:
                break
        tagged = links.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "_a"), "src").join(
            colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "_b"), "dst")
        same = cut(tagged.where("_a = _b").select("src", "dst", F.col("_a").alias("colour")))
        roots = cut(colour.where("node = colour"))
        frontier, found = roots, roots
        while True:
            back = same.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(
                F.col("src").alias("node"), "colour").distinct()
            frontier = cut(back.join(found, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            found = found.unionByName(frontier)
        found = cut(found)
        part = found.select("node", F.col("colour").alias("component"))
        done = part if done is None else done.unionByName(part)
        live = cut(live.join(found.select("node"), "node", "left_anti"))
        links = cut(links.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(
            live.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        done = cut(done)
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def cycle_edges(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Marks edges whose target can reach their source."""
    comp = strong_components(edges) if components is None else components
    left = comp.select(F.col("node").alias("src"), F.col("component").alias("_a"))
    right = comp.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    joined = edges.join(left, "src", "left").join(right, "dst", "left")
    return joined.withColumn(
        "is_cycle", (F.col("src") == F.col("dst")) | F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def longest_paths(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """node, depth: most steps from a node without predecessors, on a graph without cycles, with one row per node.

    Chains of single predecessors are contracted by doubling, their lengths kept as weights, for as long as that removes
    enough nodes; what is left is relaxed from the nodes that have changed, and the chains are laid out again behind it.
    """
    links, laid = cut(dag.select("src", "dst", F.lit(1).alias("w"))), []
    while not links.isEmpty():
        found = _single_in(links)
        if found is None:
            break
        laid.append(found[0])
        links = cut(_moved_ends(links, found[0]).groupBy("src", "dst").agg(F.max("w").alias("w")))
    known = nodes.select("node", F.lit(0).alias("depth"))
    for chains in laid:
        known = known.join(chains.select(F.col("v").alias("node")), "node", "left_anti")
    known = cut(known)
    changed = known.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    while not links.isEmpty():
        pushed = links.join(changed.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("depth") + F.col("w")).alias("_d"))
        known = cut(known.join(pushed, "node", "left").select("node", F.greatest("depth", F.coalesce("_d", "depth")).alias("depth"), (F.col("_d") > F.col("depth")).alias("_up")))
        changed = known.where("_up").select("node", "depth")
        known = known.select("node", "depth")
        if changed.isEmpty():
            break
    for chains in reversed(laid):
        behind = chains.join(known.withColumnRenamed("node", "root"), "root").select(F.col("v").alias("node"), (F.col("depth") + F.col("dist")).alias("depth"))
        known = cut(known.unionByName(behind))
    return known


def topological_depth(edges: DataFrame, max_depth: int | None = None, scaled_to: int | None = None) -> DataFrame:
    """Longest-path depth on the graph of strong components.

    All nodes of a component share a depth, which replaces the order-dependent choice of where to break a cycle.
    """
    comp = cut(strong_components(edges))
    left = comp.select(F.col("node").alias("src"), F.col("component").alias("_a"))
    right = comp.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    dag = cut(edges.select("src", "dst").join(left, "src").join(right, "dst").where("_a <> _b").select(
        F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
    deepest = longest_paths(comp.select(F.col("component").alias("node")).distinct(), dag)
    if max_depth is not None:
        deepest = deepest.withColumn("depth", F.least("depth", F.lit(max_depth)))
    result = comp.join(deepest.withColumnRenamed("node", "component"), "component").select("node", F.col("depth").cast("int").alias("depth"))
    if scaled_to:
        top = max(1, result.agg(F.max("depth")).first()[0] or 1)
        if top > scaled_to:
            result = result.withColumn("depth", F.floor(F.col("depth") * F.lit(scaled_to / top) + 0.5).cast("int"))
    return result


def can_reach(edges: DataFrame, targets: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Nodes with a path to a target (``project_id, node``) and the smallest number of steps."""
    backwards = edges.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return bfs_depth(backwards, targets, max_steps)


def expand_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_nodes: int = 14) -> DataFrame:
    """All simple paths of at most ``max_nodes`` nodes from a start to a target.

    Paths are only grown through nodes that can still reach a target in the steps left, so dead branches never enter
    the frontier.  Yields ``start, node, path, edge_ords``; ordering by start, length and ``edge_ords`` gives the
    breadth-first order.  ``edges`` carries ``ord``, the position of an edge among its source's edges.
    """
    near = cut(can_reach(edges, targets, max_nodes - 1).select(F.col("node").alias("dst"), F.col("depth").alias("_left")))
    goal = targets.select("node").distinct().withColumn("_goal", F.lit(True))
    links = cut(edges.select("src", "dst", "ord").join(near, "dst"))
    frontier = cut(starts.select(
        F.col("node").alias("start"), "node", F.array("node").alias("path"),
        F.array().cast("array<long>").alias("edge_ords")))
    found: DataFrame | None = None
    for length in range(2, max_nodes + 1):
        grown = frontier.withColumnRenamed("node", "src").join(links, "src").where(
            ~F.array_contains("path", F.col("dst")) & (F.col("_left") <= max_nodes - length))
        frontier = cut(grown.select(
            "start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"),
            F.array_append("edge_ords", F.col("ord").cast("long")).alias("edge_ords")))
        if frontier.isEmpty():
            break
        hit = frontier.join(goal, "node", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = frontier.where("false")
    return found.select("start", "node", "path", "edge_ords")


def upstream_chain(edges: DataFrame, targets: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Shortest caller chain from a root to each target, ties by caller ids; the target alone when none exists.

    ``max_nodes`` bounds the chains that are looked at; without it the search ends when no new caller is found.
    """
    incoming = cut(_links(edges).select("project_id", F.col("dst").alias("node"), F.col("src").alias("parent")))
    has_parent = incoming.select("node").distinct()
    frontier = cut(targets.select(F.col("node").alias("target"), "node", F.array("node").alias("path")))
    seen = frontier.select("target", "node")
    out: DataFrame | None = None
    for _ in count() if max_nodes is None else range(max_nodes):
        roots = frontier.join(has_parent, "node", "left_anti")
        hit = roots.groupBy("target").agg(F.min("path").alias("path"))
        out = hit if out is None else out.unionByName(hit)
        rest = frontier.join(roots.select("target").distinct(), "target", "left_anti")
        grown = rest.join(incoming, "node").select(
            "target", F.col("parent").alias("node"), F.array_append("path", F.col("parent")).alias("path"))
        step = grown.join(seen, ["target", "node"], "left_anti")
        frontier = cut(first_per(step, ["target", "node"], ["path"]).select("target", "node", "path"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier.select("target", "node")))
    chains = out.select("target", F.reverse("path").alias("chain"))
    return targets.select(F.col("node").alias("target")).distinct().join(chains, "target", "left").select(
        "target", F.coalesce("chain", F.array("target")).alias("chain"))


def main_path(edges: DataFrame, entries: DataFrame, max_nodes: int = 9) -> DataFrame:
    """Per project, the entry with its ordered calls if it has two or more, else the longest simple path.

    Path length is bounded by ``max_nodes``, the length that is kept anyway.
    """
    starts = entries.select("project_id", F.col("node").alias("entry")).distinct()
    direct = edges.join(starts.withColumnRenamed("entry", "src").drop("project_id"), "src").groupBy("project_id", "src").agg(
        F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("_calls"))
    calls = direct.select(
        "project_id", F.slice(F.concat(F.array("src"), F.array_distinct(F.transform("_calls", lambda c: c["dst"]))), 1, max_nodes)
        .alias("path"), F.size("_calls").alias("_n"))
    wide = calls.where("_n >= 2").select("project_id", "path")
    links = cut(edges.select("src", "dst", "ord"))
    narrow = starts.join(wide.select("project_id"), "project_id", "left_anti")
    frontier = cut(narrow.select("project_id", F.col("entry").alias("node"), F.array("entry").alias("path"),
                                 F.array().cast("array<long>").alias("edge_ords")))
    best = frontier.select("project_id", "path", "edge_ords")
    for _ in range(max_nodes - 1):
        grown = frontier.withColumnRenamed("node", "src").join(links, "src").where(~F.array_contains("path", F.col("dst")))
        frontier = cut(grown.select(
            "project_id", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"),
            F.array_append("edge_ords", F.col("ord").cast("long")).alias("edge_ords")))
        if frontier.isEmpty():
            break
        # among paths of one length the first in edge order stays
        best = best.unionByName(frontier.groupBy("project_id").agg(F.min_by("path", "edge_ords").alias("path"),
                                                                   F.min("edge_ords").alias("edge_ords")))
    longest = best.groupBy("project_id").agg(F.max_by("path", F.size("path")).alias("path"))
    return wide.unionByName(longest)
