"""Strong components and depths against plain Python, and their rounds on long chains and cycles."""

import random

import pytest

from codestrata.operators import graph


def edge_table(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "project_id int, src long, dst long")


def components_of(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            x = stack.pop()
            for a, b in pairs:
                if a == x and b not in reach[n]:
                    reach[n].add(b)
                    stack.append(b)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def depths_of(pairs):
    comp = components_of(pairs)
    dag = {(comp[a], comp[b]) for a, b in pairs if comp[a] != comp[b]}
    depth = dict.fromkeys(set(comp.values()), 0)
    for _ in depth:
        for a, b in dag:
            depth[b] = max(depth[b], depth[a] + 1)
    return {n: depth[c] for n, c in comp.items()}


@pytest.mark.parametrize("seed", (1, 3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 24
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range((16, 22, 30, 45)[seed])}
    pairs |= {(100 + i, 100 + (i + 1) % 5) for i in range(5)} | {(102, 200), (200, 201), (201, 202), (202, 201), (rnd.randrange(n), 100), (300, 300)}
    edges = edge_table(spark, sorted(pairs))
    loops = {p for p in pairs if p[0] != p[1]}
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == components_of(loops)
    assert {r.node: r.depth for r in graph.topological_depth(edges).collect()} == depths_of(loops)


def test_chain_and_cycle_of_ten_thousand(spark, monkeypatch):
    cuts = [0]
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (cuts.__setitem__(0, cuts[0] + 1), plain(df))[1])
    n = 10_000
    pairs = [(i, i + 1) for i in range(n - 1)] + [(n + i, n + (i + 1) % n) for i in range(n)]
    edges = edge_table(spark, pairs).repartition(4)
    rows = graph.strong_components(edges)
    # n steps by doubling: about log2(n) rounds of two written tables, not n
    assert cuts[0] <= 60
    assert rows.where(f"node < {n} AND node <> component").count() == 0
    assert rows.where(f"node >= {n} AND component = {n}").count() == n
    depth = graph.topological_depth(edge_table(spark, pairs[: n - 1]).repartition(4))
    assert depth.where("node <> depth").count() == 0 and depth.count() == n
