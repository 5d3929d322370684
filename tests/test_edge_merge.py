"""Folding of parallel edges in order, with one pair of nodes over many ranges."""

import random
from collections import defaultdict

from codestrata.operators.edges import merge_edges


def test_hot_pair_folds_in_order(spark):
    rnd = random.Random(3)
    rows = [(1, 2, i, rnd.randrange(-900, 40), i == 7, i % 5, 1) for i in range(200)]
    rows += [(a, b, i, rnd.randrange(-20, 90), False, 1, 2) for a in (1, 3) for b in (4, 5) for i in range(rnd.randrange(1, 6))]
    rows += [(9, 9, 0, 140, True, 3, 1)]
    want, edges = {}, defaultdict(list)
    for r in rows:
        edges[r[:2]].append(r)
    for pair, listed in edges.items():
        volume = listed[0][3]
        for r in sorted(listed, key=lambda r: r[2])[1:]:
            volume = min(100, max(volume, r[3]) + 4)
        want[pair] = (volume, any(r[4] for r in listed), max(r[5] for r in listed), sum(r[6] for r in listed))
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "src int, dst int, ord int, volume long, primary boolean, confidence int, relation_count int")
    for parts in (None, 9):
        got = merge_edges(table, ["src", "dst"], parts=parts).collect()
        assert {(r.src, r.dst): (r.volume, r.primary, r.confidence, r.relation_count) for r in got} == want
