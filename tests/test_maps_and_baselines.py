"""Map geometry and carried maxima against plain Python."""

from __future__ import annotations

import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.operators import segments
from codestrata.plans import reports as P
from codestrata.queries import load_all

QUERIES = load_all()[0]


def _sign(px, py, qx, qy, rx, ry):
    v = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    return (v > 0) - (v < 0)


def test_crossings_of_long_and_short_segments(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        span = rnd.choice([0, 3, 40, 900])
        x, y = rnd.uniform(-300, 300), rnd.uniform(-300, 300)
        rows.append((i % 2, i, x, y, x + rnd.uniform(-span, span) * (i % 5 > 0), y + rnd.uniform(-span, span), i, 1000 + rnd.randrange(60)))
    rows += [(0, 900, 0.0, -50.0, 0.0, 50.0, 5000, 5001), (0, 901, -50.0, 0.0, 50.0, 0.0, 5002, 5003), (0, 902, 0.0, 50.0, 9.0, 50.0, 5004, 5005)]
    want = {}
    for a, b in combinations(rows, 2):
        if a[0] != b[0] or {a[6], a[7]} & {b[6], b[7]}:
            continue
        s, t = a[2:6], b[2:6]
        if _sign(*s, *t[:2]) != _sign(*s, *t[2:]) and _sign(*t, *s[:2]) != _sign(*t, *s[2:]):
            want[a[0]] = want.get(a[0], 0) + 1
    segments = spark.createDataFrame(rows, "map_id int, seg_id int, x1 double, y1 double, x2 double, y2 double, a int, b int")
    assert {r.map_id: r.crossings for r in P.crossings(segments, 25.0).collect()} == want


def test_a_long_segment_costs_its_length(spark):
    one = spark.createDataFrame([(0, 1, 0.0, 0.0, 1000.0, 1000.0)], "map_id int, seg_id int, x1 double, y1 double, x2 double, y2 double")
    assert P._touched(one, 10.0).count() < 400  # its box holds 10 000 cells


def test_crossing_pairs_are_added_up_where_they_are_found(spark):
    """Pairs grow with the square of a map, so none of them may go through a shuffle; a pair in many cells counts once."""
    n = 60  # two fans of long segments: each of one crosses each of the other, in cells of many shapes
    rows = [(0, i, 0.0, i * 1.0, 500.0, 300.0 + i, i, 1000 + i) for i in range(n)] + [(0, n + i, 0.0, 300.0 + i, 500.0, i * 1.0, n + i, 2000 + i) for i in range(n)]
    rows += [(1, 1, 0.0, 0.0, None, 1.0, 1, 2), (1, 2, 0.0, 1.0, 1.0, 0.0, 3, 4)]
    segments = spark.createDataFrame(rows, "map_id int, seg_id int, x1 double, y1 double, x2 double, y2 double, a int, b int")
    found = P.crossings(segments, 10.0)
    shuffles = [line for line in found._jdf.queryExecution().toString().splitlines() if "Exchange" in line]
    assert shuffles and not [line for line in shuffles if "seg_id" in line]
    assert [tuple(r) for r in found.collect()] == [(0, n * n)]


def _crossing_pairs(rows):
    want = {}
    for a, b in combinations([r for r in rows if None not in r], 2):
        if a[0] != b[0] or a[1] == b[1] or {a[6], a[7]} & {b[6], b[7]}:
            continue
        s, t = a[2:6], b[2:6]
        if _sign(*s, *t[:2]) != _sign(*s, *t[2:]) and _sign(*t, *s[:2]) != _sign(*t, *s[2:]):
            want[a[0]] = want.get(a[0], 0) + 1
    return want


_WHOLE = "map_id int, seg_id int, x1 long, y1 long, x2 long, y2 long, a int, b int"


@pytest.mark.parametrize("cell", [1.0, 3.5, 10.0, 400.0])
def test_crossings_of_whole_coordinates_are_counted_without_pairs(spark, cell):
    """Touches, common lines, upright and long segments, points, loops, common nodes and repeated names."""
    rnd = random.Random(11)
    rows = []
    for i in range(700):
        x, y, span = rnd.randrange(-12, 20), rnd.randrange(-12, 20), rnd.choice([1, 3, 8, 60])
        ends = [x, y, x + rnd.randrange(-span, span + 1) * (i % 6 > 0), y + rnd.randrange(-span, span + 1) * (i % 7 > 0)]
        a, b = rnd.randrange(40), rnd.randrange(40)
        rows.append((i % 3, i if i % 5 else rnd.randrange(20), *ends, a, b))
    rows += [(0, 5000, 1, 1, None, 4, 1, 2), (0, 5001, 1, 1, 6, 4, None, 2), (None, 5002, 1, 1, 6, 4, 1, 2), (7, 1, 0, 0, 4, 4, 1, 2), (7, 2, 1, 1, 9, 9, 3, 4)]
    found = P.crossings(spark.createDataFrame(rows, _WHOLE), cell)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {r.map_id: r.crossings for r in found.collect()} == _crossing_pairs(rows)


def test_a_dense_map_costs_its_segments(spark):
    """Nine million crossing pairs within a few cells; a star at one node has as many, and all of them are related."""
    n = 3000
    fan = [(0, i, 0, i % 7, 9, 20 + i % 9, i, 10000 + i) for i in range(n)] + [(0, n + i, 0, 20 + i % 9, 9, i % 7, 20000 + i, 30000 + i) for i in range(n)]
    star = [(1, r[1], *r[2:6], 5, r[7]) for r in fan]
    kinds = sorted({r[2:6] for r in fan})
    weight = {k: sum(r[2:6] == k for r in fan) for k in kinds}
    want = sum(weight[s] * weight[t] for s, t in combinations(kinds, 2)
               if _sign(*s, *t[:2]) != _sign(*s, *t[2:]) and _sign(*t, *s[:2]) != _sign(*t, *s[2:]))
    found = P.crossings(spark.createDataFrame(fan + star, _WHOLE), 10.0)
    assert want >= n * n and [tuple(r) for r in found.collect()] == [(0, want)]


def test_far_and_large_coordinates_are_told_apart(spark):
    """Heights and slopes that one float does not tell apart: a segment past, at and short of the end of another."""
    big, at = 3_000_001, 10**15
    rows = [(0, 0, at, 0, at + 2 * big, 2 * big - 1, 1, 2)]
    for i, y in enumerate((big - 2, big - 1, big, big + 1)):
        rows.append((0, 1 + i, at + big, y, at + big + 7, 3 * big, 10 + i, 20 + i))
        rows.append((0, 11 + i, at + big, -3 * big, at + big + 7, y, 30 + i, 40 + i))
    found = P.crossings(spark.createDataFrame(rows, _WHOLE), 1e6)
    assert {r.map_id: r.crossings for r in found.collect()} == _crossing_pairs(rows)


def test_map_quality_makes_no_pairs_of_segments(spark, tmp_path):
    """The registered query: its segments have whole coordinates and go the way without pairs, on every map it reports."""
    rnd = random.Random(4)
    orders = [(i, rnd.randrange(3000)) for i in range(0, 9000, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(80).selectExpr("id AS p_partkey", "CAST(id % 50 AS int) AS p_size", "'Brand#1' AS p_brand", "'PROMO' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200).selectExpr("id AS l_partkey", "'R' AS l_returnflag", "CAST(id AS double) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["map_quality"](spark, str(tmp_path))
    assert "seg_id" not in "".join(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    rows = [(c % 100, k, k % 97, c % 89, k % 97 + c % 11, c % 89 + k % 13, k % 5000, 10000 + k % 4999) for k, c in orders]
    want = _crossing_pairs(rows)
    got = {r.map_id: r.crossings for r in found.collect()}
    assert len(got) == 40 and got == {m: want.get(m, 0) for m in range(40)} and any(got.values())


def test_cells_go_on_over_batches(monkeypatch):
    rnd = random.Random(2)
    rows = [(m, cx, 0, cy == 0, i, *e, i, 500 + i) for m in "ab" for cx in range(2) for cy in (0,) for i, e in
            enumerate([[10 * cx + rnd.randrange(9), rnd.randrange(9), 10 * cx + 9, rnd.randrange(9)] for _ in range(25)])]
    names = ["map_id", "_cx", "_cy", "_first", "seg_id", "x1", "y1", "x2", "y2", "a", "b"]
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows))})
    want = {}
    for cx in range(2):
        for m, n in _crossing_pairs([(r[0], r[4], *r[5:]) for r in rows if r[1] == cx]).items():
            want[m] = want.get(m, 0) + n
    for goal in (1, 30, 1000):
        monkeypatch.setattr(segments, "CHUNK_ROWS", goal)
        got = {}
        for batch in segments.cell_counter(10)(iter(table.to_batches(max_chunksize=7))):
            for m, n in zip(*batch.to_pydict().values()):
                got[m] = got.get(m, 0) + n
        assert got == want


@pytest.mark.parametrize("cell", [7.0, 32.0, 200.0])
def test_overlaps_with_dense_spots(spark, cell):
    rnd = random.Random(3)
    rows = [(m, rnd.uniform(-400, 400), rnd.uniform(-400, 400), rnd.choice([34, 40, 52])) for m in (0, 1) for _ in range(90)]
    rows += [(0, 5.0, 5.0, 34)] * 60 + [(0, 5.0 + rnd.random(), 6.0, 34) for _ in range(60)] + [(2, 0.0, 0.0, 34), (2, 78.0, 0.0, 34), (3, 1.0, None, 34)]
    want = {}
    for (m, x, y, r), (n, u, v, s) in combinations(rows, 2):
        if m == n and None not in (y, v) and (x - u) ** 2 + (y - v) ** 2 < (r + s + P.NODE_GAP) ** 2:
            want[m] = want.get(m, 0) + 1
    nodes = spark.createDataFrame(rows, "map_id int, x double, y double, radius int")
    assert {r.map_id: r.overlaps for r in P.overlaps(nodes, cell).collect()} == want


def test_baselines_with_null_keys_and_ties(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, 7, 8]), i, rnd.choice([None, *range(40)]), rnd.choice(["stable", "draft"])) for i in range(200)]
    df = spark.createDataFrame(rows, "group_id int, project_hash int, snapshot_id int, day int, status string").withColumn(
        "created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day") * 5))
    got = {r.snapshot_id: r.baseline_id for r in P.baseline_snapshots(df).collect()}

    def at(r):
        return (-1 if r[3] is None else r[3], r[2])

    for r in rows:
        before = [x for x in rows if x[0] == r[0] and at(x) < at(r)]
        for pool in ([x for x in before if x[1] == r[1] and x[4] == "stable"], [x for x in before if x[4] == "stable"], before):
            if pool:
                assert got[r[2]] == max(pool, key=at)[2]
                break
        else:
            assert got[r[2]] is None
    assert P.baseline_snapshots(df.limit(0)).count() == 0
