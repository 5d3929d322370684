"""Scenario coverage and library quality on missing values and empty tables."""

from codestrata.operators import rules as R
from codestrata.plans import reports as P

SCENARIOS = (("a", "speed", "runs", ("Fast", "steady")), ("b", "safety", "files", ()))
READY, VECTORS = "project_id int, source_table string, readiness int", "project_id int, source_table string, dims map<string,double>"
EVIDENCE = "project_id int, scenario_id string, dimension string, passed boolean, eligible boolean, confidence int, text string"


def _cover(spark, ready=(), vectors=(), evidence=()):
    projects = spark.createDataFrame([(1, "A FAST one"), (2, None)], "project_id int, text string")
    frames = [spark.createDataFrame(list(r), s) for r, s in ((ready, READY), (vectors, VECTORS), (evidence, EVIDENCE))]
    out = P.scenario_coverage(projects, SCENARIOS, *frames).collect()
    return {(r["project_id"], r["scenario_id"]): (r["vector_count"], r["required_hits"], r["checked"], r["mature"], r["coverage"], r["status"]) for r in out}


def test_every_project_meets_every_scenario_without_any_fact(spark):
    empty = (0, 0, 0, 0, 0, "blocked")
    assert _cover(spark) == {(1, "a"): (0, 1, 0, 0, 6, "blocked"), (1, "b"): empty, (2, "a"): empty, (2, "b"): empty}


def test_facts_count_once_and_missing_values_do_not(spark):
    vectors = [(1, "runs", {"speed": 0.9}), (1, "runs", None), (1, None, {"speed": 0.48}), (1, "files", {"speed": 0.1, "safety": None})]
    evidence = [(1, "a", "speed", True, True, 90, "steady"), (1, None, "speed", True, None, 70, None), (1, "a", None, None, True, 10, "x"),
                (1, "b", "speed", False, True, 5, "y")]
    got = _cover(spark, [(1, "runs", 100), (1, "files", None)], vectors, evidence)
    # 28 + 24 * 0.22 + 68 * 0.18 + 80 * 0.32
    assert got[1, "a"] == (3, 2, 2, 1, 71, "ready")
    assert got[1, "b"] == (1, 0, 0, 0, 2, "blocked")


def test_library_quality(spark):
    full = [(1, k) for k, n in R.LIBRARY_TARGETS.items() for _ in range(n + 5)] + [(2, "other"), (2, None), (3, "benchmark")]
    got = {r["library_id"]: (r["coverage"], r["score"], r["status"]) for r in R.data_quality(
        spark.createDataFrame(full, "library_id int, kind string")).collect()}
    assert got == {1: (100, 56, "reviewable"), 2: (0, 14, "seed"), 3: (1, 20, "seed")}
