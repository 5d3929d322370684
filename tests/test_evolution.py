"""Training signals and bred weight sets on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codestrata.operators import evolution as E

V = "group_id int, vec_id int, label string, confidence int, evidence string"
A = "group_id int, vec_id int, teacher_label string, trust int, consensus int, corrected boolean, evidence string"
Q = "group_id int, vec_id int, reason string, label string, confidence int, evidence string"
I = "group_id int, run_id int, vec_id int, predicted string, confidence int, evidence string"  # noqa: E741
G = "group_id int, trigger string, centroids int, consensus int, trust int, improvement int, conflict_count int, quarantined_count int"
N = "group_id int, kind string, name string, parent double, supervised double, candidate double, reliability int, status string, accepted int, conflicts int"


def _signals(spark, groups, vectors=(), assignments=(), quarantined=(), inference=()):
    return E.training_signals(*(spark.createDataFrame(list(rows), s) for rows, s in ((vectors, V), (assignments, A), (quarantined, Q), (inference, I))), groups)


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(1, "stable-checkpoint", 0, 80, 90, 5, 0, 0), (2, "teacher-conflict-quarantine", 4, 60, 70, 0, 2, 3), (3, "stable-checkpoint", 2, 50, 50, 0, 0, 0)]
    return spark.createDataFrame(rows, G)


def test_each_branch_has_its_rows_and_cost(spark, groups):
    vectors = [(1, 1, "safe", 95, None), (1, 2, "safe", 81, None), (1, 3, "safe", 84, None), (1, 4, "safe", 99, None)]
    assignments = [(1, 4, "repair_candidate", 88, 50, True, None), (1, 5, "repair_candidate", 60, 90, True, "Test run"), (1, 6, "performance_hotspot", 75, 68, False, "x")]
    quarantined = [(1, 3, "teacher_conflict", "security_risk", 70, "x"), (1, 7, "low_trust", None, None, None)]
    inference = [(1, 9, 4, "safe", 84, None), (1, 10, 4, "repair_candidate", 99, None), (1, 11, 5, "safe", 71, None), (1, 12, 77, "safe", 99, None)]
    got = _signals(spark, groups, vectors, assignments, quarantined, inference).where("group_id = 1").orderBy("place").collect()
    assert [(r.branch, r.ref, r.signal_kind, r.severity) for r in got] == [
        (1, "3", "teacher_conflict", "risk"), (1, "7", "weak_evidence", "watch"), (2, "4", "prediction_teacher_drift", "risk"), (3, "4", "low_consensus", "risk"),
        (4, "1", "high_confidence_low_evidence", "risk"), (5, "4", "repair_unverified", "watch"), (6, "6", "benchmark_deviation", "watch"),
        (8, "9", "prediction_teacher_drift", "risk")]
    raw = 13 * 1.35 * (0.72 + 70 / 100 * 0.28)
    assert [got[0][c] for c in ("confidence_impact", "knowledge_impact", "fitness_impact")] == [int(raw * k + 0.5) for k in (0.82, 1.2, 1.0)]


def test_limits_of_branch_and_group(spark, groups):
    quarantined = [(g, i, "teacher_conflict", "safe", 50, None) for g in (1, 2) for i in range(60)]
    assignments = [(3, i, "safe", 90, 60, True, None) for i in range(20)]
    got = _signals(spark, groups, assignments=assignments, quarantined=quarantined)
    assert {(r.group_id, r.branch): r["count"] for r in got.groupBy("group_id", "branch").count().collect()} == {
        (1, 1): 16, (2, 1): 24, (3, 2): 8, (3, 3): 8}
    assert [int(r.ref) for r in got.where("group_id = 2").orderBy("place").collect()] == list(range(24))


def test_groups_without_signals_keep_their_parent(spark, groups):
    none = _signals(spark, groups.where("group_id <> 2"))
    assert none.count() == 0
    genes = spark.createDataFrame([(g, "dimension", d, None, 0.1, 0.1, None, None, None, None) for g in (1, 3) for d in ("security", "ast")], N)
    sets = E.breed(genes, groups.where("group_id <> 2"), none)
    mean = {(r.strategy, r.name): r.value for r in sets.where("group_id = 1").collect()}
    assert mean["parent", "security"] == mean["mutation", "security"] == mean["crossover", "ast"] == 0.1
    assert mean["guard", "min_consensus"] == 0.8 and mean["parent", "min_trust"] == 0.9
    chosen = {r.group_id: (r.strategy, r.status) for r in E.selected_candidate(E.candidate_fitness(sets, genes, groups.where("group_id <> 2"), none)).collect()}
    assert chosen == {1: ("parent", "mutating"), 3: ("parent", "mutating")}


def test_a_critical_signal_calls_for_the_guard(spark, groups):
    signals = _signals(spark, groups)
    assert [(r.group_id, r.signal_kind, r.ref, r.fitness_impact) for r in signals.collect()] == [
        (2, "rollback_triggered", "teacher-conflict-quarantine", int(24 * 1.6 * (0.72 + 90 / 100 * 0.28) * 1.25 + 0.5))]
    genes = spark.createDataFrame([(2, "dimension", "stability", 0.3, 0.2, 0.4, None, None, None, None), (2, "dimension", "ast", None, 0.1, 0.2, None, None, None, None),
                                   (2, "teacher", "benchmark", None, None, None, 50, "quarantined", 1, 20), (2, "language", "unknown", None, None, None, None, None, None, None)], N)
    sets = E.breed(genes, groups, signals)
    value = {(r.strategy, r.name): r.value for r in sets.where("group_id = 2").collect()}
    assert value["mutation", "stability"] == pytest.approx(0.3 + 10 / 600 + 0.012) and value["mutation", "benchmark"] == pytest.approx(0.5 - 18 / 600)
    assert value["crossover", "benchmark"] == 0.0 and value["crossover", "stability"] == 0.3 and value["mutation", "unknown"] == pytest.approx(0.42 - 8 / 600)
    assert ("parent", "unknown") not in value and value["guard", "min_trust"] == 0.76 and value["crossover", "min_trust"] == pytest.approx(142 / 200)
    chosen = E.selected_candidate(E.candidate_fitness(sets, genes, groups, signals)).where("group_id = 2")
    assert [(r.strategy, r.status) for r in chosen.collect()] == [("guard", "rollback")]
    weights = {r.name: r.weight for r in E.selected_weights(sets, chosen).collect()}
    assert weights == {"stability": 0.75, "ast": 0.25}


def test_empty_tables(spark, groups):
    none = _signals(spark, groups.limit(0))
    assert none.count() == 0 and E.breed(spark.createDataFrame([], N), groups.limit(0), none).count() == 0
    assert none.withColumn("x", F.lit(1)).columns[-1] == "x"
