"""Training signals and the weight sets bred from them.

Everything is keyed by ``group_id``, one model per group; all groups are worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import clamp, lookup, round_half_up
from .learning import DIMENSIONS, LABELS, union_rows
from .windows import first_per, top_n

# Weight of a severity and of a kind of signal.
SEVERITY_BASE = {"critical": 24.0, "risk": 13.0}
KIND_FACTOR = {
    "teacher_conflict": 1.35, "low_consensus": 0.95, "weak_evidence": 0.85, "high_confidence_low_evidence": 1.08,
    "prediction_teacher_drift": 1.2, "benchmark_deviation": 0.92, "repair_unverified": 0.88, "rollback_triggered": 1.6,
}
#: What shows in the evidence of a repair that it was tried out.
VERIFIED = r"(?i)test|验证|pass|benchmark"
STRATEGIES = ("parent", "mutation", "crossover", "guard")
#: Signals that a group keeps at most: six for each centroid, of which there is one for a class.
_MOST = max(16, 6 * len(LABELS))


def _whole(value: Column) -> Column:
    """Nearest whole number between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(value)))


def _impacts(signals: DataFrame) -> DataFrame:
    kind = F.col("signal_kind")
    confidence = _whole(F.col("confidence"))
    raw = lookup(F.col("severity"), SEVERITY_BASE, 6.0) * lookup(kind, KIND_FACTOR, 1.0) * (0.72 + confidence / 100 * 0.28)
    return signals.withColumns({
        "confidence": confidence,
        "confidence_impact": _whole(raw * F.when(kind == "high_confidence_low_evidence", 1.25).otherwise(0.82)),
        "knowledge_impact": _whole(raw * F.when(kind.isin("teacher_conflict", "weak_evidence"), 1.2).otherwise(0.9)),
        "fitness_impact": _whole(raw * F.when(kind.isin("rollback_triggered", "prediction_teacher_drift"), 1.25).otherwise(1.0)),
    })


def training_signals(vectors: DataFrame, assignments: DataFrame, quarantined: DataFrame, inference: DataFrame, groups: DataFrame) -> DataFrame:
    """The eight branches of error signals of every group, with what each costs.

    ``vectors``: ``group_id, vec_id, label, confidence, evidence``; ``assignments``: ``group_id, vec_id, teacher_label,
    trust, consensus, corrected, evidence``; ``quarantined``: ``group_id, vec_id, reason, label, confidence, evidence``;
    ``inference``: ``group_id, run_id, vec_id, predicted, confidence, evidence``; ``groups``: ``group_id, trigger, centroids``.

    A branch keeps its first rows by ``vec_id`` (the report's eight or six), a group its first ``max(16, 6 * centroids)`` in
    the order of the branches. Both limits are rank filters, which Spark applies before the shuffle.
    """
    key = ["group_id", "vec_id"]

    def branch(rows: DataFrame, place: int, kind: Column | str, severity: Column | str, label: str, confidence: Column, cap: int, order: str = "vec_id") -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        told = rows.select(
            "group_id", F.lit(place).alias("branch"), F.col(order).cast("string").alias("ref"), F.col(order).alias("_order"), lit(kind).alias("signal_kind"),
            lit(severity).alias("severity"), F.col(label).alias("label"), confidence.cast("double").alias("confidence"), "evidence")
        return top_n(told, ["group_id"], [F.col("_order"), F.col("label")], cap, "_at").drop("_order")

    trust, consensus, confidence = F.col("trust"), F.col("consensus"), F.col("confidence")
    reason = F.col("reason")
    risk_if = lambda x: F.when(x, "risk").otherwise("watch")
    taught = assignments.select(*key, F.col("teacher_label").alias("_taught"))
    known = assignments.select(*key).unionByName(quarantined.select(*key))
    differing = inference.join(taught, key).where("predicted <> _taught AND confidence >= 72")
    rolled = groups.where("trigger <> 'stable-checkpoint'").select("group_id", "trigger", F.lit(None).cast("string").alias("label"), F.col("trigger").alias("evidence"))
    parts = [
        branch(quarantined, 1, F.when(reason == "teacher_conflict", reason).when(reason == "unsafe_consensus", "low_consensus").otherwise("weak_evidence"),
               risk_if(reason == "teacher_conflict"), "label", confidence, _MOST),
        branch(assignments.where("corrected AND trust >= 78"), 2, "prediction_teacher_drift", risk_if(trust >= 86), "teacher_label", trust, 8),
        branch(assignments.where("consensus < 68"), 3, "low_consensus", risk_if(consensus < 54), "teacher_label", 100 - consensus, 8),
        branch(vectors.where("confidence >= 82").join(known, key, "left_anti"), 4, "high_confidence_low_evidence", risk_if(confidence >= 90), "label", confidence, 8),
        branch(assignments.where((F.col("teacher_label") == "repair_candidate") & ~F.coalesce(F.col("evidence"), F.lit("")).rlike(VERIFIED)), 5,
               "repair_unverified", "watch", "teacher_label", trust, 6),
        branch(assignments.where("teacher_label = 'performance_hotspot' AND trust < 76"), 6, "benchmark_deviation", "watch", "teacher_label", 100 - trust, 6),
        branch(rolled, 7, "rollback_triggered", "critical", "label", F.lit(90), 1, "trigger"),
        branch(differing, 8, "prediction_teacher_drift", risk_if(confidence >= 84), "predicted", confidence, 6, "run_id"),
    ]
    first = top_n(union_rows(parts), ["group_id"], [F.col("branch"), F.col("_at")], _MOST, "place")
    kept = first.join(groups.select("group_id", "centroids"), "group_id").where(F.col("place") <= F.greatest(F.lit(16), F.col("centroids") * 6))
    return _impacts(kept.drop("_at", "centroids"))


def _signal_totals(signals: DataFrame) -> DataFrame:
    return signals.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "risk").alias("risks"),
        F.avg("fitness_impact").alias("impact"),
        F.count_if((F.col("signal_kind") == "teacher_conflict") | (F.coalesce("label", F.lit("")) == "security_risk")).alias("security_pressure"),
        F.count_if((F.col("signal_kind") == "rollback_triggered") | (F.coalesce("label", F.lit("")) == "stability_risk")).alias("stability_pressure"))


def _with_totals(df: DataFrame, signals: DataFrame) -> DataFrame:
    counts = ["signals", "critical", "risks", "security_pressure", "stability_pressure"]
    return df.join(_signal_totals(signals), "group_id", "left").fillna(0, counts).fillna(0.0, ["impact"])


def breed(genes: DataFrame, groups: DataFrame, signals: DataFrame) -> DataFrame:
    """Four weight sets per group as rows ``group_id, strategy, kind, name, value``: parent, mutation, crossover, guard.

    ``genes``: ``group_id, kind, name, parent, supervised, candidate, reliability, status, accepted, conflicts`` with the
    kinds ``dimension`` (weights), ``teacher`` (reliability of 100 and counts) and ``language`` (name only);
    ``groups``: ``group_id, consensus, trust, conflict_count, quarantined_count``; ``signals``: of ``training_signals``.

    The two thresholds come from the group. The parent's dimension weights are inherited, or the supervised ones where there
    are none. Every set is computed on the gene's own row, so nothing but the counts per group and per named dimension is
    joined. Language gates appear in the mutation only.
    """
    c = F.col
    named = signals.select("group_id", F.explode(F.filter(
        F.array(*[F.lit(d) for d in DIMENSIONS]), lambda d: F.contains(F.lower(F.coalesce("evidence", F.lit(""))), d))).alias("name"))
    pressure = named.groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("pressure")).withColumn("kind", F.lit("dimension"))
    limits = groups.select("group_id", F.lit("threshold").alias("kind"), F.explode(F.array(F.lit("min_consensus"), F.lit("min_trust"))).alias("name"))
    rows = union_rows([genes, limits]).join(pressure, ["group_id", "kind", "name"], "left").fillna(0, ["pressure"])
    rows = _with_totals(rows.join(groups.select("group_id", "consensus", "trust", "conflict_count", "quarantined_count"), "group_id"), signals)
    of_consensus = c("name") == "min_consensus"
    kind, level = c("kind"), F.when(of_consensus, c("consensus")).otherwise(c("trust"))
    inherited = F.coalesce(c("parent"), c("supervised"))
    spelled = c("name") != "unknown"

    def by_kind(dimension, teacher, threshold, language=None):
        out = F.when(kind == "dimension", dimension).when(kind == "teacher", teacher).when(kind == "threshold", threshold)
        return out if language is None else out.when(kind == "language", language)

    third = lambda x: F.floor(x * 1000 + 0.5) / 1000
    rows = rows.withColumn("_stable", by_kind(inherited, c("reliability") / 100, level / 100)).withColumn("_delta", third(by_kind(
        (c("candidate") - inherited) * 100 - c("pressure"), F.when(c("status") == "trusted", 4.0).when(c("status") == "watch", -4.0).otherwise(-18.0),
        F.when(of_consensus, F.when(c("conflict_count") > 0, 6.0).otherwise(-2.0)).otherwise(F.when(c("quarantined_count") > 0, 4.0).otherwise(-1.0)),
        F.when(spelled, 2.0).otherwise(-8.0))))
    unit = lambda x: clamp(x, 0.0, 1.0)
    moved = unit(F.coalesce(c("_stable"), F.when(spelled, 78.0).otherwise(42.0) / 100) + c("_delta") / 600)
    floor = F.when(of_consensus, 0.58 + c("signals") * 0.004).otherwise(0.62 + c("signals") * 0.003)
    pushed = F.when(c("name") == "security", c("security_pressure")).when(c("name") == "stability", c("stability_pressure")).otherwise(0)
    mutation = by_kind(unit(moved + pushed * 0.012), moved, unit(F.greatest(moved, floor)), moved)
    lost = F.when(of_consensus, F.greatest(F.lit(70.0), c("consensus") - c("conflict_count") * 2)).otherwise(F.greatest(F.lit(72.0), c("trust") - c("quarantined_count")))
    crossover = by_kind(third((c("supervised") + c("candidate")) / 2), unit((c("reliability") + c("accepted") * 2 - c("conflicts") * 5) / 100), unit((level + lost) / 200))
    guard = by_kind(c("_stable"), c("_stable"), F.greatest(c("_stable"), F.when(of_consensus, 0.72).otherwise(0.76)))
    sets = F.array(*[F.struct(F.lit(s).alias("strategy"), v.cast("double").alias("value")) for s, v in zip(STRATEGIES, (c("_stable"), mutation, crossover, guard), strict=True)])
    return rows.select("group_id", "kind", "name", F.explode(sets).alias("_s")).where("_s.value IS NOT NULL").select(
        "group_id", "_s.strategy", "kind", "name", "_s.value")


def candidate_fitness(population: DataFrame, genes: DataFrame, groups: DataFrame, signals: DataFrame) -> DataFrame:
    """Fitness of each set: ``group_id, strategy, accuracy, stability, safety, generality, penalty, fitness, critical``.

    ``groups`` also needs ``improvement`` and ``centroids``.
    """
    c = F.col
    bars = population.where("kind = 'threshold'").groupBy("group_id", "strategy").agg(
        F.max(F.when(c("name") == "min_consensus", c("value"))).alias("bar_consensus"), F.max(F.when(c("name") == "min_trust", c("value"))).alias("bar_trust"))
    facts = genes.groupBy("group_id").agg(F.count_if(c("kind") == "language").alias("languages"), F.avg(F.when(c("kind") == "teacher", c("reliability"))).alias("reliable"))
    rows = _with_totals(bars.join(groups, "group_id").join(facts, "group_id", "left").fillna(0, ["languages", "reliable"]), signals)
    short = lambda bar, have: F.greatest(F.lit(0.0), c(bar) * 100 - c(have))
    rows = rows.withColumns({
        "accuracy": _whole(c("trust") * 0.42 + c("consensus") * 0.38 + c("improvement") * 0.2),
        "stability": _whole(100 - c("quarantined_count") * 3 - c("conflict_count") * 9 - c("critical") * 18),
        "safety": _whole(c("reliable") - c("risks") * 2),
        "generality": _whole(52 + c("languages") * 7 + c("centroids") * 5),
        "penalty": _whole(c("critical") * 22 + c("risks") * 5 + short("bar_consensus", "consensus") * 0.35 + short("bar_trust", "trust") * 0.3 + c("impact") * 0.7),
    })
    fitness = _whole(c("accuracy") * 0.32 + c("stability") * 0.26 + c("safety") * 0.26 + c("generality") * 0.16 - c("penalty") * 0.36)
    return rows.select("group_id", "strategy", "accuracy", "stability", "safety", "generality", "penalty", fitness.alias("fitness"), "critical")


def selected_candidate(fitness: DataFrame) -> DataFrame:
    """The set that each group goes on with: ``group_id, strategy, fitness, status``.

    The fittest wins (on ties the first of parent, mutation, crossover, guard) if it beats the parent by two points; a
    critical signal calls for the guard.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    best = first_per(fitness.select("group_id", "strategy", "critical", "fitness", (-F.col("fitness")).alias("_f"), place.alias("_p")), ["group_id"], ["_f", "_p"])
    parent = fitness.where("strategy = 'parent'").select("group_id", F.col("fitness").alias("_parent"))
    chosen = F.when(F.col("critical") > 0, "guard").when(F.col("fitness") >= F.col("_parent") + 2, F.col("strategy")).otherwise("parent")
    named = best.join(parent, "group_id").select("group_id", chosen.alias("strategy"))
    status = F.when(F.col("critical") > 0, "rollback").when(F.col("strategy").isin("mutation", "crossover"), "selected").otherwise("mutating")
    return named.join(fitness, ["group_id", "strategy"]).select("group_id", "strategy", "fitness", status.alias("status"))


def selected_weights(population: DataFrame, selected: DataFrame) -> DataFrame:
    """Dimension weights of the chosen sets, scaled to a sum of one: ``group_id, name, weight``."""
    own = population.where("kind = 'dimension'").join(selected.select("group_id", "strategy"), ["group_id", "strategy"])
    # a group has one weight for each dimension
    total = own.groupBy("group_id").agg(F.sum("value").alias("_total"))
    weight = F.floor(F.col("value") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")) * 1000 + 0.5) / 1000
    return own.join(total, "group_id").select("group_id", "name", weight.alias("weight"))
