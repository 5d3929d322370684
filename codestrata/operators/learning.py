"""Vectors, labels, centroids and the classifier head."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as V
from ..functions.common import lookup, round_half_up
from ..session import cut
from .windows import first_per, top_n, validation_split

# Dimensions and classes of the feature model.
DIMENSIONS = (
    "lexical", "ast", "type", "control_flow", "data_flow", "dependency", "runtime", "benchmark", "security", "stability",
    "language", "environment", "hardware", "repair",
)
LABELS = ("safe", "flow_warning", "security_risk", "stability_risk", "performance_hotspot", "repair_candidate")
BASE_TRUST = {
    "rule_match": 76, "fault_sample": 82, "benchmark": 80, "sdk_api": 78, "version_constraint": 72, "repair_recipe": 76,
    "validation_evidence": 86, "library_entry": 68, "expert_seed": 74, "human_review": 70,
}
MARGIN = 0.42
MAX_LABELS, MAX_ANCHORS = 256, 1024
HOT_TOKEN_ROWS, HOT_TOKENS = 200_000, 2_000
# votes are counted in these units: 840 is a multiple of 1 to 8, so shares of up to eight tokens times two percentages come out whole
VOTE_UNITS = 840 * 10_000_000


def dim(name: str, dims: str = "dims") -> Column:
    return F.get(F.col(dims), F.lit(DIMENSIONS.index(name)))


def pseudo_label(source_table: Column, evidence: Column) -> Column:
    """Class of a 14-dimensional vector by thresholds, then by words of its evidence."""
    text = F.lower(evidence)
    return (
        F.when((dim("security") >= 0.62) | text.rlike("critical|sql|xss|exec|csrf|jwt|secret|unsafe"), "security_risk")
        .when((dim("stability") >= 0.66) | text.rlike("blocked|overflow|timeout|retry|offline|watchdog|race"), "stability_risk")
        .when((source_table == "flow_edges") & ((dim("stability") >= 0.42) | (dim("control_flow") >= 0.62)), "flow_warning")
        .when((dim("benchmark") >= 0.66) | text.rlike(r"complexity [7-9]|n\+1|unbounded|overfetch"), "performance_hotspot")
        .when((dim("repair") >= 0.58) | (source_table == "rule_matches"), "repair_candidate")
        .otherwise("safe"))


def vector_confidence(label: Column) -> Column:
    """Half length, half strength of the deciding dimension."""
    strength = (
        F.when(label == "security_risk", dim("security")).when(label == "stability_risk", dim("stability"))
        .when(label == "performance_hotspot", dim("benchmark"))
        .when(label == "flow_warning", F.greatest(dim("control_flow"), dim("data_flow")))
        .when(label == "repair_candidate", dim("repair"))
        .otherwise(1 - F.greatest(dim("security"), dim("stability"), dim("benchmark"))))
    score = round_half_up((F.least(F.lit(1.0), V.norm(F.col("dims")) / 1.75) * 0.5 + strength * 0.5) * 100)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def finish_vectors(rows: DataFrame) -> DataFrame:
    """Clamps ``dims`` and adds label, length and confidence; ``source_table, evidence`` must be present."""
    clamped = rows.withColumn("dims", F.transform("dims", V.clamp01))
    labelled = clamped.withColumn("label", pseudo_label(F.col("source_table"), F.col("evidence")))
    return labelled.withColumn("magnitude", F.round(V.norm(F.col("dims")), 3)).withColumn(
        "confidence", vector_confidence(F.col("label")))


def function_vectors(f: DataFrame) -> DataFrame:
    """One vector per function from its facts, degree and risk flags (``in_degree, out_degree`` required)."""
    has = lambda c, x: F.when(F.array_contains(c, x), 1.0).otherwise(0.0)
    share = lambda c, k: F.least(F.lit(1.0), F.size(c) / F.lit(float(k)))
    degree = F.col("in_degree") + F.col("out_degree")
    severe = F.greatest(*[has("risks", r) for r in ("code-injection", "command-execution", "sql-injection", "path-traversal")])
    dims = F.array(
        F.col("confidence") / 100.0, F.col("confidence") / 120.0, share("params", 6), F.least(F.lit(1.0), F.col("complexity") / 10.0),
        F.least(F.lit(1.0), degree / 8.0), share("external_inputs", 4), has("side_effects", "async-schedule") * 0.6,
        F.least(F.lit(1.0), F.col("complexity") / 12.0), severe * 0.8 + share("external_inputs", 4) * 0.2,
        F.greatest(has("risks", "infinite-loop"), has("risks", "overflow")) * 0.8, F.lit(0.5),
        has("external_inputs", "environment-variable") * 0.7, has("external_inputs", "network-device-input") * 0.4,
        F.least(F.lit(1.0), F.size("risks") / 3.0))
    rows = f.select(
        F.concat_ws(":", F.lit("function"), "function_id").alias("vec_id"), F.lit("project_functions").alias("source_table"),
        F.col("function_id").cast("string").alias("source_id"), "name", dims.alias("dims"),
        F.concat(F.lit("complexity "), F.col("complexity").cast("string")).alias("evidence"))
    return finish_vectors(rows)


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Vectors or labels of all sources in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def label_histogram(vectors: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Vectors per label, with zero rows for known labels that do not occur."""
    counts = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        return counts
    domain = vectors.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return domain.join(counts, "label", "left").fillna(0, ["n"])


def centroids(vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """Mean vector per label; with ``weight`` the weighted mean.

    Averages are taken per (label, dimension) with map-side combining; only one value per dimension is put together.
    """
    w = F.lit(1.0) if weight is None else weight
    flat = vectors.select("label", w.alias("_w"), F.posexplode("dims").alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("mean"))
    put = means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("centroid"))
    sizes = vectors.groupBy("label").agg(
        F.count(F.lit(1)).alias("samples"), round_half_up(F.avg("confidence")).alias("confidence"))
    return put.join(sizes, "label")


def merge_centroids(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """Supervised centroids, self-supervised ones where a label has none."""
    return first.unionByName(fallback.join(first.select("label"), "label", "left_anti"))


def centroid_literal(table: DataFrame) -> Column:
    """Centroids as a literal array.  Their number is the number of labels; more than ``MAX_LABELS`` is refused."""
    rows = table.select("label", "centroid", "confidence").orderBy("label").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError("too many labels for in-row centroid scoring")
    return F.array(*[
        F.struct(F.lit(r["label"]).alias("label"), F.array(*map(F.lit, map(float, r["centroid"]))).alias("centroid"),
                 F.lit(float(r["confidence"])).alias("confidence")) for r in rows
    ])


def contrastive_loss(vectors: DataFrame, table: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Mean of ``max(0, margin + own distance - nearest other distance)``; a map and one average."""
    near = F.transform(centroid_literal(table), lambda c: F.struct(
        c["label"].alias("label"), V.distance(F.col("dims"), c["centroid"]).alias("d")))
    rows = vectors.select("label", near.alias("_n"))
    own = F.array_max(F.transform(F.filter("_n", lambda n: n["label"] == F.col("label")), lambda n: n["d"]))
    other = F.array_min(F.transform(F.filter("_n", lambda n: n["label"] != F.col("label")), lambda n: n["d"]))
    return rows.agg(F.avg(F.coalesce(F.greatest(F.lit(0.0), margin + own - other), F.lit(0.0))).alias("loss"))


def supervised_loss(assigned: DataFrame, table: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Mean weighted distance to the teacher's centroid times trust; a label without centroid costs 1."""
    w = F.array(*map(F.lit, map(float, weights)))
    joined = assigned.join(table.select(F.col("label").alias("teacher_label"), "centroid"), "teacher_label", "left")
    cost = F.when(F.col("centroid").isNull(), 1.0).otherwise(
        V.weighted_distance(F.col("dims"), F.col("centroid"), w) * F.col("trust") / 100)
    return joined.agg(F.avg(cost).alias("loss"))


def score_vectors(vectors: DataFrame, table: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """Score of every vector for every centroid, clamped ``1 - distance + prior + confidence / 450``."""
    w = None if weights is None else F.array(*map(F.lit, map(float, weights)))
    rows = vectors.select("vec_id", "label", "dims", F.explode(centroid_literal(table)).alias("_c"))
    d = V.distance(F.col("dims"), F.col("_c.centroid")) if w is None else V.weighted_distance(F.col("dims"), F.col("_c.centroid"), w)
    prior = F.when(F.col("_c.label") == F.col("label"), 0.18).otherwise(0.04)
    return rows.select(
        "vec_id", F.col("label").alias("pseudo"), F.col("_c.label").alias("label"),
        V.clamp01(1 - d + prior + F.col("_c.confidence") / 450).alias("score"))


def predict(scores: DataFrame) -> DataFrame:
    """Best label per vector, ties by label order."""
    return scores.groupBy("vec_id").agg(F.min_by(F.struct("label", "score"), F.struct((-F.col("score")).alias("s"), "label")).alias("_b")).select(
        "vec_id", F.col("_b.label").alias("predicted"), F.col("_b.score").alias("score"))


def fuse_scores(centroid_scores: DataFrame, head_scores: DataFrame) -> DataFrame:
    """0.7 centroid score plus 0.3 head probability."""
    joined = centroid_scores.join(head_scores.withColumnRenamed("score", "_h"), ["vec_id", "label"], "left")
    return joined.select("vec_id", "label", (F.col("score") * 0.7 + F.coalesce("_h", F.lit(0.0)) * 0.3).alias("score"))


def nearest_pairs(vectors: DataFrame, anchors: int = 4) -> DataFrame:
    """C14: nearest vector of the same and of another label for the first anchors of each label.

    The anchors are few (``anchors`` per label, refused beyond ``MAX_ANCHORS``) and travel as a literal; each vector is
    compared with them in a map, and minima are combined before the shuffle.
    """
    picked = top_n(vectors, ["label"], [F.col("vec_id")], anchors).select("vec_id", "label", "dims").limit(MAX_ANCHORS + 1).collect()
    if len(picked) > MAX_ANCHORS:
        raise ValueError("too many anchors for in-row comparison")
    table = F.array(*[
        F.struct(F.lit(r["vec_id"]).alias("anchor"), F.lit(r["label"]).alias("anchor_label"),
                 F.array(*map(F.lit, map(float, r["dims"]))).alias("v")) for r in picked
    ])
    pairs = vectors.select("vec_id", "label", "dims", F.explode(table).alias("_a")).where(F.col("_a.anchor") != F.col("vec_id"))
    measured = pairs.select("vec_id", "label", F.col("_a.anchor").alias("anchor"), F.col("_a.anchor_label").alias("anchor_label"),
                            V.distance(F.col("dims"), F.col("_a.v")).alias("d"))
    same = F.col("label") == F.col("anchor_label")
    key = lambda cond: F.struct(F.when(cond, F.col("d")).alias("d"), F.when(cond, F.col("vec_id")).alias("vec_id"))
    out = measured.groupBy("anchor", "anchor_label").agg(
        F.min(F.when(same, key(same))).alias("_p"), F.min(F.when(~same, key(~same))).alias("_n"))
    return out.where("_p IS NOT NULL AND _n IS NOT NULL").select(
        "anchor", "anchor_label", F.col("_p.vec_id").alias("positive"), F.col("_p.d").alias("positive_distance"),
        F.col("_n.vec_id").alias("negative"), F.col("_n.d").alias("negative_distance"))


def update_weights(weights: DataFrame, table: DataFrame, rate: float) -> DataFrame:
    """Weight plus mean centroid value times rate, normalised to sum 1; ``weights``: ``pos, weight``."""
    pressure = table.select(F.posexplode("centroid").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("_p"))
    raw = weights.join(pressure, "pos", "left").withColumn("_raw", F.col("weight") + F.coalesce("_p", F.lit(0.0)) * rate)
    total = raw.agg(F.sum("_raw").alias("_t")).withColumn("_k", F.lit(1))
    return raw.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select("pos", "weight", (F.col("_raw") / F.col("_t")).alias("updated"))


def clamp_steps(weights: DataFrame, max_step: float) -> DataFrame:
    """Accepted weight after limiting the step; ``before, supervised, evolved, self_candidate, errors``."""
    candidate = F.col("supervised") * 0.56 + F.col("evolved") * 0.28 + F.col("self_candidate") * 0.16
    allowed = F.greatest(F.lit(0.0), max_step - F.col("errors") * 0.002)
    delta = candidate - F.col("before")
    accepted = F.when(F.lit(max_step) == 0, F.col("before")).otherwise(
        F.col("before") + F.greatest(-allowed, F.least(allowed, delta)))
    gate = F.when(allowed == 0, "rejected").when(F.abs(delta) <= allowed, "accepted").otherwise("clamped")
    return weights.select("*", candidate.alias("candidate"), accepted.alias("accepted"), gate.alias("gate"))


def match_labels(vectors: DataFrame, labels: DataFrame, threshold: float = 0.18) -> DataFrame:
    """Teacher labels that fit a vector.

    ``vectors``: ``vec_id, tokens``; ``labels``: ``label_id, target, tokens`` (and ``boost``).  A label with a target fits
    that vector alone.  The others need ``overlap / min(tokens, 8) + boost >= threshold``.  A label of n tokens that
    needs t shared ones must share one of its n-t+1 rarest tokens, so only those are join keys and only their rows are
    counted per (label, vector); the t-1 commonest ones are looked up afterwards, for the pairs found, by (vector, token).
    No token list travels with a pair, and a token of very many vectors is split into parts of bounded size.
    """
    exact = labels.where("target IS NOT NULL").select("label_id", F.col("target").alias("vec_id"), F.lit(1.0).alias("match_score"))
    exact = exact.join(vectors.select("vec_id"), "vec_id", "left_semi")
    free = labels.where("target IS NULL").withColumn("tokens", F.array_distinct("tokens")).withColumn("_n", F.size("tokens")).where("_n > 0")
    need = F.greatest(F.lit(1), F.ceil((F.lit(threshold) - F.col("boost")) * F.least(F.col("_n"), F.lit(8)) - 1e-9))
    held = vectors.select("vec_id", F.explode(F.array_distinct("tokens")).alias("token"))
    frequency = cut(held.groupBy("token").agg(F.count(F.lit(1)).alias("_f")))
    # at most HOT_TOKENS tokens can be above this size, as the sizes add up to the total
    part = max(HOT_TOKEN_ROWS, (frequency.agg(F.sum("_f")).first()[0] or 0) // HOT_TOKENS)
    parts = F.ceil(F.col("_f") / part).cast("int")
    hot = frequency.where(F.col("_f") > part).select("token", parts.alias("_parts"))
    spread = free.withColumn("_need", need.cast("int")).select(
        "label_id", "_need", "_n", "boost", F.explode("tokens").alias("token")).join(frequency, "token")
    # tokens no vector has cannot match and are the rarest of all; they only lower the number still to be looked at
    seen = spread.groupBy("label_id").agg(
        *[F.first(c).alias(c) for c in ("_need", "_n", "boost")],
        F.array_sort(F.collect_list(F.struct("_f", "token", parts.alias("_parts")))).alias("_t")).where(F.size("_t") >= F.col("_need"))
    rare = F.size("_t") - F.col("_need") + 1
    keys = seen.select(
        "label_id", F.named_struct(
            F.lit("_n"), F.col("_n"), F.lit("boost"), F.col("boost"),
            F.lit("rest"), F.transform(F.slice("_t", rare + 1, F.col("_need") - 1), lambda x: x["token"])).alias("_l"),
        F.explode(F.slice("_t", F.lit(1), rare)).alias("_k"))
    keys = keys.select("label_id", "_l", F.col("_k.token").alias("token"), F.explode(F.sequence(F.lit(0), F.col("_k._parts") - 1)).alias("_part"))
    placed = held.join(F.broadcast(hot), "token", "left").select(
        "vec_id", "token", F.pmod(F.xxhash64("vec_id"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    pairs = keys.join(placed, ["token", "_part"]).groupBy("label_id", "vec_id").agg(
        F.count(F.lit(1)).alias("_shared"), F.first("_l").alias("_l"))
    more = pairs.select("*", F.explode_outer("_l.rest").alias("token")).join(
        held.withColumn("_hit", F.lit(1)), ["vec_id", "token"], "left")
    full = more.groupBy("label_id", "vec_id").agg(
        (F.first("_shared") + F.coalesce(F.sum("_hit"), F.lit(0))).alias("_shared"), F.first("_l").alias("_l"))
    score = V.clamp01(F.col("_shared") / F.least(F.col("_l._n"), F.lit(8)) + F.col("_l.boost"))
    fuzzy = full.select("label_id", "vec_id", score.alias("match_score")).where(F.col("match_score") >= threshold)
    return exact.select("label_id", "vec_id", "match_score").unionByName(fuzzy)


def vote(candidates: DataFrame) -> DataFrame:
    """Winning label per vector, consensus, margin and quarantine reason.

    ``candidates``: ``vec_id, label, label_id, trust, label_confidence, match_score, targeted``.  Votes are whole numbers of
    ``1 / VOTE_UNITS``: their sums do not hang on the order of the rows, and equal votes stay equal.
    """
    weighted = candidates.withColumn("_v", round_half_up(
        F.col("match_score") * (F.col("trust") / 100) * (F.col("label_confidence") / 100) * F.lit(float(VOTE_UNITS))))
    best = F.struct((-F.col("_v")).alias("k"), "label_id", "trust", "match_score", "targeted")
    per_label = weighted.groupBy("vec_id", "label").agg(F.sum("_v").alias("_votes"), F.min(best).alias("_best"))
    ranked = F.struct((-F.col("_votes")).alias("k"), "label")
    summary = per_label.groupBy("vec_id").agg(
        F.sum("_votes").alias("_total"), F.count(F.lit(1)).alias("labels"), F.min_by(F.struct("label", "_votes", "_best"), ranked).alias("_w"))
    second = per_label.join(summary.select("vec_id", F.col("_w.label").alias("_wl")), "vec_id").where("label <> _wl").groupBy(
        "vec_id").agg(F.max("_votes").alias("_second"))
    out = summary.join(second, "vec_id", "left")
    out = out.withColumn("_top", F.col("_w._votes")).withColumn("_lead", F.col("_top") - F.coalesce("_second", F.lit(0)))
    # the rounded percentage, in whole numbers
    consensus = F.when(F.col("_total") == 0, F.lit(0)).otherwise(F.expr("(200 * _top + _total) div (2 * _total)"))
    out = out.withColumn("consensus", consensus.cast("long")).withColumn("margin", F.col("_lead") / F.lit(VOTE_UNITS))
    lead = F.col("_w._best")
    reason = (
        F.when(lead["trust"] < 52, "low_trust").when((lead["match_score"] < 0.28) & ~lead["targeted"], "weak_evidence")
        .when((F.col("labels") > 1) & (F.col("consensus") < 54), "teacher_conflict")
        .when((F.col("labels") > 1) & (F.col("consensus") < 64) & (F.col("_lead") < VOTE_UNITS // 100 * 8), "unsafe_consensus"))
    accepted = round_half_up(lead["trust"] * (0.66 + lead["match_score"] * 0.2 + F.col("consensus") / 700))
    return out.select(
        "vec_id", F.col("_w.label").alias("teacher_label"), lead["label_id"].alias("label_id"), "labels", "consensus", "margin",
        F.greatest(F.lit(0), F.least(F.lit(100), accepted)).alias("trust_score"), reason.alias("quarantine_reason"))


def teacher_reliability(labels: DataFrame, votes: DataFrame) -> DataFrame:
    """Reliability per source kind from accepted, quarantined and conflicting labels."""
    kinds = labels.groupBy("source_kind").agg(F.count(F.lit(1)).alias("label_count"))
    used = votes.join(labels.select("label_id", "source_kind"), "label_id").groupBy("source_kind").agg(
        F.count_if(F.col("quarantine_reason").isNull()).alias("accepted"),
        F.count_if(F.col("quarantine_reason").isNotNull()).alias("quarantined"),
        F.count_if(F.col("quarantine_reason").isin("teacher_conflict", "unsafe_consensus")).alias("conflicts"))
    out = kinds.join(used, "source_kind", "left").fillna(0, ["accepted", "quarantined", "conflicts"])
    n = F.greatest(F.lit(1), F.col("label_count"))
    score = round_half_up(
        lookup(F.col("source_kind"), BASE_TRUST, 70) + F.col("accepted") / n * 20 - F.col("quarantined") / n * 18 - F.col("conflicts") / n * 16)
    out = out.withColumn("reliability", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return out.withColumn("status", F.when(F.col("reliability") >= 76, "trusted").when(F.col("reliability") >= 55, "watch").otherwise("quarantined"))


def rollback_trigger(trust: Column, consensus: Column, quarantined: Column, conflicts: Column) -> Column:
    """M05."""
    return F.when((trust < 62) | (consensus < 55), "low-trust-or-consensus").when(
        (conflicts > 0) | (quarantined > 12), "teacher-conflict-quarantine").otherwise("stable-checkpoint")


def promotion_gate(status: Column, risk: Column, promotion: Column, health: Column) -> Column:
    """M11."""
    return F.when(status == "regressed", "rolled_back").when(risk >= 24, "isolated").when(
        (promotion >= 88) & (health >= 78), "promoted").otherwise("held")


def recipe_matches(recipes: DataFrame, matches: DataFrame) -> DataFrame:
    """Repair recipes that name a match's rule or share a tag with it (``recipe_id, rule_id, tags``)."""
    by_rule = recipes.select("recipe_id", "rule_id").join(matches.select("match_id", "rule_id"), "rule_id").select("recipe_id", "match_id")
    by_tag = recipes.select("recipe_id", F.explode("tags").alias("tag")).join(
        matches.select("match_id", F.explode("tags").alias("tag")), "tag").select("recipe_id", "match_id")
    return by_rule.unionByName(by_tag).distinct()


def choose_candidate(candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """Fittest weight set; with critical error signals only the guard and the parent may win.

    ``candidates``: ``group_id, candidate_id, kind, fitness``; ``errors``: ``group_id, impact, critical``.
    """
    e = errors.groupBy("group_id").agg(F.sum("impact").alias("impact"), F.count_if("critical").alias("critical"))
    joined = candidates.join(e, "group_id", "left").fillna(0, ["impact", "critical"])
    allowed = (F.col("critical") == 0) | F.col("kind").isin("guard", "parent")
    scored = joined.where(allowed).withColumn("_f", F.col("fitness") - F.col("impact") / 100)
    return first_per(scored.withColumn("_k", -F.col("_f")), ["group_id"], ["_k", "candidate_id"]).select(
        "group_id", "candidate_id", "kind", F.col("_f").alias("net_fitness"))


def error_signals(parts: dict[str, tuple[DataFrame, int]], keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Filtered branches (``severity, confidence, ref``) as signals; each branch keeps its strongest ``cap`` per project."""
    rows = []
    for kind, (df, cap) in parts.items():
        impact = F.least(F.lit(100.0), lookup(F.col("severity"), {"critical": 1.0, "risk": 0.72, "warn": 0.44}, 0.2) * F.col("confidence"))
        tagged = df.select(*keys, "ref", "severity", impact.alias("impact"), F.lit(kind).alias("kind"))
        rows.append(top_n(tagged, keys, [F.desc("impact"), F.col("ref")], cap))
    return union_rows(rows)


def train_head(vectors: DataFrame, features: int, classes: int, hidden: int = 12, max_iter: int = 60, seed: int = 7,
               stats: bool = True):
    """``features x hidden x classes`` perceptron with the every-fifth-row validation split.

    Trained by L-BFGS with sigmoid units over the whole table; sample-by-sample gradient steps are sequential and are
    not reproduced.  The candidate passes when it beats the majority class on the validation rows.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    prepared = validation_split(vectors, ["vec_id"]).select(
        "vec_id", F.col("class_index").cast("double").alias("label"), array_to_vector("dims").alias("features"), "is_validation")
    trainer = MultilayerPerceptronClassifier(layers=[features, hidden, classes], maxIter=max_iter, seed=seed)
    model = trainer.fit(prepared.where("NOT is_validation"))
    if not stats:
        return model, None
    scored = model.transform(prepared.where("is_validation"))
    result = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).first()
    base = prepared.where("is_validation").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        (F.max("n") / F.sum("n")).alias("base")).first()
    return model, {"accuracy": result["accuracy"], "baseline": base["base"], "validated": (result["accuracy"] or 0) > (base["base"] or 0)}


def score_head(model, vectors: DataFrame) -> DataFrame:
    """Class probabilities of every vector as rows ``vec_id, class_index, score``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(vectors.select("vec_id", array_to_vector("dims").alias("features")))
    return scored.select("vec_id", F.posexplode(vector_to_array("probability")).alias("class_index", "score"))


def bind_signals(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, inference: DataFrame, assignments: DataFrame,
                 errors: DataFrame) -> DataFrame:
    """Learning signals on map elements; an edge without an own vector inherits from its ends."""
    err = errors.groupBy("vec_id").agg(F.avg("impact").alias("impact"))
    own = vectors.select("source_id", "vec_id", "confidence").join(inference.select("vec_id", "predicted"), "vec_id", "left").join(
        assignments.select("vec_id", "teacher_label"), "vec_id", "left").join(err, "vec_id", "left")
    level = F.when(F.col("impact") >= 70, 3).when(F.col("impact") >= 40, 2).when(F.col("impact").isNotNull(), 1).otherwise(0)
    own = own.select("source_id", "predicted", "teacher_label", "confidence", level.alias("level"))
    per = own.groupBy("source_id").agg(F.max("level").alias("level"), F.avg("confidence").alias("score"))
    node_rows = nodes.join(per.withColumnRenamed("source_id", "node"), "node").select(
        F.col("node").alias("element"), "level", "score", F.lit("own").alias("origin"))
    direct = edges.join(per.withColumnRenamed("source_id", "edge_id"), "edge_id").select(
        F.col("edge_id").alias("element"), "level", "score", F.lit("own").alias("origin"))
    rest = edges.join(per.withColumnRenamed("source_id", "edge_id"), "edge_id", "left_anti")
    ends = rest.select("edge_id", F.explode(F.array("src", "dst")).alias("source_id")).join(per, "source_id").groupBy("edge_id").agg(
        F.max("level").alias("level"), F.avg("score").alias("score"))
    return node_rows.unionByName(direct).unionByName(
        ends.select(F.col("edge_id").alias("element"), "level", "score", F.lit("inherited").alias("origin")))
