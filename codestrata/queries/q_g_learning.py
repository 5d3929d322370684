"""Vectors, labels, centroids, classifier, training signals and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evolution as E, learning as L
from ..session import cut
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS
from .facts import function_facts, with_degrees
from .registry import query


def vectors(b):
    return b.embeddings.select(
        "vec_id", F.col("label").cast("string").alias("label"), V.as_doubles(F.col("embedding")).alias("dims"),
        (50 + F.col("vec_id") % 50).alias("confidence"))


ORACLE_RELATIONS["vecs"] = "SELECT vec_id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS dims, 50 + vec_id % 50 AS confidence FROM embeddings"
ORACLE_DEPENDS["vecs"] = ()
ORACLE_RELATIONS["cents"] = """
    SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(dims) AS x, generate_subscripts(dims, 1) AS pos FROM vecs) GROUP BY label, pos) GROUP BY label"""
ORACLE_DEPENDS["cents"] = ("vecs",)
_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query("label_histogram", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM vecs GROUP BY label UNION ALL SELECT '99', CAST(0 AS BIGINT)")
def label_histogram(b):
    return L.label_histogram(vectors(b), [str(i) for i in range(10)] + ["99"])


@query("centroids", "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(dims) AS x, generate_subscripts(dims, 1) - 1 AS pos FROM vecs) GROUP BY label, pos")
def centroids(b):
    return L.centroids(vectors(b)).select("label", F.posexplode("centroid").alias("pos", "mean")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("weighted_centroids", "SELECT label, pos, round(sum(x * confidence) / sum(confidence), 6) AS mean FROM (SELECT label, confidence, unnest(dims) AS x, generate_subscripts(dims, 1) - 1 AS pos FROM vecs) GROUP BY label, pos")
def weighted_centroids(b):
    v = vectors(b)
    return L.centroids(v, F.col("confidence").cast("double")).select("label", F.posexplode("centroid").alias("pos", "mean")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("merged_centroids", "SELECT label, CASE WHEN label IN ('1', '2') THEN 'first' ELSE 'fallback' END AS origin FROM (SELECT DISTINCT label FROM vecs)")
def merged_centroids(b):
    v = vectors(b)
    first = L.centroids(v.where("label IN ('1', '2')")).withColumn("origin", F.lit("first"))
    return L.merge_centroids(first, L.centroids(v).withColumn("origin", F.lit("fallback"))).select("label", "origin")


@query("contrastive_loss", f"""
    SELECT round(avg(greatest(0, 0.42 + own - other)), 6) AS loss FROM (SELECT v.vec_id, max(d) FILTER (WHERE v.label = c.label) AS own, min(d) FILTER (WHERE v.label <> c.label) AS other
        FROM (SELECT v.vec_id, v.label AS vl, c.label AS cl, {_DIST.format(a='v.dims', b='c.centroid')} AS d FROM vecs v, cents c) x JOIN vecs v ON v.vec_id = x.vec_id JOIN cents c ON c.label = x.cl GROUP BY v.vec_id)""")
def contrastive_loss(b):
    v = vectors(b)
    return L.contrastive_loss(v, L.centroids(v)).select(F.round("loss", 6).alias("loss"))


@query("supervised_loss", f"""
    SELECT round(avg(CASE WHEN v.vec_id % 11 = 0 THEN 1 ELSE sqrt(0.5) * {_DIST.format(a='v.dims', b='c.centroid')} * (v.confidence / 100) END), 6) AS loss FROM vecs v JOIN cents c ON c.label = v.label""")
def supervised_loss(b):
    v = vectors(b)
    a = v.select("dims", F.col("confidence").alias("trust"), F.when(F.col("vec_id") % 11 == 0, "none").otherwise(F.col("label")).alias("teacher_label"))
    return L.supervised_loss(a, L.centroids(v), [0.5] * 64).select(F.round("loss", 6).alias("loss"))


@query("centroid_scores", f"""
    SELECT vec_id, label, round(greatest(0, least(1, 1 - d + CASE WHEN vl = label THEN 0.18 ELSE 0.04 END + conf / 450)), 5) AS score FROM (
        SELECT v.vec_id, v.label AS vl, c.label, {_DIST.format(a='v.dims', b='c.centroid')} AS d, floor(k.conf + 0.5) AS conf FROM vecs v, cents c JOIN (SELECT label, avg(confidence) AS conf FROM vecs GROUP BY label) k ON k.label = c.label)""")
def centroid_scores(b):
    v = vectors(b)
    return L.score_vectors(v, L.centroids(v)).select("vec_id", "label", F.round("score", 5).alias("score"))


@query("predictions", f"""
    SELECT vec_id, arg_min(label, (-score, label)) AS predicted FROM (SELECT v.vec_id, c.label, greatest(0, least(1, 1 - {_DIST.format(a='v.dims', b='c.centroid')} + CASE WHEN v.label = c.label THEN 0.18 ELSE 0.04 END + conf / 450)) AS score
        FROM vecs v, cents c JOIN (SELECT label, floor(avg(confidence) + 0.5) AS conf FROM vecs GROUP BY label) k ON k.label = c.label) GROUP BY vec_id""")
def predictions(b):
    v = vectors(b)
    return L.predict(L.score_vectors(v, L.centroids(v))).select("vec_id", "predicted")


@query("nearest_pairs", f"""
    WITH a AS (SELECT vec_id, label, dims FROM vecs QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 4),
         d AS (SELECT a.vec_id AS anchor, a.label AS anchor_label, v.vec_id, v.label, {_DIST.format(a='v.dims', b='a.dims')} AS d FROM a JOIN vecs v ON v.vec_id <> a.vec_id)
    SELECT anchor, anchor_label, arg_min(vec_id, (d, vec_id)) FILTER (WHERE label = anchor_label) AS positive, arg_min(vec_id, (d, vec_id)) FILTER (WHERE label <> anchor_label) AS negative FROM d GROUP BY 1, 2""")
def nearest_pairs(b):
    return L.nearest_pairs(vectors(b)).select("anchor", "anchor_label", "positive", "negative")


@query("weight_norm", """
    SELECT pos, round(raw / sum(raw) OVER (), 6) AS updated FROM (SELECT pos, 0.05 + pos * 0.001 + avg(x) * 0.05 AS raw FROM (SELECT unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM cents) GROUP BY pos)""")
def weight_norm(b):
    c = L.centroids(vectors(b))
    w = c.select(F.posexplode("centroid").alias("pos", "x")).select("pos").distinct().withColumn("weight", 0.05 + F.col("pos") * 0.001)
    return L.update_weights(w, c, 0.05).select(F.col("pos").cast("long").alias("pos"), F.round("updated", 6).alias("updated"))


@query("weight_steps", """
    SELECT p_partkey AS k, round(accepted, 6) AS accepted, gate FROM (SELECT *, CASE WHEN allowed = 0 THEN 'rejected' WHEN abs(d) <= allowed THEN 'accepted' ELSE 'clamped' END AS gate, before + greatest(-allowed, least(allowed, d)) AS accepted
      FROM (SELECT p_partkey, 0.1::DOUBLE AS before, greatest(0, 0.018::DOUBLE - (p_partkey % 12) * 0.002::DOUBLE) AS allowed, (p_size / 200.0::DOUBLE) * 0.56 + 0.1::DOUBLE * 0.28 + 0.1::DOUBLE * 0.16 - 0.1::DOUBLE AS d FROM part))""")
def weight_steps(b):
    w = b.part.select(F.col("p_partkey").alias("k"), F.lit(0.1).alias("before"), (F.col("p_size") / 200.0).alias("supervised"),
                      F.lit(0.1).alias("evolved"), F.lit(0.1).alias("self_candidate"), (F.col("p_partkey") % 12).alias("errors"))
    return L.clamp_steps(w, 0.018).select("k", F.round("accepted", 6).alias("accepted"), "gate")


@query("dominant_dimensions", "SELECT vec_id, array_to_string(list_transform(list_sort(list_zip(list_transform(dims, lambda x: -x), range(64)))[1:4], lambda z: 'd' || CAST(z[2] AS VARCHAR)), '|') AS top FROM vecs")
def dominant_dimensions(b):
    keys = F.array(*[F.lit(f"d{i}") for i in range(64)])
    return vectors(b).select("vec_id", F.array_join(V.top_dimensions(F.col("dims"), keys), "|").alias("top"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(dims, lambda x: x * x))), 6) AS norm FROM vecs")
def vector_norms(b):
    return vectors(b).select("vec_id", F.round(V.norm(F.col("dims")), 6).alias("norm"))


@query("function_vectors", """
    WITH d AS (SELECT function_id, confidence / 100.0::DOUBLE AS lex, least(1, complexity / 10.0::DOUBLE) AS cf, least(1, complexity / 12.0::DOUBLE) AS bench, least(1, len(risks) / 3.0::DOUBLE) AS rep,
        CASE WHEN list_has_any(risks, ['code-injection', 'command-execution', 'sql-injection', 'path-traversal']) THEN 0.8 ELSE 0 END + least(1, len(external_inputs) / 4.0::DOUBLE) * 0.2 AS sec,
        CASE WHEN list_has_any(risks, ['infinite-loop', 'overflow']) THEN 0.8 ELSE 0 END AS stab, complexity FROM factsd)
    SELECT 'function:' || CAST(function_id AS VARCHAR) AS vec_id, CASE WHEN sec >= 0.62 THEN 'security_risk' WHEN stab >= 0.66 THEN 'stability_risk' WHEN bench >= 0.66 OR regexp_matches('complexity ' || CAST(complexity AS VARCHAR), 'complexity [7-9]') THEN 'performance_hotspot'
        WHEN rep >= 0.58 THEN 'repair_candidate' ELSE 'safe' END AS label FROM d""")
def function_vectors(b):
    return L.function_vectors(with_degrees(function_facts(b), b.edges)).select("vec_id", "label")


def label_rows(b):
    """Every benchmark text is a teacher without target, every labelled document one with a target."""
    tok = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: F.length(t) >= 5))
    docs = b.documents.select(F.col("doc_id").alias("vec_id"), tok(F.col("text")).alias("tokens"))
    free = b.benchmark.select(
        F.col("item_id").alias("label_id"), F.lit(None).cast("long").alias("target"), tok(F.col("text")).alias("tokens"),
        F.lit(0.0).alias("boost"))
    aimed = b.labels.select((F.col("doc_id") + 1_000_000).alias("label_id"), F.col("doc_id").alias("target"),
                            F.array().cast("array<string>").alias("tokens"), F.lit(0.0).alias("boost"))
    return docs, free.unionByName(aimed)


ORACLE_RELATIONS["tvec"] = "SELECT doc_id AS vec_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: length(t) >= 5)) AS tokens FROM documents"
ORACLE_DEPENDS["tvec"] = ()
ORACLE_RELATIONS["tlab"] = """
    SELECT item_id AS label_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: length(t) >= 5)) AS tokens FROM benchmark"""
ORACLE_DEPENDS["tlab"] = ()
ORACLE_RELATIONS["lmatch"] = """
    SELECT doc_id + 1000000 AS label_id, doc_id AS vec_id, 1.0::DOUBLE AS match_score FROM labels WHERE doc_id IN (SELECT vec_id FROM tvec)
    UNION ALL SELECT label_id, vec_id, s FROM (SELECT label_id, vec_id, least(1, count(*) / CAST(least(n, 8) AS DOUBLE)) AS s
      FROM (SELECT label_id, len(tokens) AS n, unnest(tokens) AS t FROM tlab) JOIN (SELECT vec_id, unnest(tokens) AS t FROM tvec) USING (t) GROUP BY label_id, vec_id, n) WHERE s >= 0.18"""
ORACLE_DEPENDS["lmatch"] = ("tvec", "tlab")


@query("label_matches", "SELECT label_id, vec_id, round(match_score, 6) AS match_score FROM lmatch")
def label_matches(b):
    v, l = label_rows(b)
    return L.match_labels(v, l).select("label_id", "vec_id", F.round("match_score", 6).alias("match_score"))


def candidates(b):
    v, l = label_rows(b)
    m = L.match_labels(v, l)
    k = F.col("label_id")
    return m.select(
        "vec_id", "label_id", "match_score", F.concat(F.lit("c"), (k % 3).cast("string")).alias("label"), (50 + k % 45).alias("trust"),
        (60 + k % 40).alias("label_confidence"), (k >= 1_000_000).alias("targeted"))


ORACLE_RELATIONS["votes"] = """
    WITH c AS (SELECT vec_id, label_id, match_score, 'c' || CAST(label_id % 3 AS VARCHAR) AS label, 50 + label_id % 45 AS trust, label_id >= 1000000 AS targeted,
                 CAST(floor(match_score * ((50 + label_id % 45) / 100) * ((60 + label_id % 40) / 100) * 8400000000.0::DOUBLE + 0.5) AS BIGINT) AS v FROM lmatch),
         p AS (SELECT vec_id, label, sum(v) AS votes, arg_min(struct_pack(label_id := label_id, trust := trust, m := match_score, t := targeted), (-v, label_id)) AS best FROM c GROUP BY 1, 2),
         w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS r, sum(votes) OVER (PARTITION BY vec_id) AS total, count(*) OVER (PARTITION BY vec_id) AS labels,
                 coalesce(lead(votes) OVER (PARTITION BY vec_id ORDER BY votes DESC, label), 0) AS nxt FROM p)
    SELECT vec_id, label AS teacher_label, best.label_id AS label_id, labels, CAST((200 * votes + total) // (2 * total) AS BIGINT) AS consensus,
           CASE WHEN best.trust < 52 THEN 'low_trust' WHEN best.m < 0.28 AND NOT best.t THEN 'weak_evidence' WHEN labels > 1 AND (200 * votes + total) // (2 * total) < 54 THEN 'teacher_conflict'
                WHEN labels > 1 AND (200 * votes + total) // (2 * total) < 64 AND votes - nxt < 672000000 THEN 'unsafe_consensus' END AS quarantine_reason FROM w WHERE r = 1"""
ORACLE_DEPENDS["votes"] = ("lmatch",)


@query("teacher_votes", "SELECT vec_id, teacher_label, labels, consensus, quarantine_reason FROM votes")
def teacher_votes(b):
    return L.vote(candidates(b)).select("vec_id", "teacher_label", "labels", "consensus", "quarantine_reason")


@query("teacher_reliability", """
    WITH l AS (SELECT label_id, CASE label_id % 4 WHEN 0 THEN 'rule_match' WHEN 1 THEN 'benchmark' WHEN 2 THEN 'human_review' ELSE 'expert_seed' END AS source_kind FROM (SELECT item_id AS label_id FROM benchmark UNION ALL SELECT doc_id + 1000000 FROM labels)),
         u AS (SELECT source_kind, count(*) FILTER (WHERE quarantine_reason IS NULL) AS a, count(*) FILTER (WHERE quarantine_reason IS NOT NULL) AS q,
                 count(*) FILTER (WHERE quarantine_reason IN ('teacher_conflict', 'unsafe_consensus')) AS c FROM votes JOIN l USING (label_id) GROUP BY 1)
    SELECT source_kind, n AS label_count, coalesce(a, 0) AS accepted, coalesce(q, 0) AS quarantined, coalesce(c, 0) AS conflicts,
           CAST(greatest(0, least(100, floor(CASE source_kind WHEN 'rule_match' THEN 76 WHEN 'benchmark' THEN 80 WHEN 'human_review' THEN 70 ELSE 74 END + coalesce(a, 0) / n * 20 - coalesce(q, 0) / n * 18 - coalesce(c, 0) / n * 16 + 0.5))) AS BIGINT) AS reliability
    FROM (SELECT source_kind, count(*) AS n FROM l GROUP BY 1) LEFT JOIN u USING (source_kind)""")
def teacher_reliability(b):
    _, l = label_rows(b)
    k = F.col("label_id") % 4
    kinds = l.select("label_id", F.when(k == 0, "rule_match").when(k == 1, "benchmark").when(k == 2, "human_review").otherwise("expert_seed").alias("source_kind"))
    return L.teacher_reliability(kinds, L.vote(candidates(b))).drop("status")


@query("recipe_matches", """
    SELECT DISTINCT p.p_partkey AS recipe_id, n.n_nationkey AS match_id FROM part p JOIN nation n ON p.p_size = n.n_nationkey OR list_has_any(string_split(p.p_name, ' '), [CASE n.n_nationkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'ring' ELSE 'none' END])""")
def recipe_matches(b):
    recipes = b.part.select(F.col("p_partkey").alias("recipe_id"), F.col("p_size").alias("rule_id"), F.split("p_name", " ").alias("tags"))
    k = F.col("n_nationkey")
    m = b.nation.select(k.alias("match_id"), k.alias("rule_id"), F.array(F.when(k % 3 == 0, "red").when(k % 3 == 1, "ring").otherwise("none")).alias("tags"))
    return L.recipe_matches(recipes, m)


@query("chosen_candidates", """
    WITH e AS (SELECT l_suppkey AS g, sum(l_linenumber) AS impact, count(*) FILTER (WHERE l_quantity = 50 AND l_discount > 0.09) AS crit FROM lineitem GROUP BY 1)
    SELECT p_partkey % 100 AS group_id, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS candidate_id FROM part LEFT JOIN e ON g = p_partkey % 100
    WHERE coalesce(crit, 0) = 0 OR p_partkey % 4 IN (0, 3) GROUP BY 1""")
def chosen_candidates(b):
    k = F.col("p_partkey")
    c = b.part.select((k % 100).alias("group_id"), k.alias("candidate_id"), F.when(k % 4 == 0, "parent").when(k % 4 == 3, "guard").when(
        k % 4 == 1, "mutation").otherwise("crossover").alias("kind"), F.col("p_retailprice").alias("fitness"))
    e = b.lineitem.select(F.col("l_suppkey").alias("group_id"), F.col("l_linenumber").alias("impact"), ((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.09)).alias("critical"))
    return L.choose_candidate(c, e).select("group_id", "candidate_id")


@query("error_signals", """
    SELECT project_id, ref, kind FROM (SELECT l_suppkey AS project_id, l_orderkey * 10 + l_linenumber AS ref, CASE WHEN l_returnflag = 'A' THEN 'rule' ELSE 'run' END AS kind, l_partkey AS pk,
        row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY CASE l_linenumber WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.72::DOUBLE ELSE 0.2::DOUBLE END * l_quantity DESC, l_orderkey * 10 + l_linenumber) AS r,
        CASE WHEN l_returnflag = 'A' THEN 3 ELSE 2 END AS cap FROM (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N'))) WHERE r <= cap""")
def error_signals(b):
    base = b.lineitem.select(
        F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("l_quantity").alias("confidence"),
        F.when(F.col("l_linenumber") == 1, "critical").when(F.col("l_linenumber") == 2, "risk").otherwise("info").alias("severity"), "l_returnflag")
    return L.error_signals({"rule": (base.where("l_returnflag = 'A'"), 3), "run": (base.where("l_returnflag = 'N'"), 2)}).select("project_id", "ref", "kind")


_TEACHERS = ("rule_match", "benchmark", "version_constraint", "human_review")
_LABELS = "[" + ", ".join(f"'{x}'" for x in L.LABELS) + "]"
_DIMS = "[" + ", ".join(f"'{x}'" for x in L.DIMENSIONS) + "]"
_SIGNALS = f"""o AS (SELECT o_custkey % 60 AS g, o_orderkey AS v, o_orderkey % 10 AS st, {_LABELS}[o_orderkey % 6 + 1] AS label, {_LABELS}[o_orderkey // 7 % 6 + 1] AS teacher,
        {_LABELS}[o_orderkey // 5 % 6 + 1] AS predicted, 55 + o_orderkey * 11 % 45 AS trust, 40 + o_orderkey * 7 % 60 AS consensus, 60 + o_orderkey * 13 % 40 AS conf,
        o_orderpriority || ' ' || {_LABELS}[o_orderkey % 6 + 1] AS ev, ['teacher_conflict', 'unsafe_consensus', 'low_trust'][o_orderkey // 10 % 3 + 1] AS reason FROM orders),
      g AS (SELECT g, 50 + g * 7 % 50 AS consensus, 50 + g * 11 % 50 AS trust, g % 10 AS improvement, g % 7 AS centroids, count(*) FILTER (WHERE st IN (6, 7)) // 20 AS quar,
        count(*) FILTER (WHERE st IN (6, 7) AND reason = 'teacher_conflict') // 20 AS conf, CASE WHEN g % 5 = 0 THEN 'low-trust-or-consensus' ELSE 'stable-checkpoint' END AS trig FROM o GROUP BY g),
      b AS (
        SELECT g, 1 AS branch, 36 AS cap, CAST(v AS VARCHAR) AS ref, v AS k, CASE reason WHEN 'teacher_conflict' THEN reason WHEN 'unsafe_consensus' THEN 'low_consensus' ELSE 'weak_evidence' END AS kind,
          CASE reason WHEN 'teacher_conflict' THEN 'risk' ELSE 'watch' END AS sev, label, conf AS c, ev FROM o WHERE st IN (6, 7)
        UNION ALL SELECT g, 2, 8, CAST(v AS VARCHAR), v, 'prediction_teacher_drift', CASE WHEN trust >= 86 THEN 'risk' ELSE 'watch' END, teacher, trust, ev FROM o WHERE st < 6 AND label <> teacher AND trust >= 78
        UNION ALL SELECT g, 3, 8, CAST(v AS VARCHAR), v, 'low_consensus', CASE WHEN consensus < 54 THEN 'risk' ELSE 'watch' END, teacher, 100 - consensus, ev FROM o WHERE st < 6 AND consensus < 68
        UNION ALL SELECT g, 4, 8, CAST(v AS VARCHAR), v, 'high_confidence_low_evidence', CASE WHEN conf >= 90 THEN 'risk' ELSE 'watch' END, label, conf, ev FROM o WHERE st > 7 AND conf >= 82
        UNION ALL SELECT g, 5, 6, CAST(v AS VARCHAR), v, 'repair_unverified', 'watch', teacher, trust, ev FROM o WHERE st < 6 AND teacher = 'repair_candidate' AND NOT regexp_matches(lower(ev), 'test|pass|benchmark')
        UNION ALL SELECT g, 6, 6, CAST(v AS VARCHAR), v, 'benchmark_deviation', 'watch', teacher, 100 - trust, ev FROM o WHERE st < 6 AND teacher = 'performance_hotspot' AND trust < 76
        UNION ALL SELECT g, 7, 1, trig, 0, 'rollback_triggered', 'critical', NULL, 90, trig FROM g WHERE trig <> 'stable-checkpoint'
        UNION ALL SELECT g, 8, 6, CAST(v * 2 AS VARCHAR), v, 'prediction_teacher_drift', CASE WHEN conf >= 84 THEN 'risk' ELSE 'watch' END, predicted, conf, ev FROM o WHERE st < 6 AND predicted <> teacher AND conf >= 72),
      r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY branch, k) AS place FROM (SELECT *, row_number() OVER (PARTITION BY g, branch ORDER BY k) AS n FROM b) WHERE n <= cap),
      w AS (SELECT r.*, CASE sev WHEN 'critical' THEN 24::DOUBLE WHEN 'risk' THEN 13::DOUBLE ELSE 6::DOUBLE END * CASE kind WHEN 'teacher_conflict' THEN 1.35::DOUBLE WHEN 'low_consensus' THEN 0.95::DOUBLE
          WHEN 'weak_evidence' THEN 0.85::DOUBLE WHEN 'high_confidence_low_evidence' THEN 1.08::DOUBLE WHEN 'prediction_teacher_drift' THEN 1.2::DOUBLE WHEN 'benchmark_deviation' THEN 0.92::DOUBLE
          WHEN 'repair_unverified' THEN 0.88::DOUBLE ELSE 1.6::DOUBLE END * (0.72::DOUBLE + c / 100 * 0.28::DOUBLE) AS raw FROM r JOIN g USING (g) WHERE place <= greatest(16, centroids * 6)),
      s AS (SELECT g AS group_id, CAST(place AS BIGINT) AS place, kind AS signal_kind, sev AS severity, ref, label, c AS confidence, ev,
        CAST(floor(raw * CASE kind WHEN 'high_confidence_low_evidence' THEN 1.25::DOUBLE ELSE 0.82::DOUBLE END + 0.5) AS BIGINT) AS confidence_impact,
        CAST(floor(raw * CASE WHEN kind IN ('teacher_conflict', 'weak_evidence') THEN 1.2::DOUBLE ELSE 0.9::DOUBLE END + 0.5) AS BIGINT) AS knowledge_impact,
        CAST(floor(raw * CASE WHEN kind IN ('rollback_triggered', 'prediction_teacher_drift') THEN 1.25::DOUBLE ELSE 1::DOUBLE END + 0.5) AS BIGINT) AS fitness_impact FROM w)"""


def _training(b):
    k = F.col("o_orderkey")
    pick = lambda at: F.element_at(F.array(*[F.lit(x) for x in L.LABELS]), (at + 1).cast("int"))
    label, teacher, state = pick(k % 6), pick(F.floor(k / 7) % 6), k % 10
    evidence = F.concat_ws(" ", "o_orderpriority", label)
    reason = F.element_at(F.array(F.lit("teacher_conflict"), F.lit("unsafe_consensus"), F.lit("low_trust")), (F.floor(k / 10) % 3 + 1).cast("int"))
    o = b.orders.select(
        (F.col("o_custkey") % 60).alias("group_id"), k.alias("vec_id"), state.alias("state"), label.alias("label"), teacher.alias("teacher_label"), (k * 2).alias("run_id"),
        pick(F.floor(k / 5) % 6).alias("predicted"), (55 + k * 11 % 45).alias("trust"), (40 + k * 7 % 60).alias("consensus"), (60 + k * 13 % 40).alias("confidence"),
        evidence.alias("evidence"), reason.alias("reason"), (label != teacher).alias("corrected"))
    g = F.col("group_id")
    held = F.col("state").isin(6, 7)
    groups = o.groupBy("group_id").agg(F.count_if(held).alias("_q"), F.count_if(held & (F.col("reason") == "teacher_conflict")).alias("_c")).select(
        "group_id", (50 + g * 7 % 50).alias("consensus"), (50 + g * 11 % 50).alias("trust"), (g % 10).alias("improvement"), (g % 7).alias("centroids"),
        F.floor(F.col("_q") / 20).alias("quarantined_count"), F.floor(F.col("_c") / 20).alias("conflict_count"),
        F.when(g % 5 == 0, "low-trust-or-consensus").otherwise("stable-checkpoint").alias("trigger"))
    return groups, E.training_signals(o, o.where("state < 6"), o.where(held), o, groups)


@query("training_signals", f"""WITH {_SIGNALS}
    SELECT group_id, place, signal_kind, severity, ref, label, CAST(confidence AS BIGINT) AS confidence, confidence_impact, knowledge_impact, fitness_impact FROM s""")
def training_signals(b):
    return _training(b)[1].select("group_id", F.col("place").cast("long").alias("place"), "signal_kind", "severity", "ref", "label", *[
        F.col(c).cast("long").alias(c) for c in ("confidence", "confidence_impact", "knowledge_impact", "fitness_impact")])


_BRED = _SIGNALS + f""",
      d AS (SELECT g.*, unnest({_DIMS}) AS name, unnest(range(14)) AS i FROM g),
      t AS (SELECT g.*, unnest({list(_TEACHERS)}) AS name, unnest(range(4)) AS i FROM g),
      tr AS (SELECT *, 40 + (g * 13 + i * 17) % 60 AS rel, (g + i) % 9 AS acc, g * i % 4 AS cf FROM t),
      x AS (SELECT group_id AS g, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS crit, count(*) FILTER (WHERE severity = 'risk') AS risk, avg(fitness_impact) AS imp,
        count(*) FILTER (WHERE signal_kind = 'teacher_conflict' OR label = 'security_risk') AS sec, count(*) FILTER (WHERE signal_kind = 'rollback_triggered' OR label = 'stability_risk') AS stab FROM s GROUP BY 1),
      pr AS (SELECT group_id AS g, name, count(*) AS p FROM (SELECT group_id, ev, unnest({_DIMS}) AS name FROM s) WHERE contains(lower(ev), name) GROUP BY 1, 2),
      dv AS (SELECT d.g, d.name, coalesce(p, 0) AS p, (5 + (d.g + i) % 20) / 100 AS sup, (5 + (d.g * 3 + i * 5) % 30) / 100 AS cand, coalesce(CASE WHEN d.g % 3 > 0 THEN (10 + d.g * i % 37) / 100 END, (5 + (d.g + i) % 20) / 100) AS inh
        FROM d LEFT JOIN pr ON pr.g = d.g AND pr.name = d.name),
      dm AS (SELECT dv.*, sec, stab, greatest(0, least(1, inh + floor(((cand - inh) * 100 - p) * 1000 + 0.5) / 1000 / 600)) AS m FROM dv LEFT JOIN x ON x.g = dv.g),
      th AS (SELECT g.g, name, name = 'min_consensus' AS ic, CASE WHEN name = 'min_consensus' THEN g.consensus ELSE g.trust END AS lev, quar, conf, coalesce(n, 0) AS n FROM g LEFT JOIN x ON x.g = g.g, (SELECT unnest(['min_consensus', 'min_trust']) AS name)),
      tm AS (SELECT *, greatest(0, least(1, lev / 100 + CASE WHEN ic THEN CASE WHEN conf > 0 THEN 6::DOUBLE ELSE -2::DOUBLE END ELSE CASE WHEN quar > 0 THEN 4::DOUBLE ELSE -1::DOUBLE END END / 600)) AS m,
        CASE WHEN ic THEN greatest(70, lev - conf * 2) ELSE greatest(72, lev - quar) END AS lost FROM th),
      lg AS (SELECT g, unnest(CASE WHEN g % 2 = 0 THEN ['c', 'python'] ELSE ['unknown'] END) AS name FROM g),
      pop AS (
        SELECT g AS group_id, 'dimension' AS kind, name, unnest(['parent', 'mutation', 'crossover', 'guard']) AS strategy, unnest([inh, CASE name WHEN 'security' THEN greatest(0, least(1, m + coalesce(sec, 0) * 0.012::DOUBLE))
            WHEN 'stability' THEN greatest(0, least(1, m + coalesce(stab, 0) * 0.012::DOUBLE)) ELSE m END, floor((sup + cand) / 2 * 1000 + 0.5) / 1000, inh]) AS value FROM dm
        UNION ALL SELECT g, 'teacher', name, unnest(['parent', 'mutation', 'crossover', 'guard']), unnest([rel / 100, greatest(0, least(1, rel / 100 + CASE WHEN rel >= 76 THEN 4::DOUBLE WHEN rel >= 55 THEN -4::DOUBLE ELSE -18::DOUBLE END / 600)),
            greatest(0, least(1, (rel + acc * 2 - cf * 5) / 100)), rel / 100]) FROM tr
        UNION ALL SELECT g, 'threshold', name, unnest(['parent', 'mutation', 'crossover', 'guard']), unnest([lev / 100, greatest(0, least(1, greatest(m, CASE WHEN ic THEN 0.58::DOUBLE + n * 0.004::DOUBLE ELSE 0.62::DOUBLE + n * 0.003::DOUBLE END))),
            greatest(0, least(1, (lev + lost) / 200)), greatest(lev / 100, CASE WHEN ic THEN 0.72::DOUBLE ELSE 0.76::DOUBLE END)]) FROM tm
        UNION ALL SELECT g, 'language', name, 'mutation', greatest(0, least(1, CASE WHEN name = 'unknown' THEN 42::DOUBLE / 100 ELSE 78::DOUBLE / 100 END + CASE WHEN name = 'unknown' THEN -8::DOUBLE ELSE 2::DOUBLE END / 600)) FROM lg),
      bars AS (SELECT group_id AS g, strategy, max(value) FILTER (WHERE name = 'min_consensus') AS bc, max(value) FILTER (WHERE name = 'min_trust') AS bt FROM pop WHERE kind = 'threshold' GROUP BY 1, 2),
      fit0 AS (SELECT bars.*, coalesce(crit, 0) AS crit, floor(g.trust * 0.42::DOUBLE + g.consensus * 0.38::DOUBLE + improvement * 0.2::DOUBLE + 0.5) AS acc, 100 - quar * 3 - conf * 9 - coalesce(crit, 0) * 18 AS stb,
          floor(rel - coalesce(risk, 0) * 2 + 0.5) AS saf, 52 + nl * 7 + centroids * 5 AS gen,
          floor(coalesce(crit, 0) * 22 + coalesce(risk, 0) * 5 + greatest(0, bc * 100 - g.consensus) * 0.35::DOUBLE + greatest(0, bt * 100 - g.trust) * 0.3::DOUBLE + coalesce(imp, 0) * 0.7::DOUBLE + 0.5) AS pen
        FROM bars JOIN g ON g.g = bars.g LEFT JOIN x ON x.g = bars.g JOIN (SELECT g, avg(rel) AS rel FROM tr GROUP BY 1) r ON r.g = bars.g JOIN (SELECT g, count(*) AS nl FROM lg GROUP BY 1) l ON l.g = bars.g),
      fit1 AS (SELECT g, strategy, crit, greatest(0, least(100, acc)) AS acc, greatest(0, least(100, stb)) AS stb, greatest(0, least(100, saf)) AS saf, greatest(0, least(100, gen)) AS gen, greatest(0, least(100, pen)) AS pen FROM fit0),
      fit AS (SELECT *, greatest(0, least(100, floor(acc * 0.32::DOUBLE + stb * 0.26::DOUBLE + saf * 0.26::DOUBLE + gen * 0.16::DOUBLE - pen * 0.36::DOUBLE + 0.5))) AS f FROM fit1),
      best AS (SELECT g, arg_max(strategy, (f, -list_position(['parent', 'mutation', 'crossover', 'guard'], strategy))) AS strategy, max(f) AS f, max(f) FILTER (WHERE strategy = 'parent') AS pf, max(crit) AS crit FROM fit GROUP BY 1),
      sel AS (SELECT g, crit, CASE WHEN crit > 0 THEN 'guard' WHEN f >= pf + 2 THEN strategy ELSE 'parent' END AS strategy FROM best)"""


def _bred(b):
    groups, signals = _training(b)
    g, i = F.col("group_id"), F.col("i")
    named = lambda names: groups.select("group_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "name"))
    dims = named(L.DIMENSIONS).select(
        "group_id", F.lit("dimension").alias("kind"), "name", F.when(g % 3 > 0, (10 + g * i % 37) / 100).alias("parent"), ((5 + (g + i) % 20) / 100).alias("supervised"),
        ((5 + (g * 3 + i * 5) % 30) / 100).alias("candidate"))
    reliability = 40 + (g * 13 + i * 17) % 60
    teachers = named(_TEACHERS).select(
        "group_id", F.lit("teacher").alias("kind"), "name", reliability.alias("reliability"), F.when(reliability >= 76, "trusted").when(reliability >= 55, "watch").otherwise("quarantined").alias("status"),
        ((g + i) % 9).alias("accepted"), (g * i % 4).alias("conflicts"))
    spoken = F.when(g % 2 == 0, F.array(F.lit("c"), F.lit("python"))).otherwise(F.array(F.lit("unknown")))
    genes = L.union_rows([dims, teachers, groups.select("group_id", F.lit("language").alias("kind"), F.explode(spoken).alias("name"))])
    signals = cut(signals)
    return groups, genes, signals, E.breed(genes, groups, signals)


@query("bred_candidates", f"WITH {_BRED} SELECT group_id, strategy, kind, name, value FROM pop")
def bred_candidates(b):
    return _bred(b)[3].select("group_id", "strategy", "kind", "name", "value")


@query("candidate_fitness", f"""WITH {_BRED}
    SELECT g AS group_id, strategy, CAST(acc AS BIGINT) AS accuracy, CAST(stb AS BIGINT) AS stability, CAST(saf AS BIGINT) AS safety, CAST(gen AS BIGINT) AS generality, CAST(pen AS BIGINT) AS penalty, CAST(f AS BIGINT) AS fitness FROM fit""")
def candidate_fitness(b):
    groups, genes, signals, population = _bred(b)
    return E.candidate_fitness(population, genes, groups, signals).select("group_id", "strategy", *[
        F.col(c).cast("long").alias(c) for c in ("accuracy", "stability", "safety", "generality", "penalty", "fitness")])


@query("selected_weights", f"""WITH {_BRED},
      own AS (SELECT sel.g, sel.strategy, name, value FROM sel JOIN pop ON sel.g = group_id AND sel.strategy = pop.strategy AND kind = 'dimension')
    SELECT own.g AS group_id, own.strategy, CASE WHEN sel.crit > 0 THEN 'rollback' WHEN own.strategy IN ('mutation', 'crossover') THEN 'selected' ELSE 'mutating' END AS status, name,
      floor(value / sum(value) OVER (PARTITION BY own.g) * 1000 + 0.5) / 1000 AS weight FROM own JOIN sel USING (g)""")
def selected_weights(b):
    groups, genes, signals, population = _bred(b)
    population = cut(population)
    chosen = cut(E.selected_candidate(E.candidate_fitness(population, genes, groups, signals)))
    return E.selected_weights(population, chosen).join(chosen, "group_id").select("group_id", "strategy", "status", "name", "weight")


@query("promotion_gates", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'rolled_back' WHEN o_custkey % 40 >= 24 THEN 'isolated' WHEN o_orderkey % 101 >= 88 AND o_custkey % 100 >= 78 THEN 'promoted' ELSE 'held' END AS gate,
           CASE WHEN o_orderkey % 101 < 62 OR o_custkey % 100 < 55 THEN 'low-trust-or-consensus' WHEN o_orderkey % 3 > 0 OR o_custkey % 20 > 12 THEN 'teacher-conflict-quarantine' ELSE 'stable-checkpoint' END AS rollback FROM orders""")
def promotion_gates(b):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return b.orders.select(
        "o_orderkey", L.promotion_gate(F.when(k % 13 == 0, "regressed").otherwise("stable"), c % 40, k % 101, c % 100).alias("gate"),
        L.rollback_trigger(k % 101, c % 100, c % 20, k % 3).alias("rollback"))


@query("signal_bindings", """
    WITH per AS (SELECT event_id AS s, CASE WHEN value >= 70 THEN 3 WHEN value >= 40 THEN 2 ELSE 1 END AS level, 50.0::DOUBLE + event_id % 10 AS score FROM events WHERE event_id % 2 = 0)
    SELECT s AS element, level, score, 'own' AS origin FROM per
    UNION ALL SELECT 1000000 + event_id, max(level), avg(score), 'inherited' FROM events JOIN per ON s IN (event_id, event_id + 1) WHERE event_id < (SELECT max(event_id) FROM events) GROUP BY event_id""")
def signal_bindings(b):
    e = b.events
    vec = e.where("event_id % 2 = 0").select(F.col("event_id").alias("source_id"), F.col("event_id").alias("vec_id"), (50.0 + F.col("event_id") % 10).alias("confidence"))
    inf = vec.select("vec_id", F.lit("safe").alias("predicted"))
    asg = vec.select("vec_id", F.lit("safe").alias("teacher_label"))
    err = e.select(F.col("event_id").alias("vec_id"), F.col("value").alias("impact"))
    top = e.agg(F.max("event_id").alias("_m")).withColumn("_k", F.lit(1))
    edges = e.withColumn("_k", F.lit(1)).join(F.broadcast(top), "_k").where("event_id < _m").select(
        (1_000_000 + F.col("event_id")).alias("edge_id"), F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"))
    return L.bind_signals(e.select(F.col("event_id").alias("node")), edges, vec, inf, asg, err)


@query("mlp_head")
def mlp_head(b):
    v = vectors(b).withColumn("class_index", F.col("label").cast("int"))
    model, _ = L.train_head(v, 64, 10, max_iter=30, stats=False)
    return L.score_head(model, v)
