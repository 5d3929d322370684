"""The dealt operators on the driver's tables, with the SQL that answers them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .doubling_dedup import strip_repeats
from .fill_in_middle import fill_in_middle, restored
from .group_join import near_duplicates
from .language_tree import language_id
from .license_scan import file_paths, licenses
from .nnpu import toxicity
from .pareto_mix import pareto_mix
from .phrase_index import contamination
from .phrase_stripes import collocations
from .preference_pairs import mask_of, preference_pairs, text_of
from .secret_links import secret_scan
from .segment_search import top_by_segments
from .token_transducer import token_counts


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference_pairs(table(spark, sf_dir, "conversations"))
    sides = [f(c).alias(f"{c}_{name}") for c in ("chosen", "rejected") for name, f in (("text", text_of), ("mask", mask_of))]
    return found.select(F.col("pair_id").cast("long").alias("pair_id"), "prompt_turns", "prompt", *sides)


def op2_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_by_segments(table(spark, sf_dir, "embeddings"))


def op6_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(file_paths(table(spark, sf_dir, "documents")))


def op11_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strip_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_OP1 = """
WITH t AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT * FROM t WHERE side = 0),
b AS (SELECT * FROM t WHERE side = 1),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.i = b.i),
p AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM m GROUP BY pair_id),
x AS (SELECT t.*, p.n, CASE WHEN role = 'assistant' THEN '1' ELSE '0' END || ':' || length(r) AS k FROM t JOIN p USING (pair_id))
SELECT pair_id, any_value(n)::INTEGER AS prompt_turns,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen_text,
       coalesce(string_agg(k, ',' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen_mask,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected_text,
       coalesce(string_agg(k, ',' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected_mask
FROM x GROUP BY pair_id
"""

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP4 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
d AS (SELECT doc_id, rid, coalesce(ws, []) AS ws FROM w),
b0 AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
b AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS m, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM b0, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM b),
g AS (
  SELECT rid, doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(ws) - m + 2)) AS u(i)),
hit AS (SELECT g.rid, b.item_id, g.i, g.m FROM g JOIN b ON g.m = b.m AND g.g = b.g),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + m)) AS u(p) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""

_OP11 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT o, i, array_to_string(ws[i:i + 19], ' ') AS g FROM d, unnest(range(1, len(ws) - 18)) AS u(i)),
k AS (SELECT o, i, row_number() OVER (PARTITION BY md5(g) ORDER BY o, i) AS nth FROM g),
p AS (SELECT DISTINCT o, p FROM k, unnest(range(i, i + 20)) AS u(p) WHERE nth > 1),
w AS (SELECT o, u.i AS p, ws[u.i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
s AS (SELECT w.o, string_agg(w.w, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w ANTI JOIN p ON w.o = p.o AND w.p = p.p GROUP BY w.o)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (o)
"""

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM ws GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM ws, unnest(range(1, 6)) AS a(k), unnest(range(1, len(ws) - k + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a FROM f WHERE k > 1),
gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS m
  ON c.lang = m.lang AND m.k > c.k AND contains(' ' || m.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * m.a >= 100 * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS x, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS y
  FROM (SELECT * FROM c ANTI JOIN gone USING (lang, phrase)) AS c, unnest(range(1, c.k)) AS u(j)),
s AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f AS y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN tot ON tot.lang = cuts.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS s FROM documents),
h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_pairs,
        op2_nnpu,
        op3_secret_links,
        op4_phrase_index,
        op5_segment_search,
        op6_token_transducer,
        op7_pareto_mix,
        op8_language_tree,
        op9_group_join,
        op10_license_scan,
        op11_doubling_dedup,
        op12_phrase_stripes,
        op13_fill_in_middle,
    )
}
ORACLES = {
    "op1_preference_pairs": _OP1,
    "op4_phrase_index": _OP4,
    "op5_segment_search": _OP5,
    "op11_doubling_dedup": _OP11,
    "op12_phrase_stripes": _OP12,
    "op13_fill_in_middle": _OP13,
}
