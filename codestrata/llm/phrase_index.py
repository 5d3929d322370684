"""Benchmark decontamination over a positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_ROWS, ascii_lower, lookup, row_key

#: Everything that is no word character of the contract: ASCII apart from digits and lower-case letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind the last word of every text, so that its position is the number of words; no word can contain it.
_END = "\u0000"


def words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _GAP, -1), ""), F.array().cast("array<string>"))


@dataclass
class PhraseIndex:
    """Stored lists. ``postings``: doc_id, key, term, pos, context_from, context (words around, for list-opening terms).

    ``documents``: doc_id, key, n_words, one row per document.  ``segments``: the runs of windows of an item that open the
    same two lists.
    """

    postings: DataFrame
    documents: DataFrame
    segments: DataFrame
    n_segments: int
    window: int


def _tokens(docs: DataFrame) -> DataFrame:
    listed = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("words"))
    return listed.select("doc_id", "key", "words", F.posexplode(F.concat("words", F.array(F.lit(_END)))).alias("pos", "term"))


def build_index(docs: DataFrame, items: DataFrame, window: int = 13, bound: int = BROADCAST_ROWS) -> PhraseIndex:
    """Index the documents for the windows of ``items`` (item_id, text).

    First the number of postings of every test term is counted over all documents.  Each window then opens the lists of
    its two rarest terms, and a window with an unseen term opens none.  The postings of those terms are stored in the
    shared folder, with the words around the rarest one, so that a phrase is confirmed from the index alone and texts
    are never shuffled.  Test terms travel by broadcast only below ``bound`` rows and by a shuffle join beyond it.
    """
    listed = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    listed = cut(listed.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words").dropDuplicates(["item", "item_id"]))
    vocabulary = cut(listed.select(F.explode("words").alias("term")).distinct())
    n_terms = vocabulary.count()
    counts = cut(
        _tokens(docs).select("term").join(lookup(vocabulary, n_terms, bound), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    last = F.greatest(F.size("words") - window, F.lit(0))
    places = (
        listed.select("item", F.explode(F.sequence(F.lit(0), last)).alias("w"), "words")
        .select("item", "w", F.posexplode(F.slice("words", F.col("w") + 1, window)).alias("o", "term"))
        .join(counts, "term", "left")
        .groupBy("item", "w")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", (F.col("w") + F.col("o")).alias("at")))).alias("t"))
        .where(F.col("t")[0]["df"] > 0)
    )
    segments = (
        places.select(
            "item", "w", F.col("t")[0]["term"].alias("term1"), F.col("t")[0]["at"].alias("at1"), F.get("t", F.least(F.size("t") - 1, F.lit(1))).alias("u")
        )
        .groupBy("item", "term1", "at1", F.col("u.term").alias("term2"), F.col("u.at").alias("at2"))
        .agg(F.array_sort(F.collect_list("w")).alias("windows"))
        .join(listed.select("item", "words").dropDuplicates(["item"]), "item")
    )
    segments = cut(segments.withColumn("seg", F.xxhash64("item", "at1", "at2")))
    n_segments = segments.count()
    opened = segments.select(F.col("term1").alias("term"), F.lit(True).alias("opens")).unionByName(segments.select(F.col("term2").alias("term"), F.lit(False).alias("opens")))
    opened = opened.groupBy("term").agg(F.max("opens").alias("opens"))
    end = docs.sparkSession.createDataFrame([(_END, False)], "term string, opens boolean")
    opened = lookup(opened.unionByName(end), 2 * n_segments + 1, bound)
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    stored = cut(
        _tokens(docs)
        .join(opened, "term")
        .select(
            "doc_id", "key", "term", "pos", start.alias("context_from"), F.when(F.col("opens"), F.slice("words", start + 1, 2 * window - 1)).alias("context")
        )
    )
    items_of = listed.select("item", "item_id")
    segments = segments.join(items_of.groupBy("item").agg(F.collect_set("item_id").alias("item_ids")), "item", "left")
    return PhraseIndex(stored.where(F.col("term") != _END), stored.where(F.col("term") == _END).select("doc_id", "key", F.col("pos").alias("n_words")), segments, n_segments, window)


def _lists(index: PhraseIndex, which: int, bound: int) -> DataFrame:
    """Opened lists with their offset taken off: where the item would begin in the document."""
    side = index.segments.select(F.col(f"term{which}").alias("term"), "seg", F.col(f"at{which}").alias("at"), *(["item_ids", "windows", F.col("words").alias("item_words")] if which == 1 else []))
    found = index.postings if which == 2 else index.postings.where(F.col("context").isNotNull())
    found = found if which == 1 else found.drop("context", "context_from")
    return found.join(lookup(side, index.n_segments, bound), "term").withColumn("begin", F.col("pos") - F.col("at"))


def phrase_matches(index: PhraseIndex, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Exact occurrences of windows: doc_id, key, item_ids, start, length.

    The two offset-adjusted lists of a segment are intersected on (document, segment, begin); what is left is compared
    word by word with the stored context of the rarer term.
    """
    # one side is semi-joined, so repeated documents keep their rows but never multiply
    first = _lists(index, 1, bound).alias("a")
    second = _lists(index, 2, bound).select("doc_id", "key", "seg", "begin").alias("b")
    both = first.join(second, F.expr("a.doc_id <=> b.doc_id AND a.key = b.key AND a.seg = b.seg AND a.begin = b.begin"), "left_semi")
    at = lambda w: F.col("begin") + w - F.col("context_from")
    length = F.least(F.size("item_words"), F.lit(index.window))
    agrees = lambda w: (at(w) >= 0) & (F.slice("context", F.greatest(at(w), F.lit(0)) + 1, length) == F.slice("item_words", w + 1, length))
    return both.select("doc_id", "key", "item_ids", "begin", length.alias("length"), F.explode(F.filter("windows", agrees)).alias("w")).select(
        "doc_id", "key", "item_ids", (F.col("begin") + F.col("w")).alias("start"), "length"
    )


def proximity_matches(index: PhraseIndex, slack: int = 4, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Places where both opened terms of a segment stand, shifted by at most ``slack`` words against the item.

    doc_id, key, item_ids, begin (by the rarer term), shift; 0 is the order and distance of the item.  Begins meet in bins of
    ``slack`` + 1 positions, and a bin holds at most one posting per position.
    """
    width = slack + 1
    first = _lists(index, 1, bound).select("doc_id", "key", "seg", "item_ids", "begin", F.explode(F.array(*[F.floor(F.col("begin") / width) + d for d in (-1, 0, 1)])).alias("bin"))
    second = _lists(index, 2, bound).select("doc_id", "key", "seg", F.col("begin").alias("other"), F.floor(F.col("begin") / width).alias("bin"))
    a, b = first.alias("a"), second.alias("b")
    met = a.join(b, F.expr(f"a.doc_id <=> b.doc_id AND a.key = b.key AND a.seg = b.seg AND a.bin = b.bin AND abs(a.begin - b.other) <= {slack}"))
    return met.select("a.doc_id", "a.key", "item_ids", "begin", (F.col("other") - F.col("begin")).alias("shift")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, parts: int = 20, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, item_ids (sorted strings), contaminated.

    A word is hit if a window of ``window`` consecutive item words (or a whole shorter item) covers it; a document is
    contaminated if at least one in ``parts`` of its words is.  Null or empty texts have no words, an item without
    words has no window, a null item id hits but isn't listed; repeated rows get equal rows; an empty table on either side is allowed.
    """
    index = build_index(docs, items, window, bound)
    found = cut(phrase_matches(index, bound))
    spans = found.select("doc_id", "key", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = spans.withColumn("new", F.greatest(F.col("end") - reached, F.lit(0))).groupBy("doc_id", "key").agg(F.sum("new").alias("n_hit"))
    listed = (
        found.select("doc_id", "key", F.explode("item_ids").alias("item_id")).distinct().groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    )
    d, h, i = index.documents.alias("d"), hits.alias("h"), listed.alias("i")
    joined = d.join(h, F.expr("d.doc_id <=> h.doc_id AND d.key = h.key"), "left").join(i, F.expr("d.doc_id <=> i.doc_id AND d.key = i.key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.key").alias("key"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (parts * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
