"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD, lookup, packed, row_key, uniform, unpacked

#: Buckets of one refinement of the cut-off search; two refinements leave one row in sixteen million.
FINE = 4096


def source_targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Target words per source: weights 1, 2, 3 repeating in code-point order (null last), none above ``cap`` times its size.

    ``sources``: source, source_size.  What a source cannot take is shared again by weight among the others; the fixed
    point is min(cap * size, level * weight), and the level is found on the sources ordered by the weight they saturate
    at.  The table has one row per source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = sources.select(
        "source",
        "source_size",
        total.alias("_total"),
        (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).alias("weight"),
    ).withColumn("_at", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    return (
        ranked.withColumn("_level", level)
        .withColumn("_mu", F.min_by("_level", F.when(F.col("_level") <= F.col("_at") * (1 + 1e-12), F.struct("_at", F.col("source").isNull(), "source"))).over(Window.partitionBy()))
        .select(
            "source",
            "source_size",
            "weight",
            F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("_mu"), F.lit(0.0)) * F.col("weight")).alias("target"),
        )
    )


def expected_copies(levels: DataFrame, cap: int = 3) -> DataFrame:
    """Expected copies per (source, level) so that the expected words of a source are its target.

    ``levels``: source, level, words, target.  A document of level v is worth 1 + v; copies are proportional to that
    and stop at ``cap``.  At most 64 levels exist, so a source's window is a handful of rows whatever its size.
    """
    value = (F.col("level") + 1).cast("double")
    order = Window.partitionBy("source").orderBy(F.col("level").desc())
    capped = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(value * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rate = F.when(F.col("_open") > 0, (F.col("target") - cap * F.col("_capped")) / F.col("_open"))
    tried = levels.withColumn("_capped", capped).withColumn("_open", open_).withColumn("_rate", rate)
    fits = F.when(F.col("_rate") * value <= cap * (1 + 1e-9), F.col("_rate"))
    chosen = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # sums of doubles leave dust around whole numbers; a fraction below it is no fraction
    copies = F.round(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(F.col("_chosen"), F.lit(0.0)) * value)), 9)
    return (
        tried.withColumn("_chosen", chosen)
        .withColumn("_copies", copies)
        .select("source", "level", F.floor("_copies").cast("int").alias("certain"), (F.col("_copies") - F.floor("_copies")).alias("odds_p"))
    )


def _crossing(candidates: DataFrame, bucket: Column) -> DataFrame:
    """First bucket of each source in which the running words pass what is left to take, and the words before it."""
    sums = candidates.groupBy("source", "left_words", bucket.alias("_b")).agg(F.sum("size").alias("_w"))
    order = Window.partitionBy("source").orderBy("_b")
    run = sums.withColumn("_run", F.sum("_w").over(order))
    return (
        run.where(F.col("_run") > F.col("left_words"))
        .groupBy("source")
        .agg(F.min_by(F.struct("_b", (F.col("left_words") - F.col("_run") + F.col("_w")).alias("left")), "_b").alias("x"))
        .select("source", F.col("x._b").alias("at"), F.col("x.left").alias("left"))
    )


def _with_crossing(df: DataFrame, crossing: DataFrame, names: tuple[str, str]) -> DataFrame:
    small = crossing.select(F.col("source").alias("_s"), F.col("at").alias(names[0]), F.col("left").alias(names[1]))
    return df.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def pareto_mix(docs: DataFrame, cap: int = 3, seed: int = 7, bound: int = 200_000) -> DataFrame:
    """Words that a mix takes from each document.

    A document's expected copies follow from its source's target and its own length class.  The whole part is taken for
    certain.  The fraction p is drawn by Pareto order sampling: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with
    a reproducible u from the row's content, and taken in that order until the source's words are used up, so the size
    of the sample is fixed, not random; the document on the border gives only the words that are still wanted.  No
    source is sorted as a whole: the cut-off rank is found by two histograms of 4096 buckets, and only the last bucket
    is put in order.

    Returns doc_id, rk (content key), size, source, source_size, target, taken, certain (whole copies), drawn (words of the drawn copy).
    Null text has size 0 and takes 0 words; a null source is a source of its own, last in order.  Repeated rows are
    documents of their own with equal ranks, of which the sample may take some.  An empty table gives an empty table.  Only doc_id,
    text and source are read, so other columns may have any name.
    """
    sized = cut(
        docs.select(
            "doc_id",
            row_key().alias("rk"),
            "source",
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            uniform(F.lit(seed), F.col("doc_id"), F.col("text")).alias("u"),
        ).withColumn("level", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    )
    hist = cut(sized.groupBy("source", "level").agg(F.sum("size").alias("words")).coalesce(1))
    targets = cut(source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size"))).coalesce(1))
    n_sources = targets.count()
    on_source = lambda left, right: left["source"].eqNullSafe(right["source"])
    levels = hist.join(lookup(targets, n_sources, bound), on_source(hist, targets)).select(hist["source"], "level", "words", "target", "source_size")
    plan = expected_copies(levels, cap).alias("p").join(levels.alias("l"), F.expr("p.source <=> l.source AND p.level = l.level"))
    left_words = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    plan = cut(
        plan.select(
            F.col("l.source").alias("source"), F.col("l.level").alias("level"), "words", "target", "source_size", "certain", "odds_p"
        ).withColumn("left_words", left_words).coalesce(1)
    )
    side = plan.select(F.col("source").alias("_s"), F.col("level").alias("_l"), "target", "source_size", "certain", "odds_p", "left_words")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("odds_p") / (1 - F.col("odds_p")))
    ranked = cut(
        sized.join(lookup(side, n_sources * 64, bound), F.col("source").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")))
        .drop("_s", "_l")
        .withColumn("place", F.when((F.col("odds_p") > 0) & (F.col("size") > 0), odds / (1 + odds)))
        .withColumn("b1", F.floor(F.col("place") * FINE))
        .withColumn("b2", F.floor((F.col("place") * FINE - F.col("b1")) * FINE))
        .select("doc_id", "rk", "source", "size", "u", "target", "source_size", "certain", "place", "b1", "b2", "left_words")
    )
    first = cut(_crossing(ranked.where("place IS NOT NULL"), F.col("b1")).coalesce(1))
    placed = _with_crossing(ranked, first, ("at1", "left1"))
    inside = placed.where("b1 = at1")
    second = _crossing(inside.drop("left_words").withColumnRenamed("left1", "left_words"), F.col("b2"))
    placed = _with_crossing(placed, cut(second.coalesce(1)), ("at2", "left2"))
    last = F.coalesce((F.col("b1") == F.col("at1")) & (F.col("b2") == F.col("at2")), F.lit(False))
    drawn = F.col("place").isNotNull() & (F.col("at1").isNull() | (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("at2").isNull() | (F.col("b2") < F.col("at2")))))
    clear = placed.where(~last).withColumn("extra", F.when(F.coalesce(drawn, F.lit(False)), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.round(F.col("left2") - (F.sum("size").over(order) - F.col("size"))).cast("long")
    border = placed.where(last).withColumn("extra", F.least(F.col("size"), F.greatest(room, F.lit(0))))
    return clear.unionByName(border).select(
        "doc_id",
        "rk",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("size") * F.col("certain") + F.col("extra")).cast("long").alias("taken"),
        "certain",
        F.col("extra").cast("long").alias("drawn"),
    )


#: What mixed_corpus adds to the columns of its input.
MIX = ("size", "source_size", "target", "taken", "certain", "drawn")


def mixed_corpus(docs: DataFrame, **mix: int) -> DataFrame:
    """The documents with all their columns, texts included, and what the mix takes of each.

    Adds size, source_size, target, taken (words), certain (whole copies) and drawn (words of the drawn copy, all of the text
    or, on the border, its first ones). Input columns of these names are replaced. Repeated rows get a share of their
    own each; documents without words are taken 0 times; an empty table stays empty.
    """
    taken = pareto_mix(docs, **mix)
    names = [c for c in docs.columns if c not in MIX]
    share = F.struct(*MIX).alias("share")
    # rows alike in id and text are numbered on both sides; texts without words need no number, as they all share alike
    nth = F.row_number().over(Window.partitionBy("rk").orderBy("rk"))
    shares = taken.where("size > 0").select("rk", share)
    shares = shares.withColumn("nth", F.row_number().over(Window.partitionBy("rk").orderBy(F.desc("share.taken"))))
    rows = packed(docs).withColumn("words", F.coalesce(F.col("row.text"), F.lit("")).rlike(WORD))
    full = rows.where("words").withColumn("nth", nth).join(shares, ["rk", "nth"])
    empty = rows.where(~F.col("words")).join(taken.where("size = 0").groupBy("rk").agg(F.min(share).alias("share")), "rk")
    both = full.select("row", "share").unionByName(empty.select("row", "share"))
    return both.select(*unpacked(both, names), *(both["share"].getField(c).alias(c) for c in MIX))
