"""Preference formatting: the shared beginning of two conversations once, what differs as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(turn: Column) -> Column:
    """One turn as text; a null role is ``unknown``, a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None, learn: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen and rejected (arrays of text and whether it is learnt).

    ``turns``: conv_id, turn, role, text.  ``pairs``: pair_id, conv_id, side (0 chosen, 1 rejected); without it, conversations
    2k and 2k + 1 make pair k.  The prompt is the longest run of leading turns that agree in role and text (two nulls
    agree), rendered once; each completion is its side's other turns, of which those of role ``learn`` are learnt and the
    rest is masked.

    Turns are put in order by number, then role, then text, so repeated turn numbers and rows have one order and all count.
    A pair without one side has an empty prompt and an empty array there; equal conversations leave two empty
    completions.  Turns without a conversation belong to no pair; an empty table gives an empty table.  One pair's turns
    come together by one shuffle, as the row that is asked for holds them all; nothing else is gathered.
    """
    if pairs is None:
        sided = turns.where(F.col("conv_id").isNotNull()).select(
            F.floor(F.col("conv_id") / 2).alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), F.struct("turn", "role", "text").alias("t")
        )
    else:
        sided = turns.join(pairs.select("pair_id", "conv_id", "side"), "conv_id").select("pair_id", "side", F.struct("turn", "role", "text").alias("t"))
    both = sided.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("t")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("t")))).alias("b")
    )
    shorter = F.least(F.size("a"), F.size("b"))
    same = lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    agree = F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), same)
    first_apart = F.array_position(agree, False)
    counted = both.withColumn("prompt_turns", F.when(first_apart == 0, shorter).otherwise(first_apart - 1).cast("int"))

    def completion(side: str) -> Column:
        rest = F.slice(side, F.col("prompt_turns") + 1, F.size(side))
        return F.transform(rest, lambda t: F.struct(rendered(t).alias("text"), F.coalesce(t["role"] == learn, F.lit(False)).alias("learn")))

    return counted.select(
        "pair_id",
        "prompt_turns",
        F.array_join(F.transform(F.slice("a", F.lit(1), F.col("prompt_turns")), rendered), "").alias("prompt"),
        completion("a").alias("chosen"),
        completion("b").alias("rejected"),
    )


def mask_of(completion: str) -> Column:
    """A completion's mask as text: for each piece 1 (learnt) or 0 and its length in code points."""
    return F.array_join(F.transform(completion, lambda p: F.concat_ws(":", p["learn"].cast("int"), F.length(p["text"]))), ",")


def text_of(completion: str) -> Column:
    return F.array_join(F.transform(completion, lambda p: p["text"]), "")
