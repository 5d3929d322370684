"""Corpus pipeline: toxic documents out, one of each near-duplicate class, decontaminated, secrets masked, mixed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import lookup, packed, table, unpacked
from codestrata.llm.group_join import one_of_each
from codestrata.llm.nnpu import drop_toxic
from codestrata.llm.pareto_mix import mixed_corpus
from codestrata.llm.phrase_index import contamination
from codestrata.llm.secret_links import redact_secrets
from codestrata.session import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts stay, repeated rows share a fate, and all stay without toxic labels."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id (null last); texts without words all stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract calls contaminated go; null and empty texts stay, and all stay without benchmark items."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = cut(found.where("contaminated").select(F.col("key").alias("rk")).distinct())
    clean = packed(docs).join(lookup(bad, bad.count()), "rk", "left_anti")
    return clean.select(*unpacked(clean, docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; n_chars, if there is one, follows the text, and null texts keep theirs."""
    masked = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    n_chars = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", n_chars).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their texts and what the mix takes of each; sources keep their order by code point, null last."""
    return mixed_corpus(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Two stages learn or compare in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as a table in the shared folder and read by the next.

    Every stage takes null and empty texts, repeated rows, empty tables and extra columns of any name.
    """
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
