"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup side that are known to fit each executor; beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000

#: ASCII white space as the word contracts define it, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays."""
    return F.translate(text, _UPPER, _LOWER)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Content key of a row: equal rows share it, so whatever is computed per key holds for each of them."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row`` beside its content key ``rk``, so that no column of the input can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key().alias("rk"))


def unpacked(rows: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of the input out of ``row``."""
    return [rows["row"].getField(c).alias(c) for c in columns]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model may learn from (null ids hash as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches that are small enough to be turned into Python objects one at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lookup(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted rows stay under the bound."""
    return F.broadcast(df) if rows <= bound else df


def uniform(*cols: Column) -> Column:
    """Reproducible number in (0, 1) from a row's own values."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
