"""A bit table of fixed size over 64-bit keys: tells in a task whether a key may be among many."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two to this power bits, 16 MB. The table only saves work: a key that is in is always let through, however full the table.
BITS = 27


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def bit_table(keys: DataFrame, bits: int = BITS) -> tuple[Broadcast, int]:
    """Broadcast bit table over column ``key`` and the number of bits set in it; at most 2**bits / 64 longs reach the driver."""
    slots = keys.select(_slot(F.col("key"), bits).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    found = slots.groupBy(F.shiftright("slot", 6).alias("place")).agg(F.bit_or(bit).alias("held")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("place").to_numpy()] = found.column("held").to_numpy()
    table = table.view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table), int(np.bitwise_count(table).sum())


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key whether its bit is set."""
    slot = keys >> np.uint64(64 - (len(table).bit_length() + 5))
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
