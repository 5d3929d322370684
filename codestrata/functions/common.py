"""Small column helpers shared by the library."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves towards +infinity (``floor(x + 0.5)``), as a long."""
    return F.floor(value + F.lit(0.5)).cast("long")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def flags(pairs: Iterable[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def first_match(pairs: Iterable[tuple[str | None, Column]], default: str | None = None) -> Column:
    """Name of the first condition that holds."""
    chain = None
    for name, cond in pairs:
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def lookup(value: Column, table: Mapping[str, object], default=None) -> Column:
    """Value of a small fixed mapping."""
    chain = None
    for key, out in table.items():
        chain = F.when(value == key, F.lit(out)) if chain is None else chain.when(value == key, F.lit(out))
    return chain.otherwise(F.lit(default)) if default is not None else chain


def nonempty(array: Column) -> Column:
    return F.size(array) > 0


def has(array: Column, item: str) -> Column:
    return F.array_contains(array, item)


def matches(pattern: str, text: Column) -> Column:
    return text.rlike(pattern)


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    """Every match of ``pattern`` in ``text``; pattern is a literal."""
    return F.regexp_extract_all(text, F.lit(pattern), group)


def join_words(array: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, array)
