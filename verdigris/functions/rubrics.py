"""Ordinal rubrics as expressions over conditions and points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def points(*criteria: tuple[Column, int]) -> Column:
    """Sum of the points of the criteria that hold; those that are null don't."""
    out = F.lit(0)
    for condition, value in criteria:
        out = out + F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0)
    return out


def banded(value: Column, edges: list[float]) -> Column:
    """Level from 0: how many of the ascending edges the value reaches."""
    return points(*[(value >= e, 1) for e in edges])


def ladder(*rungs: Column) -> Column:
    """How many rungs hold from the first on, without a gap."""
    out, open_ = F.lit(0), F.lit(True)
    for r in rungs:
        open_ = open_ & F.coalesce(r, F.lit(False))
        out = out + open_.cast("int")
    return out


def weighted(*parts: tuple[Column, float]) -> Column:
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for value, w in parts:
        out = out + value * w
    return out / total


def matrix(row: Column, column: Column, levels: list[list[int]]) -> Column:
    """The level at (row, column) of a table; null outside it."""
    return F.get(F.get(F.array(*[F.array(*map(F.lit, r)) for r in levels]), row.cast("int")), column.cast("int"))


def nearest_levels(gold: Column, width: int, low: int, high: int) -> Column:
    """``width`` consecutive whole levels within [low, high] that hold the gold, centred where there is room."""
    start = F.greatest(F.lit(low), F.least(gold - width // 2, F.lit(high - width + 1)))
    return F.sequence(start.cast("int"), (start + width - 1).cast("int"))
