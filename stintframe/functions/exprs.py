"""Scalar expressions over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column, missing: int = 0) -> Column:
    """1 where the condition holds, 0 where not, ``missing`` where it is null."""
    return F.coalesce(condition.cast("int"), F.lit(missing))


def at_most(c: Column, k: float) -> Column:
    """0/1 label of a position; a null position gives 0."""
    return flag(c <= k)


def unfinished(status: Column, finished: str = "Finished") -> Column:
    """1 unless the status contains ``finished``; a null status counts as unfinished."""
    return flag(~status.contains(finished), 1)


def difference(a: Column, b: Column) -> Column:
    return a - b


def scaled(c: Column, divisor: float, by: float = 100.0) -> Column:
    return c / F.lit(divisor) * F.lit(by)


def row_least(*columns: Column) -> Column:
    """Least value of a row, nulls skipped."""
    return columns[0] if len(columns) == 1 else F.least(*columns)


def number(c: Column) -> Column:
    """A double, null where the text is no number."""
    return c.try_cast("double")


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def binned(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (lo, hi] that holds the value, null outside."""
    out = F.when((c > edges[0]) & (c <= edges[1]), labels[0])
    for lo, hi, label in zip(edges[1:], edges[2:], labels[1:], strict=False):
        out = out.when((c > lo) & (c <= hi), label)
    return out


def mapped(c: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def clamped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within bounds; null stays null."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def wear(age: Column, life: Column) -> Column:
    """Share of life used up, in percent, 100 at most."""
    return F.least(F.lit(100.0), F.try_divide(age, life) * 100)


def life_left(age: Column, life: Column) -> Column:
    return clamped(life - age, low=0)


def fresh(age: Column, limit: float = 3) -> Column:
    return flag(age <= limit)


def worn(age: Column, life: Column, limit: float = 80) -> Column:
    return flag(wear(age, life) > limit)


def confidence(p: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when((p > high) | (p < low), "high").otherwise("medium")


def tier(c: Column, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """The first label whose limit exceeds the value, else the last label; null stays null."""
    out = F.when(c < limits[0], labels[0])
    for limit, label in zip(limits[1:], labels[1:], strict=False):
        out = out.when(c < limit, label)
    return F.when(c.isNotNull(), out.otherwise(labels[-1]))


def duration(seconds: Column) -> Column:
    """``m:ss.sss``."""
    whole = F.round(seconds * 1000).cast("long")
    return F.format_string("%d:%02d.%03d", F.floor(whole / 60000).cast("long"), F.floor(whole % 60000 / 1000).cast("long"), whole % 1000)


def seconds(interval: Column) -> Column:
    """Seconds of a day-time interval."""
    return interval.cast("decimal(18,6)").cast("double")


def packed(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])
