"""Rolling form over an entity's last ``n`` rows, all columns from one sort of each entity's rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import joined


@dataclass(frozen=True)
class Roles:
    """Which columns play which part.  ``order`` must be unique within an entity for results to be reproducible."""

    entity: Sequence[str]
    order: Sequence[str]
    batch: Sequence[str] = ()
    group: Sequence[str] = ()


@dataclass(frozen=True)
class Form:
    """Columns to roll up: output name to input expression, by kind."""

    mean: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    total: dict[str, Column] = field(default_factory=dict)
    count: dict[str, Column] = field(default_factory=dict)
    reliability: dict[str, Column] = field(default_factory=dict)
    trend: dict[str, Column] = field(default_factory=dict)


def frame(roles: Roles, n: int, include_current: bool = True):
    w = Window.partitionBy(*roles.entity).orderBy(*roles.order)
    return w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)


def trend(c: Column, roles: Roles, n: int, recent: int = 3, include_current: bool = True) -> Column:
    """Mean of the older rows of the frame less the mean of the ``recent`` ones; 0 where the frame has no older ones."""
    if n <= recent:
        return F.lit(0.0)
    w = Window.partitionBy(*roles.entity).orderBy(*roles.order)
    last = 0 if include_current else -1
    older = F.avg(c).over(w.rowsBetween(last - (n - 1), last - recent))
    return older - F.avg(c).over(w.rowsBetween(last - (recent - 1), last))


def with_form(df: DataFrame, roles: Roles, form: Form, n: int, include_current: bool = True, divisor: str = "n") -> DataFrame:
    """``df`` with its form columns.

    The frame holds the row itself and the n - 1 before it, or with ``include_current=False`` the n before it, which keeps a
    training row free of its own outcome.  ``divisor='n'`` divides failures by n even where the frame has fewer rows;
    ``'rows'`` by the rows there.
    """
    check_lookback(n, 1, 10_000)
    w = frame(roles, n, include_current)
    new = {k: F.avg(c).over(w) for k, c in form.mean.items()}
    new |= {k: F.min(c).over(w) for k, c in form.least.items()}
    new |= {k: F.sum(c).over(w) for k, c in (form.total | form.count).items()}
    by = F.lit(float(n)) if divisor == "n" else F.count(F.lit(1)).over(w)
    new |= {k: 1 - F.sum(c).over(w) / by for k, c in form.reliability.items()}
    new |= {k: trend(c, roles, n, include_current=include_current) for k, c in form.trend.items()}
    return df.select("*", *[c.alias(k) for k, c in new.items()])


def check_lookback(n: int, low: int = 3, high: int = 12) -> int:
    if not low <= n <= high:
        raise ValueError(f"lookback must be from {low} to {high}, not {n}")
    return n


def latest(df: DataFrame, roles: Roles, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """One row per entity: each column's last value that is not null, or with ``strict`` the last row's values."""
    place = F.struct(*roles.order)
    if strict:
        last = F.max_by(F.struct(*columns), place)
        return df.groupBy(*roles.entity).agg(last.alias("_last")).select(*roles.entity, "_last.*")
    # a null ordering is skipped by max_by
    return df.groupBy(*roles.entity).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def sweep(df: DataFrame, roles: Roles, metric: Column, lookbacks: Sequence[int]) -> DataFrame:
    """Per lookback: rows with a trend and its mean absolute value; all windows share one sort."""
    wide = df.select(*[trend(metric, roles, n).alias(f"t{n}") for n in lookbacks])
    sums = wide.agg(*[x for n in lookbacks for x in (F.count(f"t{n}").alias(f"c{n}"), F.avg(F.abs(f"t{n}")).alias(f"m{n}"))])
    rows = [F.struct(F.lit(n).alias("lookback"), F.col(f"c{n}").alias("valid_rows"), F.col(f"m{n}").alias("mean_abs_trend")) for n in lookbacks]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def forward_fill(df: DataFrame, roles: Roles, column: str, default=None, out: str | None = None) -> DataFrame:
    w = Window.partitionBy(*roles.entity).orderBy(*roles.order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(column, True).over(w)
    return df.withColumn(out or column, filled if default is None else F.coalesce(filled, F.lit(default)))


def from_start(df: DataFrame, roles: Roles, column: str) -> DataFrame:
    """``start``, the entity's first value that is not null, and ``gained`` = start less the row's value."""
    w = Window.partitionBy(*roles.entity).orderBy(*roles.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("start", F.first(column, True).over(w)).withColumn("gained", F.col("start") - F.col(column))


def step(df: DataFrame, roles: Roles, column: str, out: str) -> DataFrame:
    """Difference to the row before within the entity."""
    w = Window.partitionBy(*roles.entity).orderBy(*roles.order)
    return df.withColumn(out, F.col(column) - F.lag(column).over(w))


def gap_to_best(df: DataFrame, batch: Sequence[str], column: str, out: str = "gap") -> DataFrame:
    """The value less its batch's least; aggregated and joined, so that no batch is gathered."""
    best = df.groupBy(*batch).agg(F.min(column).alias("_best"))
    return joined(df, best, batch).withColumn(out, F.col(column) - F.col("_best")).drop("_best")
