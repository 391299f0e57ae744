"""Features of an entity's ordered sequence within a batch (laps of a race, events of a user)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .stats import exact_quantiles, joined, quantile

# Codes and lives of the three compounds.
COMPOUND_CODE = {"SOFT": 1, "MEDIUM": 2, "HARD": 3}
COMPOUND_LIFE = {"SOFT": 40, "MEDIUM": 50, "HARD": 60}
PHASES = ([0, 15, 40, 100], ["Early", "Middle", "Late"])


def compound_features(df: DataFrame, compound: str, age: str) -> DataFrame:
    life = E.mapped(F.upper(compound), COMPOUND_LIFE, 50)
    a = F.col(age)
    return df.select("*", E.mapped(F.upper(compound), COMPOUND_CODE, 2).alias("compound_code"), life.alias("max_life"), E.life_left(a, life).alias("life_left"), E.fresh(a).alias("fresh"), E.wear(a, life).alias("wear"), E.worn(a, life).alias("old"))


def stints(df: DataFrame, entity: Sequence[str], order: Sequence[str], kind: str, age: str | None = None) -> DataFrame:
    """``stint`` counts changes of ``kind`` (and falls of ``age``), ``stint_lap`` rows within it, ``first_of`` and ``last_of``
    mark its ends."""
    w = Window.partitionBy(*entity).orderBy(*order)
    changed = E.flag(F.col(kind) != F.lag(kind).over(w))
    if age:
        changed = F.greatest(changed, E.flag(F.col(age) < F.lag(age).over(w)))
    out = df.withColumn("_changed", changed).withColumn("stint", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_changed")
    inside = Window.partitionBy(*entity, "stint").orderBy(*order)
    return out.select("*", F.row_number().over(inside).alias("stint_lap"), E.flag(F.lag(F.lit(1)).over(inside).isNull()).alias("first_of"), E.flag(F.lead(F.lit(1)).over(inside).isNull()).alias("last_of"))


def slopes(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope of y over x per key."""
    return df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"))


def progress(df: DataFrame, batch: Sequence[str], lap: str) -> DataFrame:
    """Laps of the batch, laps left, share done, and the fuel that goes with it; aggregated and joined."""
    out = joined(df, df.groupBy(*batch).agg(F.max(lap).alias("max_lap")), batch)
    most = F.col("max_lap")
    return out.select(*df.columns, "max_lap", (most - F.col(lap)).alias("laps_left"), (F.col(lap) / most).alias("progress"), (1 - F.col(lap) / most).alias("fuel"))


def phase(lap: Column) -> Column:
    return E.binned(lap, *PHASES)


def phase_code(lap: Column) -> Column:
    """The phase as a number from 0, null outside."""
    edges, labels = PHASES
    return E.binned(lap, edges, [str(i) for i in range(len(labels))]).cast("int")


def recent_pace(df: DataFrame, entity: Sequence[str], order: Sequence[str], column: str, means: Sequence[int] = (3, 5), deviation: int = 5) -> DataFrame:
    """Means and deviation over the rows before the current one."""
    w = Window.partitionBy(*entity).orderBy(*order)
    new = [F.avg(column).over(w.rowsBetween(-k, -1)).alias(f"mean_{k}") for k in means]
    return df.select("*", *new, F.stddev_samp(column).over(w.rowsBetween(-deviation, -1)).alias(f"std_{deviation}"))


def against_group(df: DataFrame, batch: Sequence[str], group: Sequence[str], entity: Sequence[str], column: str) -> DataFrame:
    """Means of the group and of the entity within the batch, their difference, and percent off the batch's best; aggregated
    and joined, so that no batch is gathered."""
    batch, group, entity = [*batch], [*group], [*entity]
    out = joined(df, df.groupBy(*batch, *group).agg(F.avg(column).alias("group_mean")), [*batch, *group])
    out = joined(out, df.groupBy(*batch, *entity).agg(F.avg(column).alias("_own")), [*batch, *entity])
    out = joined(out, df.groupBy(*batch).agg(F.min(column).alias("_best")), batch)
    return out.select(*df.columns, "group_mean", (F.col("_own") - F.col("group_mean")).alias("versus_group"), ((F.col(column) / F.col("_best") - 1) * 100).alias("off_best"))


def cumulative_time(df: DataFrame, entity: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """``clock``: the entity's time so far, its current row included."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("clock", F.sum(column).over(w))


def neighbours(df: DataFrame, batch: Sequence[str], clock: str, tie: str, within: float, close: float = 1.0, widths: int = 8) -> DataFrame:
    """Gaps to the row ahead and behind in the batch's order of ``clock``, rows within ``within`` of it, and whether the gap
    ahead is under ``close``.

    A batch is dealt in buckets of ``widths`` times ``within``, each with the rows next to it that its own may reach, so no task
    holds a batch.  The ends of a bucket look across empty ones to the last clock before and the first after, which come from one
    row a bucket.  Rows without a clock are alone together and have no gaps.
    """
    batch, c = [*batch], F.col(clock).cast("double")
    width = within * widths if within > 0 else 1.0
    reach = within * (1 + 1e-6)
    rows = df.withColumn("_own", F.floor(c / width)).withColumn("_in", F.explode_outer(F.sequence(F.floor((c - reach) / width), F.floor((c + reach) / width))))
    inside = Window.partitionBy(*batch, "_in").orderBy(clock, tie)
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    near = F.expr(f"count(*) over (partition by {', '.join(map(quoted, [*batch, '_in']))} order by {quoted(clock)} range between {within}D preceding and {within}D following)")
    rows = rows.select("*", F.lag(clock).over(inside).alias("_lag"), F.lead(clock).over(inside).alias("_lead"), (near - 1).alias("traffic")).filter(F.col("_in").eqNullSafe(F.col("_own")))
    ends = df.groupBy(*batch, F.floor(c / width).alias("_own")).agg(F.min(clock).alias("_lo"), F.max(clock).alias("_hi"))
    across = Window.partitionBy(*batch).orderBy("_own")  # a row a bucket
    ends = ends.select(*batch, "_own", F.lag("_hi").over(across).alias("_before"), F.lead("_lo").over(across).alias("_after"))
    out = joined(rows, ends, [*batch, "_own"])
    ahead = F.col(clock) - F.coalesce("_lag", "_before")
    return out.select(*df.columns, ahead.alias("gap_ahead"), (F.coalesce("_lead", "_after") - F.col(clock)).alias("gap_behind"), "traffic", E.flag(ahead < close).alias("in_reach"))


def evolution(df: DataFrame, batch: Sequence[str], lap: str, column: str, exact: bool = True) -> DataFrame:
    """The field's median at each lap over its median at the first."""
    keys = [*batch, lap]
    if exact:
        medians = joined(df.select(*keys).distinct(), exact_quantiles(df, keys, column, [0.5]), keys).select(*keys, F.col("q")[0].alias("median"))
    else:
        medians = df.groupBy(*keys).agg(quantile(F.col(column), 0.5, False).alias("median"))
    w = Window.partitionBy(*batch).orderBy(lap)
    return medians.withColumn("evolution", F.col("median") / F.first("median").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
