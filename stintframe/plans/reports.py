"""The tables behind the charts, as one function each over result, lap or joined tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import samples, stats


def wins(results: DataFrame, entity: str = "Driver", position: str = "Position") -> DataFrame:
    return stats.value_counts(results.filter(F.col(position) == 1), entity)


def mean_by(df: DataFrame, key: str, column: str, k: int | None = None, ascending: bool = True) -> DataFrame:
    out = stats.by_key(df, [key], mean=F.avg(column))
    order = F.col("mean").asc_nulls_last() if ascending else F.col("mean").desc_nulls_last()
    out = out.orderBy(order, key)
    return out if k is None else out.limit(k)


def consistency(df: DataFrame, key: str, column: str, k: int | None = None) -> DataFrame:
    """Deviation per key, steadiest first, with its tier."""
    out = stats.by_key(df, [key], std=F.stddev_samp(column)).withColumn("tier", E.tier(F.col("std"), [3, 5], ["steady", "fair", "erratic"]))
    out = out.orderBy(F.col("std").asc_nulls_last(), key)
    return out if k is None else out.limit(k)


def totals(df: DataFrame, key: str, column: str) -> DataFrame:
    return stats.by_key(df, [key], total=F.sum(column)).orderBy(F.col("total").desc_nulls_last(), key)


def mean_with_interval(df: DataFrame, key: str, column: str, row_key: Sequence[str] = ()) -> DataFrame:
    """Mean and 95 % interval: bootstrapped where ``row_key`` tells rows apart, else by the normal approximation."""
    return samples.bootstrap_interval(df, key, column, row_key) if row_key else stats.confidence_interval(df, key, column)


def sample_pairs(df: DataFrame, x: str, y: str, key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` pairs drawn by a hash of the row's key; an error if there are fewer."""
    return samples.exactly(df, n, key, seed).select(x, y)


def correlation_matrix(df: DataFrame, listwise: bool = False) -> DataFrame:
    return stats.correlations(df, stats.numeric_columns(df), listwise)


def pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).dropna()


def trend_of_top(df: DataFrame, entity: str, order: list[str], column: str, k: int = 5) -> DataFrame:
    return stats.for_top_k(df, entity, k).select(entity, *order, column).orderBy(entity, *order)


def distribution_of_top(df: DataFrame, group: str, column: str, k: int = 6) -> DataFrame:
    return quartiles_by(stats.for_top_k(df, group, k), group, column)


def quartiles_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """Count, least, quartiles and most per key; quartiles are ranked within brackets, so a large group is not gathered."""
    out = stats.by_key(df, [key], n=F.count(column), least=F.min(column), most=F.max(column))
    q = stats.exact_quantiles(df.dropna("any", subset=[key]), [key], column, [0.25, 0.5, 0.75])
    out = stats.joined(out, q, [key])
    return out.select(key, "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")


def by_position_group(df: DataFrame, position: str, column: str) -> DataFrame:
    groups = E.binned(F.col(position), [0, 5, 10, 15, 20], ["1-5", "6-10", "11-15", "16-20"])
    return quartiles_by(df.withColumn("position_group", groups).dropna("any", subset=["position_group", column]), "position_group", column)


def outcome_by_bucket(df: DataFrame, bucket: str, position: str, within: int) -> DataFrame:
    """Percent of rows per bucket that end within the first places."""
    return stats.by_key(df, [bucket], percent=stats.rate(F.col(position) <= within)).orderBy(bucket)


def close_gaps(df: DataFrame, gap: str, position: str, limit: float = 3.0) -> DataFrame:
    return df.filter(F.col(gap).isNotNull() & (F.col(gap) < limit)).select(gap, position)


def insights(df: DataFrame, bucket: str, position: str) -> DataFrame:
    """One row: correlation, pole win rate (0 if there is no pole), mean of the first two win rates, of the first three podium
    rates, and the pooled front-row rate."""
    win, podium = outcome_by_bucket(df, bucket, position, 1), outcome_by_bucket(df, bucket, position, 3)
    pole = win.filter(F.col(bucket) == 1).agg(F.coalesce(F.max("percent"), F.lit(0.0)).alias("pole_win"))
    front = stats.first_buckets_mean(win, bucket, "percent", 2).withColumnRenamed("percent", "front_row_win")
    top3 = stats.first_buckets_mean(podium, bucket, "percent", 3).withColumnRenamed("percent", "top3_podium")
    pooled = df.filter(F.col(bucket) <= 2).agg(stats.rate(F.col(position) == 1).alias("front_row_pooled"))
    out = df.agg(F.corr(bucket, position).alias("r"))
    for x in (pole, front, top3, pooled):
        out = out.crossJoin(F.broadcast(x))  # one row each
    return out


def positions_gained(df: DataFrame, start: str, position: str, bins: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histogram, density, and mean and median."""
    gained = df.select((F.col(start) - F.col(position)).cast("double").alias("gained"))
    median = stats.exact_quantiles(gained, [], "gained", [0.5]).select(F.col("q")[0].alias("median"))
    return stats.histogram(gained, "gained", bins), stats.density(gained, "gained"), stats.joined(gained.agg(F.avg("gained").alias("mean")), median, [])


def session_times(df: DataFrame, ids: list[str], sessions: list[str], must: str) -> DataFrame:
    """Quartiles per session of the rows that reached ``must``."""
    long = stats.melt(df.filter(F.col(must).isNotNull()), ids, sessions, "session", "time")
    return quartiles_by(long.dropna("any", subset=["time"]), "session", "time")


def top_ten_rate(df: DataFrame, entity: str, position: str, k: int = 12) -> DataFrame:
    """Percent of rows within ten, null for entities without any, which come last."""
    c = stats.rate(F.col(position) <= 10)
    out = stats.by_key(df, [entity], percent=F.when(c > 0, c))
    return stats.top_k(out, k, "percent", entity)
