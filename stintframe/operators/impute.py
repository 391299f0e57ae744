"""Filling of missing values.  Group statistics come from an aggregation joined back, so no group is gathered in a window;
a global one is a single row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import exact_quantiles, joined, quantile


def group_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Null to the group's median, else to the median of all rows, which is only worked out if a group has no value.  Exact medians
    are ranked within brackets, so no group is gathered; otherwise a group is a bounded sketch."""
    keys, own = [*keys], None
    if exact:
        own = df.groupBy(*keys).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
        for c in columns:
            own = joined(own, exact_quantiles(df, keys, c, [0.5]).select(*keys, F.col("q")[0].alias(f"_g_{c}")), keys)
    else:
        own = df.groupBy(*keys).agg(*[quantile(F.col(c), 0.5, False).alias(f"_g_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])
    bare = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns]).agg(*[F.bool_or(F.col(c) == 0).alias(c) for c in columns]).first()
    out = joined(df, own, keys)
    for c in columns:
        whole = _median(df, c, exact) if bare[c] else df.sparkSession.range(1).select(F.lit(None).cast("double").alias("_a"))
        out = joined(out, whole.withColumnRenamed("_a", f"_a_{c}"), [])
    filled = {c: F.coalesce(c, f"_g_{c}", f"_a_{c}") for c in columns}
    return out.withColumns(filled).select(*df.columns)


def _median(df: DataFrame, column: str, exact: bool) -> DataFrame:
    """One row ``_a``; none if there is no value."""
    if not exact:
        return df.agg(quantile(F.col(column), 0.5, False).alias("_a"))
    return exact_quantiles(df, [], column, [0.5]).select(F.col("q")[0].alias("_a"))


def group_mode(df: DataFrame, keys: Sequence[str], column: str, default) -> DataFrame:
    """Null to the group's most frequent value (the smallest on ties), else to ``default``."""
    own = df.groupBy(*keys).agg(F.mode(column, True).alias("_mode"))
    return joined(df, own, keys).withColumn(column, F.coalesce(column, "_mode", F.lit(default))).select(*df.columns)


def constants(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def global_median(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    return joined(df, _median(df, column, exact), []).withColumn(column, F.coalesce(column, "_a")).drop("_a")
