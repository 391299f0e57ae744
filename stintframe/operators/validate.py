"""Validation of rows and schemas, and joins that say what they matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_errors(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``_errors``: the required columns that are null in the row, or absent from the table."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in required]
    return df.withColumn("_errors", F.array_compact(F.array(*missing)))


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    checked = with_errors(df, required)
    return checked.filter(F.size("_errors") == 0).drop("_errors"), checked.filter(F.size("_errors") > 0)


def listwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=[*columns])


def tolerant(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that do not."""
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if repeated_keys(df, keys).limit(1).count():
        raise ValueError(f"keys {', '.join(keys)} are not unique")
    return df


def look_up(df: DataFrame, table: DataFrame, key: str, values: dict[str, object], unique: bool = False) -> DataFrame:
    """Left join with defaults for rows without a match; ``unique`` makes a key that the table repeats an error."""
    table = assert_unique(table.select(key, *values), [key]) if unique else table
    return df.join(table.select(key, *values), key, "left").fillna(values)
