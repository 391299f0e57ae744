"""Samples and bootstrap intervals drawn by hashes of row keys: the same on every layout of the data, and mergeable over batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import joined

PLACE = "_place"
#: Replicates that one digest of 128 bits draws, 16 bits each.
A_DIGEST = 8


def place(key: Sequence[str], seed: int) -> Column:
    """The row's place in a random order: a digest of the seed and its key (nulls as empty)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))


def bottom(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of least place, of each stratum where ``strata`` are given (null is one), with their place; fewer where
    there are fewer.  ``key`` should be unique: of rows equal in it any may be taken.  Each task keeps ``n`` a stratum."""
    rows = df.withColumn(PLACE, place(key, seed))
    order = [PLACE, *key]
    if not strata:
        return rows.orderBy(*order).limit(n)
    number = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return rows.withColumn("_r", number).filter(F.col("_r") <= n).drop("_r")


def merged(held: DataFrame, more: DataFrame, n: int, key: Sequence[str], strata: Sequence[str] = ()) -> DataFrame:
    """The sample of two parts from their samples, both with their places."""
    order, both = [PLACE, *key], held.unionByName(more)
    if not strata:
        return both.orderBy(*order).limit(n)
    number = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return both.withColumn("_r", number).filter(F.col("_r") <= n).drop("_r")


def exactly(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """``bottom`` without the places; an error if the table, or a stratum, has fewer rows."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"))
    least = counts.agg(F.min("n")).first()[0]
    if n > (least or 0):
        raise ValueError(f"a sample of {n} from {least or 0} rows")
    return bottom(df, n, key, seed, strata).drop(PLACE)


def poisson_steps() -> list[int]:
    """For 16 random bits: how many of these they reach is a draw from the Poisson distribution of mean 1."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        step = round(total * 65536)
        if step >= 65536:
            return steps
        steps.append(step)
        k += 1


def bootstrap_interval(df: DataFrame, key: str, column: str, row_key: Sequence[str], replicates: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``key``, ``mean``, ``low``, ``high``: the mean and the percentile interval of its bootstrap replicates.

    In each replicate a row counts as often as a Poisson draw of mean 1 says, which 16 bits of a digest of its ``row_key`` decide; so
    there is one pass, sums are combined before the shuffle, and the result depends on neither layout nor order.  Null keys and
    values are left out; a replicate that draws no row of a key has no part in its interval.
    """
    v = F.col(column).cast("double")
    rows = df.filter(F.col(key).isNotNull() & v.isNotNull()).select(key, v.alias("_v"), *[c for c in row_key if c != key])
    groups = -(-replicates // A_DIGEST)
    rows = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_g").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_key]))
    rows = rows.withColumn("_d", digest)
    steps, sums = poisson_steps(), []
    for i in range(A_DIGEST):
        bits = F.conv(F.substring("_d", 4 * i + 1, 4), 16, 10).cast("int")
        weight = F.lit(0)
        for step in steps:
            weight = weight + (bits >= step).cast("int")
        sums += [F.sum(weight).alias(f"_w{i}"), F.sum(weight * F.col("_v")).alias(f"_s{i}")]
    drawn = rows.groupBy(key, "_g").agg(*sums)
    means = F.array(*[F.struct((F.col("_g") * A_DIGEST + i).alias("b"), F.try_divide(F.col(f"_s{i}"), F.col(f"_w{i}")).alias("m")) for i in range(A_DIGEST)])
    drawn = drawn.select(key, F.explode(means).alias("x")).select(key, "x.*").filter(F.col("b") < replicates)
    ends = [(1 - level) / 2, (1 + level) / 2]
    interval = drawn.groupBy(key).agg(F.percentile("m", F.array(*map(F.lit, ends))).alias("q"))  # a row a replicate
    mean = df.filter(F.col(key).isNotNull() & v.isNotNull()).groupBy(key).agg(F.avg(v).alias("mean"))
    return joined(mean, interval, [key]).select(key, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
