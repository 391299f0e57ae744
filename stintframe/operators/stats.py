"""Aggregates, distributions and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ACCURACY = 10_000


def quantile(c: Column, q: float | Sequence[float], exact: bool = True) -> Column:
    """Interpolated quantiles; the exact form keeps a count per different value of a group, the other a bounded sketch."""
    q = F.lit(q) if isinstance(q, float) else F.array(*map(F.lit, q))
    return F.percentile(c, q) if exact else F.percentile_approx(c, q, ACCURACY)


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """``keys`` and ``q``, the array of interpolated quantiles, exact in two passes and bounded memory.

    A bounded sketch brackets each quantile's rank; then values below the bracket are only counted, and those within it (some
    4 / ``accuracy`` of the rows) are counted by value and ranked.  A key without values has no row; without keys
    there is one row, whose ``q`` is null if there are no values.
    """
    keys = [*keys]
    v = F.col(column).cast("double")
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("_v"))
    around = [min(max(q + side * 2 / accuracy, 0.0), 1.0) for q in qs for side in (-1, 1)]
    marks = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, around)), accuracy).alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # the ends of the range need no sketch, and in few rows the sketch's error is less than a rank
    few = F.col("_n") < 2 * accuracy
    sides = [F.col(end) if x in (0.0, 1.0) else F.when(few, F.col(end)).otherwise(F.col("_m")[i]) for i, (x, end) in enumerate(zip(around, ["_min", "_max"] * len(qs), strict=True))]
    spans = [F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("_n") - 1)).alias("rank"), sides[2 * i].alias("lo"), sides[2 * i + 1].alias("hi")) for i, q in enumerate(qs)]
    marks = marks.select(*keys, F.array(*spans).alias("_spans"))
    rows = joined(rows, marks, keys, "inner").select(*keys, "_v", F.explode("_spans").alias("_s")).filter("_v <= _s.hi")
    inside = F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v"))  # null for all values below
    counts = rows.groupBy(*keys, F.col("_s.i").alias("_i"), F.col("_s.rank").alias("_rank"), inside.alias("_v")).agg(F.count("*").alias("_c"))
    reached = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v")))
    counts = counts.withColumn("_r", reached)
    at = lambda rank: F.min(F.when(F.col("_r") > rank, F.col("_v")))
    low, high, part = at(F.floor("_rank")), at(F.ceil("_rank")), F.first("_rank") - F.floor(F.first("_rank"))
    found = counts.groupBy(*keys, "_i").agg((low + (high - low) * part).alias("_q"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"])
    return found.groupBy(*keys).agg(F.when(F.count("*") > 0, q).alias("q"))


def joined(df: DataFrame, stat: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of ``stat``, joined on ``keys``, nulls being equal; without keys ``stat`` is one row."""
    if not keys:
        return df.join(F.broadcast(stat), F.lit(True), how)  # one row
    named = stat.toDF(*[f"_k_{c}" if c in keys else c for c in stat.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(named, same, how).drop(*[f"_k_{c}" for c in keys])


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """``n`` per key, largest first; null keys are left out."""
    return df.dropna("any", subset=[*keys]).groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def by_key(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates per key without null keys."""
    return df.dropna("any", subset=[*keys]).groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def rate(condition: Column, missing: int = 0) -> Column:
    """Share of rows that meet the condition, in percent; a null condition counts as ``missing``."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(float(missing)))) * 100


def top_k(df: DataFrame, k: int, by: str, *ties: str, ascending: bool = False) -> DataFrame:
    c = F.col(by)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *ties).limit(k)


def for_top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The rows of the ``k`` most frequent keys."""
    return df.join(F.broadcast(value_counts(df, key).limit(k).select(key)), key, "left_semi")  # k rows


def first_buckets_mean(df: DataFrame, bucket: str, value: str, k: int) -> DataFrame:
    """Unweighted mean of the first ``k`` buckets."""
    return df.orderBy(bucket).limit(k).agg(F.avg(value).alias(value))


def best_of(df: DataFrame, by: str, *ties: str) -> DataFrame:
    return top_k(df, 1, by, *ties)


def share(df: DataFrame, key: str) -> DataFrame:
    """``n`` and its percentage of all rows per key."""
    counts = df.dropna("any", subset=[key]).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))  # one row


def fences(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """One row: quartiles, inter-quartile range and Tukey's fences."""
    q = exact_quantiles(df, [], column, [0.25, 0.5, 0.75]) if exact else df.agg(quantile(F.col(column), [0.25, 0.5, 0.75], False).alias("q"))
    q = q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", iqr.alias("iqr"), (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def outliers(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """One row: rows beyond the fences and their percentage."""
    bounds = fences(df, column, k, exact).select("lower", "upper")
    beyond = (F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper"))
    return df.crossJoin(F.broadcast(bounds)).agg(F.count_if(beyond).alias("outliers"), rate(beyond).alias("percent"))  # one row


def column_types(df: DataFrame) -> DataFrame:
    """``name``, ``type`` of every column, in their order."""
    return df.sparkSession.createDataFrame(df.dtypes, "name string, type string")


def head(df: DataFrame, n: int = 5, *order: str) -> DataFrame:
    """The first ``n`` rows, in an order where one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


#: Columns up to which correlations are aggregates of their own; sides of the blocks beyond.
NARROW, BLOCK = 40, 128


def correlations(df: DataFrame, columns: Sequence[str], listwise: bool = False) -> DataFrame:
    """``a``, ``b``, ``r`` of each pair; pairwise complete, or complete rows only.  A few columns take one aggregate, many take
    blocks of sums of products."""
    df = df.dropna("any", subset=[*columns]) if listwise else df
    if len(columns) > NARROW:
        return wide_correlations(df, columns)
    pairs = [*combinations(columns, 2)]
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def wide_correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``correlations`` of any number of columns, pairwise complete.

    Values are taken less their column's mean.  Each task sums, for every two blocks of columns, the products and the counts, sums
    and squares over the rows that have both; it sends a row a column and block, which are added as they arrive.  So a task holds
    six sums a pair, whatever the rows.  Pairs with fewer than two common rows or without spread are null.
    """
    columns = [*columns]
    means = df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    middle = np.array([m if m is not None else 0.0 for m in means])
    parts = [(i, min(i + block, len(columns))) for i in range(0, len(columns), block)]
    pairs = [(i, j) for i in range(len(parts)) for j in range(i, len(parts))]
    kinds = ["n", "sa", "sb", "saa", "sbb", "sab"]
    shape = "i int, j int, at int, " + ", ".join(f"{k} array<double>" for k in kinds)
    names = ["i", "j", "at", *kinds]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                piece = batch.slice(low, 4096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in piece.columns])
                m = ~np.isnan(x)
                x = np.where(m, x - middle, 0.0)
                m = m.astype(np.float64)
                for i, j in pairs:
                    a, b = slice(*parts[i]), slice(*parts[j])
                    made = np.stack([m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], m[:, a].T @ x[:, b], (x[:, a] ** 2).T @ m[:, b], m[:, a].T @ x[:, b] ** 2, x[:, a].T @ x[:, b]])
                    sums[i, j] = sums[i, j] + made if (i, j) in sums else made
        for (i, j), s in sums.items():
            rows = s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([i] * rows, pa.int32()), pa.array([j] * rows, pa.int32()), pa.array(range(rows), pa.int32()), *(pa.array([*k], pa.list_(pa.float64())) for k in s)], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for r in batch.slice(low, 256).to_pylist():
                    key, made = (r["i"], r["j"], r["at"]), np.array([r[k] for k in kinds])
                    sums[key] = sums[key] + made if key in sums else made
        for (i, j, at), (n, sa, sb, saa, sbb, sab) in sums.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                va, vb = saa - sa * sa / n, sbb - sb * sb / n
                r = (sab - sa * sb / n) / np.sqrt(va * vb)
                flat = (n < 2) | (va <= 1e-13 * saa) | (vb <= 1e-13 * sbb)
            first, others = parts[i][0] + at, np.arange(*parts[j])
            keep = others > first
            yield pa.RecordBatch.from_arrays([pa.array([columns[first]] * int(keep.sum()), pa.string()), pa.array([columns[o] for o in others[keep]], pa.string()), pa.array(np.clip(r[keep], -1, 1), mask=flat[keep])], ["a", "b", "r"])

    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return numbers.mapInArrow(products, shape).repartition("i", "j", "at").mapInArrow(finish, "a string, b string, r double")


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Per column: n, mean, std, min, quartiles, max; moments in one pass, exact quartiles in two more a column."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        q = F.lit(None).cast("array<double>") if exact else quantile(v, [0.25, 0.5, 0.75], False)
        parts.append(F.struct(F.lit(c).alias("name"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max")))
    x = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    if exact:
        found = [exact_quantiles(df, [], c, [0.25, 0.5, 0.75]).select(F.lit(c).alias("name"), "q") for c in columns]
        x = x.drop("q").join(F.broadcast(reduce(DataFrame.union, found)), "name", "left")  # a row a column
    return x.select("name", "n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def null_profile(df: DataFrame) -> DataFrame:
    """``name``, ``nulls``, ``present`` per column, in one pass."""
    parts = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(F.col(c)).alias("present")) for c in df.columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def confidence_interval(df: DataFrame, key: str, column: str, z: float = 1.96) -> DataFrame:
    c = F.col(column)
    half = z * F.stddev_samp(c) / F.sqrt(F.count(c))
    return by_key(df, [key], mean=F.avg(c), low=F.avg(c) - half, high=F.avg(c) + half)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin`` (1 to bins, the maximum in the last), ``lo``, ``n`` for the bins that have rows."""
    edges = F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width) + 1, F.lit(bins)))
    rows = df.filter(F.col(column).isNotNull()).crossJoin(edges).withColumn("bin", number.cast("int"))
    return rows.groupBy("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lo")).agg(F.count("*").alias("n"))


def density(df: DataFrame, column: str, keys: Sequence[str] = (), bins: int = 200, grid: int = 50) -> DataFrame:
    """Gaussian density at ``grid`` points per key, from counts of ``bins`` bins, with a rule-of-thumb bandwidth.

    Only bins meet grid points, a bounded number per key.  Keys without spread have no row.
    """
    keys = [*keys]
    v = F.col(column)
    stats = df.filter(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (F.stddev_samp(v) * F.pow(F.count(v).cast("double"), F.lit(-0.2))).alias("h"), F.count(v).alias("total")).filter("h > 0")
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.filter(v.isNotNull())
    rows = rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))  # one row without keys
    number = F.least(F.floor((v - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*keys, "lo", "hi", "h", "total", number.alias("bin")).agg(F.count("*").alias("n"))
    points = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (grid - 1)
    z = (x - (F.col("lo") + (F.col("bin") + 0.5) * width)) / F.col("h")
    mass = F.sum(F.col("n") * F.exp(-0.5 * z * z)) / (F.first("total") * F.first("h") * math.sqrt(2 * math.pi))
    return points.groupBy(*keys, "point").agg(F.first(x).alias("x"), mass.alias("density"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([*ids], [*values], name, value)


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of ``value`` per (model, metric)."""
    return scores.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
