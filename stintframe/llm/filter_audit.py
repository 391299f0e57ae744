"""What each of several filters removes, over every order in which they can be applied.

A state is the set of filters already applied; an edge applies one more.  Forward counts say how many orders reach a state,
backward counts how many lead on from it to the full set.  One aggregation gives the documents that every edge removes; an edge's
count times the orders through it sums to the Shapley share, and each order's steps are read from the same edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: Filters whose orders are still listed: k! orders of k steps.
MOST = 8
Edge = tuple[int, int, int, int]


def lattice(names: Sequence[str], before: Sequence[tuple[str, str]] = ()) -> list[Edge]:
    """``(state, filter, orders that reach the state, orders that lead on)`` of each edge that some order takes.

    ``before`` holds pairs of filters of which the first must be applied earlier.
    """
    if not 0 < len(set(names)) == len(names) <= MOST:
        raise ValueError(f"name 1 to {MOST} different filters")
    k = len(names)
    needs = [0] * k
    for early, late in before:
        needs[names.index(late)] |= 1 << names.index(early)
    steps = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1 and not needs[f] & ~s]
    reach, leave = [1] + [0] * ((1 << k) - 1), [0] * ((1 << k) - 1) + [1]
    for s, f in steps:  # a state comes after all that lead to it
        reach[s | 1 << f] += reach[s]
    for s, f in reversed(steps):
        leave[s] += leave[s | 1 << f]
    return [(s, f, reach[s], leave[s | 1 << f]) for s, f in steps if reach[s] and leave[s | 1 << f]]


def orders(names: Sequence[str], edges: Sequence[Edge]) -> list[tuple[str, int, int, int]]:
    """``(order, step, state, filter)``: each order as a walk over the edges from no filter to all."""
    after: dict[int, list[int]] = {}
    for s, f, _, _ in edges:
        after.setdefault(s, []).append(f)
    walks = [((), 0)]
    for _ in names:
        walks = [((*done, (s, f)), s | 1 << f) for done, s in walks for f in after.get(s, ())]
    return [("".join(names[f] for _, f in walk), i + 1, s, f) for walk, _ in walks for i, (s, f) in enumerate(walk)]


def audit_orders(rows: DataFrame, names: Sequence[str], part: str, lost: dict[str, Column], before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """One row per part, order and step, zeros included.

    ``rows`` has a boolean column per filter of ``names`` (true: the row fails it; null: it passes) and the column ``part`` (a null
    is a part of its own); other columns, whatever their names, are not looked at.  Result: ``part``, ``filter_order``, ``step``, ``kept`` (after the step),
    ``removed`` (by it), ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing its filter only), for each of
    ``lost`` the removed rows that meet the condition, ``shapley`` (the filter's removed rows summed over all orders) and
    ``n_orders``.  Rows are counted by part and set of failed filters first, so the size of a part matters nowhere.  No rows, no parts.
    """
    edges = lattice(names, before)
    mask = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    flags = {f"_l{i}": F.coalesce(c.cast("long"), F.lit(0)) for i, c in enumerate(lost.values())}
    found = rows.select(F.col(part).alias("part"), mask.alias("mask"), *[c.alias(n) for n, c in flags.items()])
    cells = found.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in flags])

    shape = "array<struct<state:int,filter:int,reach:long,leave:long>>"
    all_edges = F.array(*[F.struct(*map(F.lit, e)) for e in edges]).cast(shape)
    cells = cells.withColumn("e", F.explode(all_edges)).select("*", "e.*")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(names))]), F.col("filter") + 1)
    passed, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(bit) != 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    sums = cells.groupBy("part", "state", "filter", "reach", "leave").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        *[total(passed & fails, c).alias(name) for c, name in zip(flags, lost, strict=True)],
    )
    through = F.sum(F.col("reach") * F.col("leave") * F.col("removed")).over(Window.partitionBy("part", "filter"))  # 2^(k-1) rows
    sums = sums.withColumn("shapley", through)
    walks = orders(names, edges)
    steps = rows.sparkSession.createDataFrame(walks, "filter_order string, step int, state int, filter int")
    out = sums.join(F.broadcast(steps), ["state", "filter"])  # k * k! rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley", F.lit(len(walks) // len(names)).alias("n_orders"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id``, ``part`` (null: empty) and what each document fails: ``A`` under 200 words, ``B`` under half of the words different,
    ``C`` over 3 % capitals A-Z, ``D`` any of ``#$%&*|``, ``E`` its text stands under a smaller id.

    Null and empty texts are one text without words.  Rows without an id neither fail ``E`` nor make others fail it; repeated rows
    of one id do not repeat each other.  Texts of any length are taken whole.  Only digests of texts are dealt out; a text
    that very many rows share is counted before it is joined, so the join may split it.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), t.alias("t"), words(t).alias("w"))
    n = F.size("w")
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    rows = written(
        rows.select(
            "id",
            "part",
            (n < 200).alias("A"),
            (100 * F.size(F.array_distinct("w")) < 50 * n).alias("B"),
            (100 * capitals.cast("long") > 3 * F.length("t").cast("long")).alias("C"),
            F.col("t").rlike(r"[#$%&*|]").alias("D"),
            F.unhex(F.sha2("t", 256)).alias("digest"),
        ),
        "failures",
    )
    firsts = cut(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    return rows.join(firsts, "digest", "left").select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``audit_orders`` of the five filters of ``failures`` by language, with the good and the toxic documents lost.

    A document is good, or toxic, if any of its label rows says so; labels without an id or a document count nothing.
    """
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = failures(docs, id_col).join(cut(marks), "id", "left")
    return audit_orders(rows, "ABCDE", "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
