"""Quality rules with adaptive thresholds per language and source.

Every rule's statistic is summarised per (lang, source) in a mergeable quantile sketch: counts of logarithmic buckets, so
that a quantile is right within ``ACCURACY`` of its value and merging is addition.  Counts are pre-aggregated before the
shuffle, so a hot source costs one row per bucket and task.

A group's sketch starts with ``PRIOR`` documents placed at the percentiles of its language's sketch, and a language's with as
many at those of all documents: few documents say what their language says, many speak for themselves.  A rule's limit is
``median + reach * (quantile - median)`` in that sketch, for a quantile high in it (and likewise below, in two-sided rules),
so that limits follow each group's own distribution.  A share rests on counts: a document breaks a limit only if its count
lies ``FEW`` occurrences above it, since fewer say nothing about a text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, slices, written

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Bucket of values at or below the least one that is told from zero.
ZERO, LEAST_VALUE = -10_000, 1e-6
#: Documents of the broader sketch with which a group's sketch starts.
PRIOR = 100
#: Occurrences above a limit that a count needs.
FEW = 3
#: Rows of limits that are broadcast; more are joined by a shuffle.
MOST_LIMITS = 50_000
_SYMBOLS = b"#*$%&|<>"


class Rule(NamedTuple):
    """``count`` over ``per`` (1 at least) must not exceed the limit; with ``low``, nor fall below its mirror image."""

    count: str
    per: str
    quantile: float
    reach: float
    low: bool = False


RULES = {
    "symbol_share": Rule("n_symbols", "n_words", 0.90, 3.0),
    "dup_line_share": Rule("n_dup_lines", "n_lines", 0.99, 3.0),
    "repeat_share": Rule("n_repeat_words", "n_words", 0.99, 3.0),
    "upper_share": Rule("n_upper", "n_words", 0.99, 3.0),
    "mean_word": Rule("word_chars", "n_words", 0.90, 4.0, low=True),
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def measure(text: str) -> tuple[int, int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, lines with a word, words all in
    capitals."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0, 0, 0
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]  # bytes strip at ASCII white space only
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len({*windows}) < len(windows):
        counts, last = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return n, chars, symbols, len(lines) - len({*lines}), repeated, len(lines), sum(map(str.isupper, text.split()))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the counts of ``COUNTS`` (columns of these names in ``docs`` are replaced); a null text has no words."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    kept = docs.drop(*names)
    at, out_names = kept.columns.index(text_col), [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]) for batch in batches)
        for part in slices(named, f"c{at}"):
            found = zip(*[measure(x or "") for x in part.column(at).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in found)], out_names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(COUNTS).fields]))


def statistics(rules: dict[str, Rule] = RULES) -> dict[str, Column]:
    return {name: F.col(r.count) / F.greatest(r.per, F.lit(1)) for name, r in rules.items()}


def bucket(value: Column) -> Column:
    """Sketch bucket of a value that is not negative."""
    return F.when(value <= LEAST_VALUE, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / math.log(GAMMA))).cast("int")


def bucket_value(number: Column) -> Column:
    return F.when(number == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), number) * F.lit(2 / (GAMMA + 1)))


def sketches(stats: DataFrame, keys: list[str], rules: list[str]) -> DataFrame:
    """``keys``, ``rule``, ``bucket``, ``n``: mergeable by adding ``n`` up."""
    long = stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in rules])).alias("x"))
    return long.groupBy(*keys, "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def ranked(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``sketch`` with ``total`` and ``reached``, the rows up to each bucket.  A window holds one sketch, a few thousand
    buckets at most."""
    w = Window.partitionBy(*keys, "rule")
    return sketch.withColumn("total", F.sum("n").over(w)).withColumn("reached", F.sum("n").over(w.orderBy("bucket")))


def quantiles(sketch: DataFrame, keys: list[str], levels: dict[str, Column]) -> DataFrame:
    """``keys``, ``rule``, ``total`` and each named quantile: the value of the first bucket that reaches its level."""
    rows = ranked(sketch, keys)
    at = [F.min(F.when(F.col("reached") >= q * F.col("total"), F.col("bucket"))).alias(n) for n, q in levels.items()]
    return rows.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *at).withColumns({n: bucket_value(F.col(n)) for n in levels})


def prior(sketch: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``size`` documents at the percentiles of each sketch, as a sketch."""
    rows = ranked(sketch, keys)
    upto = lambda c: F.floor(size * c / F.col("total") + 0.5)
    return rows.select(*keys, "rule", "bucket", (upto(F.col("reached")) - upto(F.col("reached") - F.col("n"))).alias("n")).filter("n > 0")


def smoothed(own: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The sketches of ``own`` (per ``keys``, broad to narrow), each begun with ``size`` documents of the one level above."""
    if not keys:
        return merged(own, [])
    level = cut(merged(own, keys))
    above = prior(smoothed(level, keys[:-1], size), keys[:-1], size)
    names = level.select(*keys).distinct()
    above = above.withColumnsRenamed({c: f"b_{c}" for c in keys[:-1]})
    same = F.lit(True)
    for c in keys[:-1]:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    begun = names.join(above, same) if keys[:-1] else names.crossJoin(F.broadcast(above))  # size rows a rule at most
    return merged(level.unionByName(begun.select(*level.columns)), keys)


def thresholds(stats: DataFrame, keys: list[str], rules: dict[str, Rule] = RULES, size: int = PRIOR) -> DataFrame:
    """``keys`` and ``<rule>_low``, ``<rule>_high`` for every group in ``stats``; ``keys`` go from broad to narrow."""
    own = cut(sketches(stats, keys, [*rules]))
    pairs = [F.lit(x) for name, r in rules.items() for x in (name, r.quantile)]
    level = F.element_at(F.create_map(*pairs), F.col("rule"))
    found = quantiles(smoothed(own, keys, size), keys, {"bottom": 1 - level, "middle": F.lit(0.5), "top": level})
    out = []
    for name, r in rules.items():
        high = F.col("middle") + r.reach * (F.col("top") - F.col("middle"))
        low = F.col("middle") - r.reach * (F.col("middle") - F.col("bottom")) if r.low else F.lit(-1.0)
        out += [F.max(F.when(F.col("rule") == name, x)).alias(f"{name}_{side}") for x, side in ((high, "high"), (low, "low"))]
    return found.groupBy(*keys).agg(*out)


def judge(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), rules: dict[str, Rule] = RULES, size: int = PRIOR, with_text: bool = True) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` (fewer than 50 words, or over half of them in repeated windows), ``failed``
    (the names of the adaptive rules that it breaks) and ``kept``.

    Null or empty text fails the base rules; such documents, and all others that fail them, count nowhere in the sketches.
    Null keys form groups of their own.  Repeated rows count each time.  Columns of the names added are replaced.  An empty
    table gives an empty result.  A text of any length is measured whole, with some 20 times its size in memory.  Counts are
    taken once and written to the shared folder, with the text or without; limits are broadcast only up to ``MOST_LIMITS``
    groups.
    """
    keys = list(keys)
    names = [f"{r}{x}" for r in rules for x in ("", "_low", "_high")]
    counted = measured(docs.drop("base_failed", "failed", "kept", *names), text_col)
    counted = written(counted if with_text else counted.drop(text_col), "quality")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", base)
    stats = statistics(rules)
    limits = cut(thresholds(counted.filter("not base_failed").select(*keys, *[stats[r].alias(r) for r in rules]), keys, rules, size))
    few_limits = limits.count() <= MOST_LIMITS
    limits = limits.toDF(*[f"t_{c}" if c in keys else c for c in limits.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    joined = counted.join(F.broadcast(limits) if few_limits else limits, same, "left").drop(*[f"t_{c}" for c in keys])
    broken = []
    for name, r in rules.items():
        per = F.greatest(r.per, F.lit(1))
        above, below = F.col(r.count) - F.col(f"{name}_high") * per, F.col(f"{name}_low") * per - F.col(r.count)
        broken.append(F.when((above > FEW) | (below > FEW), F.lit(name)))
    failed = F.array_compact(F.array(*broken))
    joined = joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return joined.drop(*[f"{r}_{x}" for r in rules for x in ("low", "high")])
