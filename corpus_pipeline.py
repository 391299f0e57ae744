"""A corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of one, written as Parquet and read again, is the
``docs`` of the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintframe.llm import packing, quality, simhash, toxicity
from stintframe.llm.common import table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage with every column that it does not read under a name that clashes with none of its own, and back again."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in ("doc_id", "text", "lang", "source") else f"given_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).toDF(*docs.columns)

    return run


@keeping_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's and source's thresholds.

    Null, empty and short texts fail the base rules.  Null languages and sources are groups of their own.  Repeated rows are
    judged alike.  Texts are judged whole, whatever their length.  Other columns stay, whatever their names.  An empty table stays so.
    """
    judged = quality.judge(docs)
    return judged.filter("kept").select(*docs.columns)


@keeping_columns
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from the labelled documents still there.

    Null and empty texts score 0.  Documents without an id, or without a label, are scored like others.  Without labels of both
    classes nothing tells documents apart: all are kept unless every label is toxic.  Texts are scored whole; other columns stay,
    whatever their names.  An empty table stays so.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("toxicity < 0.7").select(*docs.columns)


@keeping_columns
def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first by id, rows without id last, then by a hash of the text.

    Near copies share 0.8 or more of their different shingles of five words, which is checked exactly; a document linked
    through others belongs to the group.  Different texts under one id are documents of their own; of rows equal in id and
    text one stays.  Null and empty texts are copies of each other.  Texts are compared whole, whatever their length; other columns
    stay, whatever their names.  An empty table stays so.
    """
    found = simhash.similar_documents(docs, shingle_words=5, least=0.8)
    kept = found.filter("kept").select("h1", "h2").distinct()
    # the join's partitioning and order serve the dropping of repeated rows too
    marked = docs.select(*docs.columns, *simhash.row_hashes("doc_id", "text"))
    return marked.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; null and empty texts are the end id alone.  Texts of any length are cut over as many sequences
    as they need, rows that repeat are packed each, other columns are left out, and no rows give no sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_duplicates", near_duplicate_filter),
    ("packing", pack),
]

#: SQL can express neither the fitted toxicity model nor the token ids; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
