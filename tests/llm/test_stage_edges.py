"""Each pipeline stage on nulls, ties, empty tables, long texts and columns whose names clash with its own."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

NAMES = ["h1", "h2", "kept", "n_words", "toxicity", "failed", "id", "fp", "component_id", "given_0"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    text = given.orderBy(F.desc(F.length("text"))).first().text
    more = [(None, text, None, None), (90_001, None, "en", "s"), (90_002, "", None, "s"), (90_003, "word " * 60_000, "en", None), (None, None, None, None), (90_004, text, "en", "s"), (90_004, text, "en", "s")]
    rows = given.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES]).cache()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_filters_keep_the_columns_they_are_given(spark, folder, docs, name, stage):
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert 0 < len(rows) < docs.count()
    assert all(r[c] == f"own {c}" for r in rows for c in NAMES)
    assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}
    assert stage(spark, docs.limit(0), folder).collect() == []
    if name == "simhash_near_duplicates":
        assert sum(r.doc_id == 90_004 for r in rows) <= 1 and sum(not r.text for r in rows) == 1


def test_packing_of_odd_rows(spark, folder, docs):
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.length for r in got if r.doc_id == 90_003) > 60_000 and sum(r.doc_id is None for r in got) >= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []
