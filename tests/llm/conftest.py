import public_tokenizers
import pytest

TEXTS = ["", None, "a", "The cat sat. The dog ran!\nYou idiot moron.", "  two  spaces \t tab ", "日本語 text é ▁ mark", "x" * 3000, "one two three four five six seven " * 400, "Same text here.", "Same text here."]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those that operators add."""
    rows = [(i, t, None if i % 4 == 0 else "en", "s" if i % 3 else None, "x", 1.0, True) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id at all", "en", "s", "x", 1.0, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, toxicity double, kept boolean")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path
