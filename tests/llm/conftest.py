import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that the operators use for themselves, as extra columns of an input
CLASH = ["kept", "score", "size", "copies", "fp", "component_id", "sketch", "part", "row", "label", "bucket", "idx", "target", "rank", "word", "value"]


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a null id, ties, repeated rows, a very long text."""
    long_text = " ".join(f"w{i * 7919 % 100003}" for i in range(60_000))
    return [
        (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "a text without an id of its own", None, "a", 31),
        (None, None, None, None, None), (5, "Straße ÄÖ é\u00a0x 😀 end\n\nline\nline\nline", "de", "é", 40),
        (6, "the same text twice " * 30, "en", "a", 600), (7, "the same text twice " * 30, "en", None, 600), (8, long_text, "en", "b", len(long_text)),
        (9, "x" * 50_000, None, "b", 50_000),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(edge_rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
