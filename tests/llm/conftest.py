import pytest

from tidemark.llm.common import prepare

SF = "/root/testdata/sf0.001"
#: Awkward rows: null and repeated ids, null and empty texts, white space, one very long text, columns with clashing names.
LONG = "wort " * 60_000
ROWS = [
    (None, "no id at all here", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, LONG, "de", "b"),
    (5, "the same text twice in a row", "en", "a"), (5, "the same text twice in a row", "en", "a"), (6, "the same text twice in a row", "en", None),
    (5, "another text with the same id", "fr", "b"), (7, "12345 67890", "en", "b"), (8, "é中😀 x", None, "c"),
]


@pytest.fixture
def awkward(spark):
    from pyspark.sql import functions as F

    prepare(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    names = ("n_chars", "score", "size", "taken", "key", "class_id", "held_out", "part", "guest", "ids", "spans_email", "band", "rank", "rate", "lettered", "mixed_rate", "dedup_key")
    return docs.withColumns({n: F.lit(1).cast("long") for n in names})


@pytest.fixture
def empty(spark, awkward):
    return awkward.limit(0)


@pytest.fixture
def documents(spark):
    return prepare(spark).read.parquet(f"{SF}/documents.parquet")
