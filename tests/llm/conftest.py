import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The quality rules whose rates hosts have.
HOST_RULES = ("symbol", "upper", "dup_line", "any")
#: Names that the operators use inside.
CLASHES = ("row_no", "doc", "fp", "digest", "host", "words", "label", "score", "kept", "h", "d", "range", "shard", "piece", "sequence_id", "spans", "t", "of")


def rows(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long and non-ASCII texts, repeated lines, junk."""
    long = " ".join(words(30_000, 1, 3000))
    return [None, "", "   \n\t ", "one", "two words", "A b C", "a B c", "same text here " * 10, "same text here " * 10, long, "line one\nline one\nline two", "### $$$ *** &&& ||| <<>>" * 5, "É́ ÀÇ 日本語 😀 ﬁ x", "x y z\x1cq", "tab\tand\rreturn\x0bthen\x0cfeed", " ".join(words(200, 2))]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts, with a repeated row, null ids and null sources, and columns of clashing names."""
    from pyspark.sql import functions as F

    data = [*rows(odd_texts), rows(odd_texts)[9], (None, "no id", "en", None, 5), (None, "same text here " * 10, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
