"""Rows that every document operator must take."""

import pytest

#: Rows that every document operator must take: nulls, empty, blank, long, repeated and odd texts.
LONG = " ".join(f"w{k}" for k in range(30_000))
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "a", 70),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "x" * 200_000, "en", "b", 200_000),
    (8, "The Quick brown fox jumps over the lazy dog and runs far away from here now", "de", "b", 70),
    (8, "The Quick brown fox jumps over the lazy dog and runs far away from here now", "de", "b", 70),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here now", "en", "c", 70),
    (10, "é ñ 😀 mail a.b@c.example.com, card 4111 1111 1111 1111 ip 10.0.0.1 +1 (212) 555-0134", "es", "c", 80),
    (-11, "one", "es", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("key", "a", "score", "words", "digest", "kept", "start", "items", "chunk", "shard", "n", "ids", "text_hash")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
