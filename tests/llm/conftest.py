import pytest
from pyspark.sql import types as T

# Null ids and texts, empty and very long texts, repeated rows, ties, and columns that clash with the operators' own.
ROWS = [
    (1, "Mail a.b@mail.example.com or +49 (30) 123-4567 now", "en", "a", 1, "x"),
    (2, "Mail a.b@mail.example.com or +49 (30) 123-4567 now", "en", "a", 1, "x"),
    (2, "Mail a.b@mail.example.com or +49 (30) 123-4567 now", "en", "a", 1, "x"),
    (3, None, "en", None, None, None),
    (4, "", None, "b", 0, None),
    (5, " \t\n", "de", "b", 3, None),
    (None, "one two three four five six", "en", "b", 3, None),
    (6, "one two three four five six", "en", "b", 3, None),
    (7, "ONE two\tthree four  five six", "en", "c", 3, None),
    (8, "one two", "en", "c", 3, None),
    (9, "Two ▁ marks <|endoftext|> and <s> \n\n end ", "en", "c", 3, None),
    (10, "card 4111 1111 1111 1111, host 10.0.0.255, bad 10.0.0.256 4111111111111112 日本語 \U0001f600", "en", "d", 3, None),
    (11, "word " * 30_000 + "x" * 40_000, "en", "d", 3, None),
    (12, " ".join(f"w{i}" for i in range(100)), "en", "d", 3, None),
    (13, " ".join(f"w{i}" for i in range(100)) + " tail", "en", "d", 3, None),
    (14, " ".join(f"w{i}" for i in range(50)), "en", "d", 3, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"
CLASHING = ("key", "component_id", "tkey", "shard", "h1", "score")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns named like ones the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], T.StructType(odd.schema.fields))
