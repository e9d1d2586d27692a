import random

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a small frame of more than one partition; works for empty tables and void values alike."""

    def make(rows, schema):
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented words by a fixed seed."""
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]

    def make(n, seed):
        r = random.Random(seed)
        return [r.choice(pool) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def odd_docs(words):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, equal ids with different texts."""
    long = " ".join(words(60_000, 1))
    return [
        (None, "no id here " + " ".join(words(30, 2)), "en", "s1", 1),
        (1, None, "en", "s1", None),
        (2, "", None, "s1", 0),
        (3, " \t\n\x0b\f\r ", "en", None, 7),
        (4, long, "en", "s1", len(long)),
        (5, "one", "en", "s2", 3),
        (5, "one", "en", "s2", 3),
        (6, " ".join(words(50, 3)), "de", "s2", 1),
        (6, " ".join(words(50, 4)), "de", "s2", 1),
        (7, "\u00a0 Ünïcode \U0001f600 text\u2003with\x1codd spaces", "fr", "s3", 1),
        (-8, "minus " + "x" * 5000, "fr", "s3", 1),
    ]
