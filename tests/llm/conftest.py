import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    words = [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]
    return " ".join(words)


def make(spark, rows, schema=DOCS):
    """Rows of (doc_id, text[, lang]) as a documents table."""
    full = [(i, t, r[0] if r else "en", "s", None if t is None else len(t)) for i, t, *r in rows]
    return spark.createDataFrame(full, schema)


#: Nulls everywhere, empty and blank texts, repeated rows and ids, ties, a very long text.
ODD = [(1, "a b c"), (1, "a b c"), (2, None), (None, "a b c"), (None, None), (3, ""), (4, " \n\t "), (5, "x" * 70_000), (6, "long " * 60_000), (7, "a b c", None), (8, "é" * 10), (9, "\n".join(["the same line of thirty letters"] * 3)), (1, "other text under one id")]


@pytest.fixture
def odd(spark):
    """The odd rows, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    d = make(spark, ODD)
    for c in ("text_hash", "keep", "h1", "bucket", "a", "b", "key", "rep", "item_id", "_o", "n", "drop", "band", "removed", "_qs_hash", "_qs_id", "_qs_bad", "_qs_text", "_QS_ROW", "_qs_dropped", "_t", "_y", "ids", "part", "dense", "a.b"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture
def empty(spark):
    return make(spark, [])
