import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with names that operators use inside.
CLASH = ["row", "size", "score", "key", "rid", "spans", "rep", "removed", "copies", "shard", "label", "h", "k1", "found_md5"]


def words(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, odd characters."""
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    return [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(near), "en", "a", 1),
        (3, " ".join(base), "en", "b", 1),
        (4, None, "en", "a", 1),
        (5, "", "de", "a", 1),
        (6, " \t\n ", "de", None, 1),
        (7, "Ünï cödé — ΑΒΓ 漢字 😀 A\x0bB", None, "é", None),
        (8, " ".join(words(5_000, 2)), "en", "a", 1),
        (9, "one two", "en", None, 1),
        (10, "ALL RIGHTS RESERVED. Licensed under CC BY-NC 4.0. Released under the MIT License", "en", "c", 1),
        (11, "x" * 5000, "en", "c", 1),
        (12, "!!! ??? 123", "en", "c", 1),
        (-7, "tab\tand\x0cfeed", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def repeated_rows(odd_rows):
    """Rows that repeat, share an id with another text, or have no id."""
    return odd_rows + [odd_rows[0], odd_rows[0], (1, "another text under the same id", "en", "a", 1), (None, odd_rows[0][1], "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def repeated(spark, repeated_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(repeated_rows, DOCS).repartition(3)
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
