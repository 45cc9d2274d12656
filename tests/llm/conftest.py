import pytest

from llm_helpers import CLASHING, ID_TEXT, words


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and long texts, ties and repeated rows."""
    base = words(1, 120)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (None, base, None, None),
            (3, base, "en", None), (3, base, "en", None), (4, base + " tail", "de", "a"),
            (5, "one", "en", "b"), (6, "one two", "en", "b"), (6, "ONE two", "en", "b"),
            (None, None, None, None), (7, " \n\t ", "en", "b"), (8, "x" * 30_000, "en", "a"),
            (9, words(2, 20_000), "fr", "a"), (10, "ü€😀 " * 200, "fr", "c"),
            (10, words(3, 80), "fr", "c"), (11, "a" * 99, "en", "c")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(odd_rows, ID_TEXT).repartition(3)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ID_TEXT)
