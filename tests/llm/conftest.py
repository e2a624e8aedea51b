import pytest
from pyspark.sql import functions as F

WORDS = "the of and river stone light over under moss fern glass paper wind salt iron wheel lamp road field cloud".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like internal ones."""
    base = sentence(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base, "en", "b", 5), (3, near, "fr", "b", 5), (4, None, "en", "a", 5),
        (5, "", None, "c", 0), (6, " \n\t ", "en", None, None), (7, sentence(7, 30_000), "fr", "c", 9), (None, sentence(8, 40), "fr", "a", 1),
        (9, "one two", "en", "a", 7), (10, "123 456 !!", "en", "a", 7), (11, None, None, None, None), (12, "ÉTÉ été Straße 漢字 😀", "fr", "d", 3),
        (13, "x" * 200_000, "en", "d", 3),
    ] + [(100 + i, sentence(100 + i, 50), "en" if i % 2 else "fr", f"s{i % 3}", i) for i in range(20)]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("rec", "sig", "row", "th", "part", "block", "term", "spans", "held", "id", "n", "at", "bucket", "letters", "ids", "a b, c"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
