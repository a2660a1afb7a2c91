import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, kept string, size string, part string, label string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, "no", "s", "p", "l")


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; further columns with names that clash."""
    base = words(1, 120)
    near = [*base[:60], "other", *base[61:]]
    long = " ".join(words(2, 60_000))
    return [
        row(1, " ".join(base)), row(2, " ".join(near), source="b"), row(3, "\n".join(base)), row(3, "\n".join(base)), row(4, None, None, None), row(5, ""), row(6, " \t\n"), row(7, long, "de", "c"), row(8, long, "de", None),
        row(None, "only four words here"), row(None, "only four words here"), row(9, "é ü 漢字 \U0001f600 x"), row(10, " ".join(words(3, 300)), None), row(11, " ".join(words(4, 40)), source="b"), row(12, "x"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
