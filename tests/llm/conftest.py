"""Small tables with the cases that every operator must bear."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ["id", "digest", "rows", "nth", "keep_id", "copies", "component", "node", "key", "fp", "line", "n", "a", "b", "d", "x", "shard", "depth", "bin_id", "pos", "n_tokens", "finish", "queue", "level", "name", "score", "block", "h", "k", "low"]

LONG = "\n".join(f"line {i} of a very long text with word{i % 977} and term{i % 1013}" for i in range(20_000))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    same = "Some plain words stand here, on one line\nand then a second line follows it."
    return [
        (1, same, "en", "s1", 10), (1, same, "en", "s1", 10), (2, same, "en", "s1", 10), (None, same, "en", None, None), (None, same, "en", None, None),
        (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s1", 0), (5, "", "en", "s2", 0), (6, " \t\n  ", "en", "s2", 6), (7, LONG, "en", "s1", len(LONG)), (8, LONG, "en", "s1", len(LONG)),
        (9, LONG + "!", "en", "s1", 1), (10, "!!! ???", "en", "", 7), (11, "one", "en", "s2", 3), (12, "two", "en", "s2", 3), (13, "MIT \u0000 zero", None, "s3", 1), (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).cache()


@pytest.fixture(scope="session")
def clashing(spark, edges):
    from pyspark.sql import functions as F

    return edges.withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text, source) of all documents, in the order of their ids."""
    return sorted((r["doc_id"], r["text"], r["source"]) for r in documents.collect())


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
