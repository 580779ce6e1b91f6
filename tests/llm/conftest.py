import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size long, _h string, _score double, _n int"


@pytest.fixture
def docs(spark):
    """A table of documents with more columns, whose names operators use for their own results."""

    def make(rows, parts=3):
        full = [(i, t, "en", s, None if t is None else len(t), 0.5, 7, 9, "x", 0.1, 3) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows, an id of null."""
    long = " ".join(f"word{i % 977} plain text, number {i}." for i in range(40000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "one", None), (4, "one", None), (5, long, "b"), (6, long, "b"),
        (None, "no id here at all", "b"), (8, "É ñ 漢字 🙂", ""), (9, "\x00\x01 ok", "a"), (5, "the same id again", "a"),
    ]
    return docs(rows)


@pytest.fixture
def empty(docs):
    return docs([])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


__all__ = ["F", "by_id", "rows"]
