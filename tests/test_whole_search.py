"""Searches are asked for every example, whatever its id."""

import pytest

from hitweave.plans import load
from tests.oracle_check import compare, connect

R = load()
IDS = (3, 7, 14, 99, 100, 101, 250, 300, 1234)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = [(i, f"{words[n]} {words[(n + 3) % 10]} of the {words[(n * 7) % 10]}. More {words[n]} for all.", f"s{n % 2}") for n, i in enumerate((*IDS, 5000))]
    vectors = [(i, f"l{n % 3}", [float(n + 1), float(n * n % 5), 1.0]) for n, i in enumerate(IDS)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{root}/d")
    spark.createDataFrame(vectors, "vec_id long, label string, embedding array<float>").coalesce(1).write.parquet(f"{root}/e")
    for name, at in (("documents", "d"), ("embeddings", "e")):
        next((root / at).glob("*.parquet")).rename(root / f"{name}.parquet")
    return str(root)


@pytest.mark.parametrize("key", ["hybrid_search", "ranked_fusion", "hybrid_search_both", "search_fallback"])
def test_every_example_is_asked(spark, tables, key):
    df = R.QUERIES[key](spark, tables)
    assert {r.query_id for r in df.select("query_id").collect()} == set(IDS)  # before, 100 and 300 alone
    assert compare(df, connect(tables), R.ORACLES[key]) is None
