import numpy as np
import pytest

from hitweave.operators import nearest as N
from hitweave.operators import search as S

SCHEMA = "key long, embedding array<float>"


def clustered(n, centres=60, d=32, spread=0.25, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, name="key"):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], SCHEMA.replace("key", name)).repartition(3)


def rows(df, name="key"):
    return {(r["query_id"], r[name], round(r["score"], 6)) for r in df.collect()}


def test_recall_and_exact_scores(spark):
    v = clustered(3000)
    c, q = frame(spark, v), frame(spark, v, "query_id")
    exact, found = rows(S.vector_topk(q, c, "key", 10)), N.vector_topk_lsh(q, c, "key", 10).collect()
    got = {(r["query_id"], r["key"], round(r["score"], 6)) for r in found}
    assert len(got & exact) >= 0.9 * len(exact)
    # whatever is found has its exact score, and lists are ordered
    cos = v.astype(np.float32).astype(np.float64)
    cos = cos / np.linalg.norm(cos, axis=1, keepdims=True)
    for r in found:
        assert r["score"] == pytest.approx(max(0.0, float(cos[r["query_id"]] @ cos[r["key"]])), abs=1e-8)
    for i in range(0, 3000, 500):
        mine = sorted((r["ord"], -r["score"], r["key"]) for r in found if r["query_id"] == i)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1:])


def test_few_pairs_are_scored(spark, monkeypatch):
    """With close neighbours, a small part of all pairs shares a bucket."""
    v = clustered(2000, spread=0.15)
    planes = np.random.default_rng(N.SEED).normal(size=(32, N.TABLES * N.BITS))
    h = (v @ planes > 0).reshape(len(v), N.TABLES, N.BITS) @ (1 << np.arange(N.BITS))
    share = np.mean([(h[i] == h).any(axis=1).mean() for i in range(0, 2000, 20)])
    assert share < 0.2
    assert N.shared_bucket_chance(0.95) > 0.99 and N.shared_bucket_chance(0.0) < 0.1


def test_hot_bucket_in_blocks_and_odd_rows(spark):
    """A third of all vectors are equal; blocks of any size give the same."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16))
    v[:200] = v[0]
    v[250] = 0
    c, q = frame(spark, v), frame(spark, v[190:260], "query_id")
    none = spark.createDataFrame([(9999, None)], SCHEMA)
    want = rows(N.vector_topk_lsh(q, c, "key", 7, bits=3, tables=8))
    assert rows(N.vector_topk_lsh(q.unionByName(none.withColumnRenamed("key", "query_id")), c.unionByName(none), "key", 7, bits=3, tables=8, block=13)) == want
    mine = sorted(r[1] for r in want if r[0] == 3)  # query 3 is vector 193
    assert mine == list(range(7))
    with pytest.raises(Exception, match="vectors of 16 numbers expected"):
        N.vector_topk_lsh(q, spark.createDataFrame([(1, [1.0])], SCHEMA), "key", 5).collect()
    assert N.vector_topk_lsh(q.where("false"), c, "key", 5).collect() == [] and N.vector_topk_lsh(q, c.where("false"), "key", 5).collect() == []


def test_recall_on_the_given_vectors(spark):
    """Random directions: planes few enough for a recall of 0.9 over all queries."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    q = e.withColumnRenamed("vec_id", "query_id")
    exact = rows(S.vector_topk(q, e, "vec_id", 10), "vec_id")
    found = rows(N.vector_topk_lsh(q, e, "vec_id", 10, bits=4, tables=24), "vec_id")
    assert len(exact & found) >= 0.9 * len(exact)
