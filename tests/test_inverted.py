import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import search as S
from hitweave.operators.inverted import KeywordIndex

SCHEMA = "key long, text string, content_without_overlap string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta épsilon the the the of of".split() + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(500)]
    rows[3] = (3, None)
    rows[9] = (9, "rareword alpha")
    d = spark.createDataFrame(rows, "key long, text string").withColumn("content_without_overlap", F.substring("text", 5, 1000))
    return d.cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "Alpha the"), (2, "epsilon of unknown"), (3, "zzz"), (4, ""), (5, "w1 w2 w3 the of alpha"), (6, "rareword"), (7, None)]
    return spark.createDataFrame(rows, "query_id long, query string").withColumn("k", F.col("query_id") + 2)


def pick(df):
    return sorted((r["query_id"], r["ord"], r["key"], round(r["score"], 8)) for r in df.collect())


def index(spark, path, **options):
    return KeywordIndex(spark, str(path), S.DOC_FIELDS, **options)


@pytest.mark.parametrize("shard", [7, 64, 1 << 15])
def test_equals_the_scan(spark, tmp_path, chunks, queries, shard):
    x = index(spark, tmp_path / "i", buckets=8, shard=shard)
    x.append(chunks.repartition(3), "key", 0)
    filled = chunks.na.fill("")
    assert pick(x.search(queries, 15)) == pick(S.bm25_topk(queries, filled, "key", S.DOC_FIELDS, 15))
    assert pick(x.search(queries, "k", limit_bytes=2500)) == pick(S.bm25_topk(queries, filled, "key", S.DOC_FIELDS, "k"))


def test_appends_equal_one_index(spark, tmp_path, chunks, queries):
    x = index(spark, tmp_path / "i", buckets=8, shard=50)
    want = pick(S.bm25_topk(queries, chunks.na.fill(""), "key", S.DOC_FIELDS, 15))
    for part in range(3):
        x.append(chunks.where(F.col("key") % 3 == part), "key", part)
    assert pick(x.search(queries, 15)) == want
    before = x.postings().count()
    x.append(chunks.where("key % 3 = 1"), "key", 1)  # a repeated append
    assert x.postings().count() == before and pick(x.search(queries, 15)) == want
    n, mean = x.totals()
    assert n == 500 and mean == pytest.approx([r for r in chunks.na.fill("").agg(*[F.avg(F.size(S.tokens(F.col(f)))) for f in S.DOC_FIELDS]).first()])


def test_rare_terms_read_few_files(spark, tmp_path, chunks, queries):
    x = index(spark, tmp_path / "i", buckets=32, shard=50)
    x.append(chunks, "key", 0)
    whole = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/i/*/bucket=*/*.parquet"))
    rows = x.asked(spark.createDataFrame([("rareword",)], "term string"))
    assert [(r.term, r["n"], len(r["at"]), r["count1"]) for r in rows.collect()] == [("rareword", 1, 1, [1])]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("bucket=")[1].split("/")[0] for f in rows.select("term", F.input_file_name().alias("f")).toPandas()["f"]}
    asked = sum(os.path.getsize(f) for b in read for f in glob.glob(f"{tmp_path}/i/*/bucket={b}/*.parquet"))
    assert len(read) == 1 and asked < whole / 8


def test_postings_of_a_row_are_bounded(spark, tmp_path):
    d = spark.range(1000).selectExpr("id AS key", "'the same words' AS text", "'the' AS content_without_overlap").repartition(2)
    x = index(spark, tmp_path / "i", buckets=4, shard=64)
    x.append(d, "key", 0)
    rows = x.postings().where("term = 'the'").collect()
    assert max(r["n"] for r in rows) <= 64 and sum(r["n"] for r in rows) == 1000
    assert all(len(r["at"]) == r["n"] and set(r["count0"]) | set(r["count1"]) <= {0, 1} for r in rows)


def test_empty(spark, tmp_path, chunks, queries):
    x = index(spark, tmp_path / "i")
    x.append(chunks.where("false"), "key", 0)
    assert x.search(queries, 5).collect() == []
    x.append(chunks, "key", 1)
    assert x.search(queries.where("false"), 5).collect() == []
    assert x.search(queries.where("query_id IN (3, 4, 7)"), 5).collect() == []
