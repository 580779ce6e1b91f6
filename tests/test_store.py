import glob
import os
import random

import pytest

from hitweave.operators import catalog as G
from hitweave.sources.store import Catalog, SourceStore, delete_stored

SCHEMA = "source_name string, chunk_index int, text string"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture
def store(spark, tmp_path):
    s = SourceStore(spark, str(tmp_path / "chunks"), buckets=16)
    data = [(f"s{i}", k, f"text {i} {k}") for i in range(40) for k in range(1, 4)] + [(None, 1, "no source")]
    s.create(table(spark, data))
    return s, data


def test_replace_rewrites_touched_buckets_only(spark, store):
    s, data = store
    assert rows(s.read()) == sorted(data, key=str)
    before = files(s.path)
    new = [("s3", 1, "new"), ("s3", 2, "new"), ("fresh", 1, "x")]
    s.replace(table(spark, new))
    data = [r for r in data if r[0] != "s3"] + new
    assert rows(s.read()) == sorted(data, key=str)
    after = files(s.path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(kept) >= len(before) - 2 and {f.split("/")[-2] for f in set(after) - kept} == {f.split("/")[-2] for f in set(before) - kept}
    # again, with the same result; then a second change
    s.replace(table(spark, new))
    assert rows(s.read()) == sorted(data, key=str)
    s.replace(table(spark, [(None, 7, "still none")]))
    assert rows(s.read()) == sorted([r for r in data if r[0] is not None] + [(None, 7, "still none")], key=str)


def test_delete_and_emptied_buckets(spark, store):
    s, data = store
    gone = spark.createDataFrame([(f"s{i}",) for i in range(0, 40, 2)] + [("unknown",), (None,)], "source_name string")
    s.delete(gone)
    left = [r for r in data if r[0] and int(r[0][1:]) % 2]
    assert rows(s.read()) == sorted(left, key=str)
    s.delete(s.read().select("source_name").where("source_name <> 's1'"))
    assert rows(s.read()) == [r for r in sorted(left, key=str) if r[0] == "s1"]
    assert len({f.split("/")[-2] for f in files(s.path)}) == 1
    before = files(s.path)
    s.replace(table(spark, [r for r in data if False]))
    s.delete(gone.where("false"))
    assert files(s.path) == before


def test_random_changes_equal_the_table_form(spark, tmp_path):
    r = random.Random(4)
    s = SourceStore(spark, str(tmp_path / "t"), buckets=4)
    now = table(spark, [(f"s{r.randrange(12)}", i, "a") for i in range(60)])
    s.create(now)
    data = rows(now)
    for step in range(4):
        new = [(f"s{r.randrange(15)}", i, f"b{step}") for i in range(r.randrange(1, 6))]
        want = rows(G.upsert_by_source(table(spark, data), table(spark, new)).select("source_name", "chunk_index", "text"))
        s.replace(table(spark, new))
        data = rows(s.read())
        assert data == want


def test_large_source_is_written_by_many_tasks(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        s = SourceStore(spark, str(tmp_path / "t"), buckets=4)
        s.create(spark.range(20000).selectExpr("IF(id % 3 = 0, 'hot', concat('s', id)) AS source_name", "id", "uuid() AS text").repartition(8))
        many = {f.split("/")[-2]: 0 for f in files(s.path)}
        for f in files(s.path):
            many[f.split("/")[-2]] += 1
        assert max(many.values()) > 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_catalog_in_any_deliveries(spark, tmp_path):
    r = random.Random(5)
    schema = "filename string, user_id string, event string, event_ts long, size long, type string, namespace string, chunks long"
    data = [
        (f"f{r.randrange(20)}", r.choice(["u", "v", None]), r.choice(["upload", "finish"]), t, t * 10, "txt", f"n{t % 3}", t % 7) for t in range(200)
    ]
    every = spark.createDataFrame(data, schema)
    for n in range(3):
        r.shuffle(data)
        c = Catalog(spark, str(tmp_path / f"c{n}"), buckets=8)
        c.create(spark.createDataFrame(data[:50], schema))
        for a in range(50, 200, 75):
            c.register(spark.createDataFrame(data[a : a + 75], schema))
        assert rows(c.rows()) == rows(G.catalog_register(every))


def test_delete_stored_equals_delete_source(spark, tmp_path):
    f = [(i, f"name{i % 13}", i % 4) for i in range(60)]
    fd = spark.createDataFrame(f, "file_id long, filename string, status int")
    cd = spark.createDataFrame([(i, f"name{i % 13}") for i in range(60)], "chunk_id long, source_name string")
    req = spark.createDataFrame([("name1", None), (None, 6), (None, 7), (None, 12), (None, 999), (None, None), ("none", None)], "name string, file_id long")
    files_, chunks = SourceStore(spark, str(tmp_path / "f"), "filename", 8), SourceStore(spark, str(tmp_path / "c"), buckets=8)
    files_.create(fd)
    chunks.create(cd)
    delete_stored(chunks, files_, req)
    left, kept = G.delete_source(fd, cd, req)
    assert rows(files_.read().select("file_id", "filename", "status")) == rows(left.select("file_id", "filename", "status"))
    assert rows(chunks.read().select("chunk_id", "source_name")) == rows(kept.select("chunk_id", "source_name"))
