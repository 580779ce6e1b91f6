"""Places in sources are found by keys, and walks know lengths without texts."""

from pyspark.sql import functions as F

from hitweave.operators import expansion as E
from hitweave.plans.tables import _placed
from tests.test_slim import dealt

EVERY = "vec_id long, source_name string, text string, embedding array<float>"


def test_places_are_ranked_without_texts(spark):
    rows = [(i, f"s{i % 2}", f"text {i}", None) for i in range(10)] + [(3, "s1", "text 3", None), (3, "s0", "other 3", None)]
    out = _placed(spark.createDataFrame(rows, EVERY))
    got = sorted((r.source_name, r.chunk_index, r.total_chunks, r.vec_id) for r in out.collect())
    s0, s1 = [0, 2, 3, 4, 6, 8], [1, 3, 3, 5, 7, 9]
    assert got == [("s0", i, 6, v) for i, v in enumerate(s0, 1)] + [("s1", i, 6, v) for i, v in enumerate(s1, 1)]
    assert {(r.vec_id, r.source_name): r.text for r in out.collect()}[(3, "s0")] == "other 3"
    # the texts meet the places by id and are in no window over a source
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "source_name" in line.split("], [")[1]]
    assert windows and not any("text" in line for line in windows)


def test_walk_takes_given_lengths(spark):
    chunk = "collection string, source_name string, chunk_index int, total_chunks int, prev_chunk_index int, next_chunk_index int, text string, content_without_overlap string, text_size int"
    rows = [("doc", "s", i, 9, i - 1 or None, i + 1 if i < 9 else None, "x" * 10, "x", 10) for i in range(1, 10)]
    chunks = spark.createDataFrame(rows, chunk)
    hits = chunks.where("chunk_index = 5").withColumns({"query_id": F.lit(1), "score": F.lit(0.9), "ord": F.lit(1)})
    walk = lambda h, c, b: sorted(r.chunk_index for r in E.expand_context(h, c, force_all=True, budget=b).collect())
    assert walk(hits, chunks, 100) == walk(hits.drop("text_size"), chunks.drop("text_size"), 100) == [3, 4, 5, 6, 7]
    assert walk(hits.withColumn("text_size", F.lit(1000)), chunks, 100) == [4, 5, 6]
    assert not any(x.split("#")[0] == "text" for out in dealt(E.expand_context(hits, chunks).select("query_id", "chunk_index")) for x in out.split(","))
