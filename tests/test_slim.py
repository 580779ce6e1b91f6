"""Lists are dealt by query without their chunks' texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import expansion as E
from hitweave.operators import judge as J
from hitweave.operators import search as S
from hitweave.operators import shaping as H
from hitweave.operators.context import build_context

ROW = "query_id long, vec_id long, ord int, score double, source_name string, chunk_index int, total_chunks int, prev_chunk_index int, next_chunk_index int, text string, content_without_overlap string"


@pytest.fixture
def rows(spark):
    out = [(q, s * 100 + c, s * 6 + c, 1 - (s * 6 + c) / 20, f"s{s}", c, 6, c - 1 or None, c + 1 if c < 6 else None, f"text {s} {c} " * 40, f"bare {c}") for q in (1, 2) for s in (0, 1) for c in range(1, 7)]
    return spark.createDataFrame(out, ROW)


def dealt(df):
    """Columns of everything that the plan shuffles."""
    plan = df._jdf.queryExecution().optimizedPlan()
    physical = df._jdf.queryExecution().sparkPlan()
    assert plan is not None and physical is not None
    found = []

    def walk(node):
        if node.nodeName() in ("Window", "Join", "Aggregate", "WindowGroupLimit"):
            for i in range(node.children().size()):
                found.append(node.children().apply(i).output().mkString(","))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def without_texts(df):
    d = dealt(df)
    assert d
    return not any(x.split("#")[0] in ("text", "norm_text", "content_without_overlap") for out in d for x in out.split(","))


def test_neighbours_are_found_without_texts(rows):
    kept = rows.where("chunk_index = 3")
    out = E.local_neighbors(kept, rows, 1).select("query_id", "vec_id", "ord")
    assert without_texts(out)
    assert sorted(map(tuple, out.where("query_id = 1").collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 102, 4), (1, 103, 5), (1, 104, 6)]


def test_selection_without_texts(rows):
    label = F.when(F.col("chunk_index") == 1, "ENTAILMENT").otherwise("NEUTRAL")
    g = rows.withColumns({"label": label, "relevance": F.lit(8), "abs_id": F.col("ord") - 1})
    out = J.rerank_select(g).select("query_id", "abs_id", "tier", "rank")
    assert without_texts(out)
    assert [tuple(r) for r in out.where("query_id = 2").orderBy("rank").collect()][:2] == [(2, 0, 0, 1), (2, 6, 0, 2)]


def test_excerpts_are_cut_before_lists_are_dealt(rows):
    out = J.judge_batches(rows.withColumn("query", F.lit("text"))).select("query_id", "abs_id", "excerpt")
    assert without_texts(out)
    assert out.agg(F.max(F.length("excerpt"))).first()[0] <= 600


def test_excerpts_from_normal_forms_made_once(spark, rows):
    from hitweave.functions.text import excerpt_tokens

    c = rows.select("query_id", "ord", F.concat(F.repeat(F.lit("Ácido — "), F.lit(200)), F.lit("sílaba número "), "text").alias("text"))
    c = c.unionByName(spark.createDataFrame([(1, 900, None), (1, 901, "corto")], "query_id long, ord int, text string"))
    q = spark.createDataFrame([(1, "¿Y el Número?"), (2, None)], "query_id long, query string")
    chunks = c.select(F.monotonically_increasing_id().alias("vec_id"), "query_id", "ord", "text")
    hits = chunks.select("vec_id", "query_id", "ord").join(q.withColumn("query_tokens", excerpt_tokens("query")), "query_id")
    out = J.judge_batches(hits.join(J.with_excerpt_norm(chunks.select("vec_id", "text")), "vec_id"))
    pick = lambda df: sorted(map(tuple, df.select("query_id", "ord", "abs_id", "excerpt").collect()), key=str)
    plain = J.judge_batches(c.join(q, "query_id"))
    assert pick(out) == pick(plain) and any("numero" in (r[3] or "").lower() or "número" in (r[3] or "") for r in pick(out))
    # before, a hit's text was folded again for each query: the accents' table stood above the join of hits and chunks
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "lower(" in plan and "lower(" not in above


def test_sections_are_cut_before_lists_are_dealt(spark, rows):
    long = rows.withColumn("text", F.repeat("text", F.lit(40)))
    item = build_context(long)
    packed = item.orderBy("query_id").collect()
    assert [len(s.llm_text) for s in packed[0].packed] and all(len(s.llm_text) <= 1000 for s in packed[0].packed)
    # two lists of 12 texts of 16,800 characters each would be above 400,000 bytes
    assert "substring" in item._jdf.queryExecution().optimizedPlan().toString()


def test_budget_is_spent_in_order_also_where_chunks_share_a_place(rows):
    kept = rows.where("chunk_index = 2 and source_name = 's0'")
    chunks = rows.where("query_id = 1").drop("query_id", "ord", "score").withColumn("collection", F.lit("doc"))
    chunks = chunks.unionByName(chunks.where("chunk_index = 3").withColumn("text", F.lit("short")))
    used = kept.select(F.length("text")).first()[0]
    out = E.ordered_expand(kept, chunks, budget=used + 10)
    assert sorted((r.query_id, r.text) for r in out.where("is_expansion").collect()) == [(1, "short"), (2, "short")]
    both = E.ordered_expand(kept, chunks, budget=3 * used)
    assert both.where("is_expansion and chunk_index = 3").count() == 4


def test_walk_attaches_texts_at_its_end(rows):
    kept = rows.where("chunk_index = 3 and source_name = 's1'")
    chunks = rows.where("query_id = 1").drop("query_id", "ord", "score").withColumn("collection", F.lit("doc"))
    out = E.expand_context(kept, chunks, force_all=True, budget=100000)
    got = sorted((r.query_id, r.chunk_index, r.is_expansion, r.text) for r in out.collect())
    assert got == [(q, c, c != 3, f"text 1 {c} " * 40) for q in (1, 2) for c in range(1, 6)]


def test_running_lists_with_ties_across_batches():
    rng = np.random.default_rng(5)
    score = rng.integers(-3, 6, (9, 400)) / 7
    score[0] = 0.0
    run = S._Running(np.arange(9), 11)
    for a in range(0, 400, 37):
        run.add(np.arange(a, min(400, a + 37)), score[:, a : a + 37])
    want = [sorted(range(400), key=lambda j: (-round(s[j], 9), j))[:11] for s in score]
    assert run.keys.tolist() == want
    few = S._Running(np.arange(9), 11, S.LEAST)
    few.add(np.arange(400), np.where(score > 0.8, score, 0.0))
    assert set(few.rows("key", 0.0)["query_id"]) == set(np.flatnonzero((score > 0.8).any(axis=1)))


def test_diversity_of_texts_without_words(spark):
    rows = spark.createDataFrame([(1, o, o * 10, 1 - o / 100, t) for o, t in enumerate(["", "same words here", "same words here", "a b", "other thing entirely"], 1)], "query_id long, ord int, vec_id long, score double, text string")
    out = H.mmr_select(rows, "vec_id", k=3)
    assert [r.vec_id for r in out.orderBy("ord").collect()] == [10, 20, 40]


def test_lanes_are_expanded_without_texts(spark, rows, monkeypatch):
    cut = E.cut_lineage
    seen = []
    monkeypatch.setattr(E, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    text = F.when(F.col("query_id") == 1, F.concat(F.lit("- one\n- two\n"), F.substring("text", 1, 90))).otherwise(F.col("text"))
    hits = rows.withColumn("text", text)
    plain = rows.where("query_id = 1").select("source_name", "chunk_index", "total_chunks", "prev_chunk_index", "next_chunk_index", "text", "content_without_overlap")
    chunks = plain.withColumn("collection", F.lit("doc"))
    kept = hits.where("chunk_index = 2 AND source_name = 's0'")
    told = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, entailment_count long")
    out, lanes = E.expansion_lane(hits.where("chunk_index < 4 AND source_name = 's0'"), kept, chunks, told)
    assert {tuple(r) for r in lanes.collect()} == {(1, "list"), (2, "none")}
    got = out.where("query_id = 1").orderBy("ord").collect()
    assert [r.chunk_index for r in got] == [1, 2, 3, 4, 5] and [r.is_expansion for r in got] == [False, False, False, True, True]
    assert [r.text.startswith("- one") for r in got] == [True, True, True, False, False] and got[4].text == "text 0 5 " * 40
    assert [r.content_without_overlap for r in got] == [f"bare {i}" for i in range(1, 6)]
    assert [(r.chunk_index, r.text) for r in out.where("query_id = 2").collect()] == [(2, "text 0 2 " * 40)]
    assert seen and not any("text" in c or "content_without_overlap" in c for c in seen)  # before, two of the tables held all texts
