"""The chain as two calls equals its stages called one by one."""

import numpy as np
from pyspark.sql import functions as F

from hitweave.operators import judge as J
from hitweave.operators import pipeline as R
from hitweave.operators import search as S
from hitweave.operators import shaping as H

WORDS = "plazo cuota pago fecha total monto steps order list requisitos curso examen reglas entrega factura".split()


def tables(spark, n=120, questions=9):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, 8))
    chunks = [
        (i, "qna" if i % 5 == 0 else "doc", f"s{i % 6}", i // 6 + 1, n // 6, " ".join(rng.choice(WORDS, 12)), v[i].tolist(), rng.choice(WORDS))
        for i in range(n)
    ]
    c = spark.createDataFrame(
        [(*r[:6], r[5], r[7] if r[1] == "qna" else None, r[6], r[3] - 1 if r[3] > 1 else None, r[3] + 1) for r in chunks],
        "key long, collection string, source_name string, chunk_index int, total_chunks int, text string, content_without_overlap string, "
        "question_text string, embedding array<double>, prev_chunk_index int, next_chunk_index int",
    )
    text = ["¿Cuántos pagos hay en total?", "steps to pay the cuota", "¿Cuáles son los requisitos del curso?", "reglas de entrega de la factura", "Sí"]
    q = [(i, text[i % 5], rng.normal(size=8).tolist()) for i in range(questions)]
    return spark.createDataFrame(q, "query_id long, query string, embedding array<double>"), c


def test_retrieve_equals_the_stages(spark):
    q, c = tables(spark)
    got = {(r.query_id, r.ord): r.key for r in R.retrieve(q, c, "key").collect()}
    s = R.settings(q).toPandas().set_index("query_id")
    assert 4 not in s.index and len({n for n, _ in got}) == 8  # a lone "Sí" is not searched
    for i, row in s.iterrows():
        one = q.where(F.col("query_id") == i).withColumn("query", F.lit(row.bm25_query))
        fused = []
        for name, fields in (("doc", S.DOC_FIELDS), ("qna", S.QNA_FIELDS)):
            part = c.where(F.col("collection") == name)
            n = int(row.fetch_n)
            search = S.ranked_fusion if row.fusion == "ranked" else S.hybrid_search
            fused += [(-h.score, name, h.key) for h in search(one, part, "key", n, float(row.alpha), fields).collect()]
        best = sorted(fused)[: int(row.fetch_n)]
        hits = spark.createDataFrame([(i, k, -s_, r + 1) for r, (s_, _, k) in enumerate(best)], "query_id long, key long, score double, ord int")
        hits = H.candidate_cut(hits.join(c.drop("embedding", "collection"), "key"))
        picked = H.source_boost(hits.drop("ord").join(H.mmr_select(hits, "key"), ["query_id", "key"]))
        assert {(h.query_id, h.ord): h.key for h in picked.collect()} == {k: x for k, x in got.items() if k[0] == i}


def test_answer_contexts(spark):
    q, c = tables(spark)
    hits = R.retrieve(q, c, "key")
    d = hits.select("query_id", "key", F.lit("ENTAILMENT").alias("label"), F.lit(9).alias("relevance"), F.substring("text", 1, 20).alias("evidence"))
    all_ = {r.query_id: r for r in R.answer_contexts(hits, q, d, c, "key").collect()}
    assert len(all_) == 9 and all_[4].refusal_reason == "no_chunks" and all_[4].context is None
    for i, r in all_.items():
        if i != 4:
            assert r.refusal_reason is None and r.kept == min(8, r.results) and 0 < r.used_chunks <= 8 and r.context.startswith("SOURCE Página ")
    # nothing judged: the best by score; all contradicted: nothing is kept
    none = {r.query_id: r for r in R.answer_contexts(hits, q, d.where("false"), c, "key").collect()}
    assert all(r.kept == min(8, r.results) and r.refusal_reason is None for i, r in none.items() if i != 4)
    no = {r.query_id: r for r in R.answer_contexts(hits, q, d.withColumn("label", F.lit("CONTRADICTION")), c, "key").collect()}
    assert all(r.refusal_reason == "llm_filter_zero_relevant" for i, r in no.items() if i != 4)


def test_page_numbers_and_batches(spark):
    from hitweave.operators.context import build_context, context_pages

    rows = [(1, 1, "a", 4, 17, "eins"), (1, 2, "b", 2, None, "zwei")]
    df = spark.createDataFrame(rows, "query_id long, ord int, source_name string, chunk_index int, page_number int, text string")
    pages = context_pages(build_context(df.withColumn("content_without_overlap", F.col("text")))).collect()
    assert {r.page_key: r.llm_text for r in pages} == {"Página 17": "eins", "Página 2": "zwei"}
    many = spark.range(90).select(F.lit(1).alias("query_id"), (F.col("id") + 1).alias("ord"), F.lit("t").alias("text"), F.lit("q").alias("query"))
    assert J.judge_batches(many).count() == 90 and J.judge_batches(many, max_batches=3).count() == 75
    assert {r["rank"] for r in J.passthrough(many).collect()} == set(range(1, 9))
