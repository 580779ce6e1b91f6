import numpy as np
from pyspark.sql import functions as F

from hitweave.operators import question as Q
from hitweave.operators import search as S
from hitweave.operators import shaping as H


def vectors(n, d, seed):
    return np.random.default_rng(seed).normal(size=(n, d))


def test_vector_topk_in_any_number_of_blocks(spark):
    q, c = vectors(7, 8, 1), vectors(300, 8, 2)
    c[10] = c[20]  # a tie
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    cd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "key long, embedding array<double>")
    cos = np.maximum(0, (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T).round(9)
    want = {(i, k, r + 1) for i in range(7) for r, k in enumerate(sorted(range(300), key=lambda j: (-cos[i, j], j))[:12])}
    for limit, tile in ((1 << 20, S.TILE), (600, S.TILE), (1 << 20, 100)):
        S.TILE, old = tile, S.TILE
        got = S.vector_topk(qd, cd, "key", 12, limit_bytes=limit).collect()
        S.TILE = old
        assert {(r["query_id"], r["key"], r["ord"]) for r in got} == want
    some = qd.withColumn("k", F.col("query_id") % 3 + 1)
    got = S.vector_topk(some, cd, "key", "k").collect()
    assert {(r["query_id"], r["key"], r["ord"]) for r in got} == {w for w in want if w[2] <= w[0] % 3 + 1}


def test_vectors_that_are_missing_or_of_another_length(spark):
    import pytest

    cd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "key long, embedding array<double>")
    qd = spark.createDataFrame([(7, None), (8, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.key) for r in S.vector_topk(qd, cd, "key", 5).collect()] == [(8, 1)]
    long = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "key long, embedding array<double>")
    with pytest.raises(Exception, match="vectors of 2 numbers expected"):
        S.vector_topk(qd, long, "key", 5).collect()


def X(text):
    return text.lower().replace("é", "e").split()


def test_bm25_in_any_number_of_blocks(spark):
    words = "alpha beta gamma delta épsilon the the the of of".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(200)]
    c = spark.createDataFrame(rows, "key long, text string").withColumn("content_without_overlap", F.substring("text", 5, 1000))
    q = spark.createDataFrame([(1, "Alpha the"), (2, "epsilon of unknown"), (3, "zzz"), (4, "")], "query_id long, query string")
    a = S.bm25_topk(q, c, "key", S.DOC_FIELDS, 15)
    b = S.bm25_topk(q, c, "key", S.DOC_FIELDS, 15, limit_bytes=2500)
    pick = lambda df: sorted((r["query_id"], r["ord"], r["key"], round(r["score"], 6)) for r in df.collect())
    assert pick(a) == pick(b)
    assert {r[0] for r in pick(a)} == {1, 2}
    # by the definition
    split = {k: [X(t[4:]), X(t)] for k, t in rows}
    weights, n = list(S.DOC_FIELDS.values()), len(rows)
    mean = [sum(len(f[i]) for f in split.values()) / n for i in (0, 1)]
    want = []
    for i, text in ((1, "alpha the"), (2, "epsilon of unknown")):
        scored = []
        for k, f in split.items():
            total = 0.0
            for t in set(text.split()):
                df = sum(t in g[0] + g[1] for g in split.values())
                w = sum(weights[j] * f[j].count(t) / (1 - 0.75 + 0.75 * len(f[j]) / mean[j]) for j in (0, 1))
                total += np.log(1 + (n - df + 0.5) / (df + 0.5)) * w * 2.2 / (w + 1.2)
            if total > 0:
                scored.append((-round(total, 9), k))
        want += [(i, r + 1, k, round(-s, 6)) for r, (s, k) in enumerate(sorted(scored)[:15])]
    assert pick(a) == sorted(want)


def ranked(spark, scores, texts=None):
    rows = [(1, i + 1, s, f"s{i % 3}", i, (texts or ["t"] * len(scores))[i]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id long, ord int, score double, source_name string, key long, text string")


def test_candidate_cut(spark):
    for n in (29, 30, 31):
        assert H.candidate_cut(ranked(spark, [1 - i / 100 for i in range(n)])).count() == min(n, 30)
    flat = [1.0] * 25 + [0.93] * 10 + [0.92] * 1 + [0.91] * 4
    assert H.candidate_cut(ranked(spark, flat)).count() == 36


def mmr_rule(scores, texts, k, lam):
    sets = [{w for w in t.lower().split() if len(w) > 2} for t in texts]
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    left, out = list(range(len(scores))), []
    while left and len(out) < k:
        best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * max([sim(sets[i], sets[j]) for j in out], default=0.0), -i))
        out.append(best)
        left.remove(best)
    return out


def test_mmr(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(12)]
    scores = sorted(rng.random(25).round(3).tolist(), reverse=True)
    texts = [" ".join(rng.choice(words, rng.integers(0, 8))) for _ in scores]
    got = H.mmr_select(ranked(spark, scores, texts), "key").orderBy("ord").collect()
    assert [r["key"] for r in got] == mmr_rule(scores, texts, 15, 0.6)
    short = H.mmr_select(ranked(spark, scores[:15], texts[:15]), "key").orderBy("ord").collect()
    assert [r["key"] for r in short] == list(range(15))


def test_source_boost_saturates(spark):
    rows = [(1, i + 1, 0.5, "many", i) for i in range(6)] + [(1, 7, 0.55, "one", 9)]
    df = spark.createDataFrame(rows, "query_id long, ord int, score double, source_name string, key long")
    got = H.source_boost(df).orderBy("ord").collect()
    assert got[0]["source_name"] == "many" and abs(got[0]["source_boost"] - 0.6) < 1e-9
    assert abs(got[-1]["source_boost"] - 0.55 * 1.05) < 1e-9


def test_classify(spark):
    rows = [("¿Cuántos días de plazo hay?", "numeric"), ("steps to apply before", "ordered"), ("¿Cuáles son los requisitos?", "list"), ("política de reembolso general amplia", Q.GENERAL), ("how many steps to", "ordered")]
    df = spark.createDataFrame(rows, "query string, want string")
    out = Q.hybrid_alpha(Q.classify_query(df)).collect()
    assert all(r["question_type"] == r["want"] for r in out)
    assert {r["query"]: r["alpha"] for r in out}["política de reembolso general amplia"] == 0.75


def test_prepare(spark):
    df = spark.createDataFrame([("Sí", "¿Cuál es la cuota anual?"), ("Sí", None), ("What is the price list", None)], "query string, previous_question string")
    a, b, c = Q.prepare_query(df).collect()
    assert a["do_search"] and a["bm25_query"] == "¿Cuál es la cuota anual?"
    assert not b["do_search"]
    assert c["bm25_query"] == "is price list"
