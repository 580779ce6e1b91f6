from pyspark.sql import functions as F

from hitweave.operators import citations as C
from hitweave.operators import context as K
from hitweave.operators import expansion as E
from hitweave.operators import judge as J

GATED = "query_id long, abs_id int, source_name string, chunk_index int, text string, score double, label string, relevance int"


def test_parse_decisions(spark):
    rows = [
        (1, '```json\n{"results":[{"id":0,"label":"entailment","relevance":7.5,"evidence":" x "}]}\n```'),
        (2, '{"results":[{"id":"3","label":"NEUTRAL"},{"id":4,"label":"?","relevance":99}]}'),
        (3, '{"results":[{"id":1,"label":"NEUTRAL"'),
        (4, "none"),
        (5, '{"other": 1}'),
    ]
    got = J.parse_decisions(spark.createDataFrame(rows, "query_id long, response string"), ["query_id"]).collect()
    assert {(r["query_id"], r["id"], r["label"], r["relevance"], r["evidence"]) for r in got} == {
        (1, 0.0, "ENTAILMENT", 8, "x"),
        (2, 4.0, "CONTRADICTION", 10, ""),
    }


def test_gate_reasons(spark):
    text = "La cuota anual es de cien pesos"
    rows = [
        (0, "ENTAILMENT", 9, "CUOTA anual", None),
        (1, "ENTAILMENT", 9, "", "no_evidence"),
        (2, "ENTAILMENT", 9, "otra cosa", "evidence_mismatch"),
        (3, "ENTAILMENT", 9, "la cuota", "evidence_is_question"),
        (4, "ENTAILMENT", 6, "cien pesos", "low_relevance"),
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, i, text, "¿Cuál es la cuota?", l, r, e, w) for i, l, r, e, w in rows],
                               "query_id long, abs_id int, text string, query string, label string, relevance int, evidence string, want string")
    for r in J.evidence_gate(df).collect():
        assert r["downgrade_reason"] == r["want"], r
        assert r["label"] == ("ENTAILMENT" if r["abs_id"] == 0 else "NEUTRAL")


def test_rerank_tiers(spark):
    lst = "- uno\n- dos\n- tres"
    rows = [
        (1, 0, "a", 5, "x", 0.50, "ENTAILMENT", 8),
        (1, 1, "a", 9, "los requisitos son", 0.10, "ENTAILMENT", 7),
        (1, 2, "a", 6, lst, 0.20, "NEUTRAL", 0),
        (1, 3, "b", 6, lst, 0.30, "NEUTRAL", 0),
        (1, 4, "b", 1, "x", 0.85, "NEUTRAL", 0),
        (1, 5, "b", 2, "x", 0.70, "CONTRADICTION", 9),
        (1, 6, "b", 3, "x", 0.60, "NEUTRAL", 0),
    ]
    rows += [(2, i, "a", i, "x", i / 20, "NEUTRAL", 0) for i in range(10)]
    got = J.rerank_select(spark.createDataFrame(rows, GATED)).orderBy("query_id", "rank").collect()
    first = [r["abs_id"] for r in got if r["query_id"] == 1]
    # entailments (direct answer first), list part, trusted score, then the best three by score
    assert first == [1, 0, 2, 4, 6]
    assert [r["abs_id"] for r in got if r["query_id"] == 2] == [9, 8, 7, 6, 5, 4, 3, 2]
    stats = {r["query_id"]: r for r in J.selection_stats(J.rerank_select(spark.createDataFrame(rows, GATED))).collect()}
    assert (stats[1]["entailment_count"], stats[1]["neutral_kept"], stats[2]["entailment_count"], stats[2]["neutral_kept"]) == (2, 2, 0, 8)


def chunk_table(spark, n=12, size=1500):
    rows = [("doc", "s", i, n, i - 1 if i > 1 else None, i + 1 if i < n else None, f"{i:02d}" + "x" * (size - 2), "bare") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "collection string, source_name string, chunk_index int, total_chunks int, prev_chunk_index int, next_chunk_index int, text string, content_without_overlap string")


def hits_at(spark, chunks, at):
    sel = spark.createDataFrame([(1, i + 1, s, float(sc)) for i, (s, sc) in enumerate(at)], "query_id long, ord int, chunk_index int, score double")
    return chunks.drop("collection").join(sel, "chunk_index")


def indexes(df):
    return [r["chunk_index"] for r in df.orderBy("ord").collect()]


def test_ordered_expand(spark):
    c = chunk_table(spark, size=100)
    assert indexes(E.ordered_expand(hits_at(spark, c, [(9, 1)]), c)) == [9, 10, 11]
    assert indexes(E.ordered_expand(hits_at(spark, c, [(9, 1)]), c, inclusive_last=True)) == [9, 10, 11, 12]
    assert indexes(E.ordered_expand(hits_at(spark, c, [(2, 1)]), c, budget=350)) == [2, 3, 4]


def test_expand_context(spark):
    c = chunk_table(spark, size=100)
    h = hits_at(spark, c, [(6, 1.0), (1, 0.2)])
    assert indexes(E.expand_context(h, c)) == [1, 4, 5, 6, 7, 8]
    assert indexes(E.expand_context(h, c, force_all=True)) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert indexes(E.expand_context(h, c, budget=350)) == [1, 5, 6, 7]


def test_local_neighbors(spark):
    c = chunk_table(spark, size=10)
    cands = hits_at(spark, c, [(3, 1), (5, 0.9), (9, 0.8), (8, 0.7)])
    assert indexes(E.local_neighbors(cands.where("ord = 1"), cands)) == [3, 5]
    assert indexes(E.local_neighbors(cands.where("ord = 3"), cands, 1)) == [8, 9]


def context_rule(rows, p=K.CONTEXT):
    out, chars, counts, prev = [], 0, {}, None
    several = len({r[1] for r in rows}) > 1
    for i, (_, src, idx, text, bare) in enumerate(rows):
        if len(out) >= p.max_chunks:
            break
        if several and counts.get(src, 0) >= p.max_per_source and len(rows) - i > (p.max_chunks - len(out)) * 2:
            continue
        body = (bare if prev == (src, idx - 1) and bare else text)[: p.max_chunk_chars]
        part = ("\n\n---\n\n" if out else "") + f"SOURCE Página {idx}\n{body}"
        if chars + len(part) > p.max_chars:
            break
        out.append(part)
        chars += len(part)
        counts[src] = counts.get(src, 0) + 1
        prev = (src, idx)
    return "".join(out).strip(), len(out), chars


def test_build_context(spark):
    lists = {
        1: [(1, "a", i, "t" * 100, "b" * 50) for i in range(1, 30)],
        2: [(2, "a" if i < 12 else f"z{i}", i * 2, "t" * (40 + i), "b") for i in range(30)],
        3: [(3, "a", 1, "t" * 1500, None), (3, "a", 2, "u" * 1500, "v" * 1400)],
        4: [(4, f"s{i}", 3, "w" * 990, None) for i in range(9)],
    }
    rows = [(q, n + 1, s, i, t, b) for q, l in lists.items() for n, (_, s, i, t, b) in enumerate(l)]
    df = spark.createDataFrame(rows, "query_id long, ord int, source_name string, chunk_index int, text string, content_without_overlap string")
    built = K.build_context(df)
    for r in built.collect():
        assert (r["context"], r["used_chunks"], r["total_chars"]) == context_rule(lists[r["query_id"]]), r["query_id"]
        assert r["total_chars"] <= 5000
    pages = {(r["query_id"], r["page_key"]): r["llm_text"] for r in K.context_pages(built).collect()}
    assert pages[(4, "Página 3")] == "\n".join(["w" * 990] * 4)


def col(spark, fn, *v):
    df = spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


PAGE = "El Artículo 3.2 dice que la cuota anual de cada socio es de cien pesos y se paga en enero de cada año sin falta alguna"


def test_quote_exists(spark):
    for quote, want in [("artículo 3.2 dice", True), ("articulo 3.2, dice", True), ("artículo 32 dice", False), ("Artículo … cuota anual...enero", True), ("enero ... cuota", False), ("", False)]:
        assert col(spark, C.quote_exists, quote, PAGE) is want, quote


def test_fix_quote_length(spark):
    assert col(spark, C.fix_quote_length, "cuota anual", PAGE) == "cuota anual de cada"
    assert col(spark, C.fix_quote_length, " ".join(PAGE.split()[:20]), PAGE) == " ".join(PAGE.split()[:15])
    assert col(spark, C.fix_quote_length, "no está", PAGE) is None
    assert col(spark, C.fix_quote_length, "uno dos", "uno dos") is None


def span_rule(hint, text, lo=6, hi=12):
    w, h = text.split(), set(hint.lower().split())
    best = (-1, 0, lo)
    for i in range(len(w) - lo + 1):
        for n in range(lo, min(hi, len(w) - i) + 1):
            s = sum(x.lower() in h for x in w[i : i + n])
            if s > best[0]:
                best = (s, i, n)
    return " ".join(w[best[1] : best[1] + best[2]]) if len(w) >= lo else None


def test_best_span(spark):
    plain = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince"
    for hint in ("nueve trece", "zzz", "uno quince", "dos tres catorce quince once"):
        assert col(spark, C.best_span, hint, plain) == span_rule(hint, plain)
    assert col(spark, C.best_span, "uno", "uno dos") is None


def test_validate_and_repair(spark):
    answer = (
        "Texto\nFuente:\n- Página 9 — \"vieja cita\"\nmás\nfuente:\n- Página 1 — \"la cuota anual de cada socio\"\n"
        "- pagina 1 - \"repetida\"\n- Página 2 — \"cuota anual\"\n- Página 3 — \"nada que ver\"\n- Página 4 — \"palabras que no están aquí\""
    )
    a = spark.createDataFrame([(1, answer), (2, "No especificado en los documentos proporcionados."), (3, "Solo texto")], "query_id long, answer string")
    fixed = a.withColumn("answer", C.one_bullet_per_page("answer"))
    cites = C.parse_citations(fixed, ["query_id"])
    assert [r["quote"] for r in cites.orderBy("pos").collect()] == ["la cuota anual de cada socio", "cuota anual", "nada que ver", "palabras que no están aquí"]
    pages = spark.createDataFrame([(1, f"Página {n}", t) for n, t in ((1, PAGE), (2, PAGE), (3, "muy corto"), (5, "x"))], "query_id long, page_key string, llm_text string")
    got = C.validate_citations(cites, pages)
    assert {r["source_key"]: r["status"] for r in got.collect()} == {
        "Página 1": "exact", "Página 2": "length_fixed", "Página 3": "too_short", "Página 4": "unknown_page",
    }
    flags = {r["query_id"]: r["needs_repair"] for r in C.repair_flag(fixed, got).collect()}
    assert flags == {1: False, 2: False, 3: True}


def test_percentile_is_exact_in_any_distribution(spark):
    import math
    import random

    from hitweave.operators.evaluation import eval_percentile

    r = random.Random(2)
    groups = {
        "tied": [1.0] * 5000 + [2.0] * 10,
        "narrow": [r.random() * 1e-6 for _ in range(3000)],
        "wide": [r.random() ** 9 * 1e9 for _ in range(3001)],
        "one": [5.0],
        "few": [3.0, 1.0, 2.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {x.g: x.percentile for x in eval_percentile(df, "g", "v", p).collect()}
        assert got == {g: sorted(vs)[max(1, math.ceil(len(vs) * p)) - 1] for g, vs in groups.items()}
