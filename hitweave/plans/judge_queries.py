"""Judging and selection over the hit lists of all queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.functions import text as X
from hitweave.operators import judge as J
from hitweave.operators import shaping as H
from hitweave.operators.shaping import with_features
from hitweave.plans.registry import query
from hitweave.plans.sqltext import BULLET, CODE, NUMBERED, nai
from hitweave.plans.tables import HITS_SQL, attach, corpus, hits, lists, queries, read
from hitweave.session import write_table

# decisions follow from the ids; every label, reason and relevance occurs
LABEL = "CASE (query_id * 7 + vec_id * 3) % 4 WHEN 1 THEN 'NEUTRAL' WHEN 3 THEN 'CONTRADICTION' ELSE 'ENTAILMENT' END"
RELEVANCE = "CAST((query_id + vec_id * 5) % 11 AS INT)"
EVIDENCE = """CASE (query_id + vec_id) % 6 WHEN 0 THEN '' WHEN 1 THEN 'nothing of the kind' WHEN 2 THEN query
   ELSE substring(text, 3, 60) END"""
# list-like chunks, and scores spread over the trust threshold
LISTY = r"CASE WHEN vec_id % 3 = 0 THEN replace(text, '. ', E'\n- ') ELSE text END"
SPREAD = "round(score * 0.5 + (vec_id % 5) * 0.12, 9)"

JUDGED_SQL = f"""{HITS_SQL},
    judged AS (SELECT h.* EXCLUDE (text, score), {LISTY} AS text, {SPREAD} AS score, ord - 1 AS abs_id, query,
                 {LABEL} AS raw_label, {RELEVANCE} AS relevance, {EVIDENCE.replace("text", "h.text")} AS evidence
               FROM hits h JOIN queries USING (query_id)),
    normed AS (SELECT *, {nai("text")} AS nt, {nai("evidence")} AS ne, {nai("query")} AS nq FROM judged),
    reasoned AS (SELECT *, CASE WHEN raw_label <> 'ENTAILMENT' THEN NULL WHEN trim(evidence) = '' THEN 'no_evidence'
        WHEN NOT contains(nt, ne) THEN 'evidence_mismatch'
        WHEN contains(evidence, '?') OR (ne <> '' AND contains(nq, ne)) THEN 'evidence_is_question'
        WHEN relevance < 7 THEN 'low_relevance' END AS downgrade_reason FROM normed),
    gated AS (SELECT *, CASE WHEN downgrade_reason IS NOT NULL THEN 'NEUTRAL' ELSE raw_label END AS label FROM reasoned)"""


def listy(c):
    """List-like text in place of the original, which the evidence is quoted from."""
    listed = F.when(F.col("vec_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit("\n- "))).otherwise(F.col("text"))
    return with_features(c.withColumn("original", F.col("text")).withColumn("text", listed))


def asked(spark, sd, top=None):
    """Hit lists with the text of their query."""
    top = lists(spark, sd) if top is None else top
    return top.join(queries(spark, sd).select("query_id", "query"), "query_id")


def judged(spark, sd, top=None):
    h = hits(spark, sd, prepare=listy, top=asked(spark, sd, top)).withColumn("abs_id", F.col("ord") - 1)
    evidence = F.expr(EVIDENCE.replace("text", "original"))
    h = h.withColumns(
        {"label": F.expr(LABEL), "relevance": F.expr(RELEVANCE), "evidence": evidence, "score": F.expr(SPREAD)}
    )
    return h.drop("original", "word_set")


def gated(spark, sd, top=None):
    return J.evidence_gate(judged(spark, sd, top))


@query(
    "judge_batches",
    f"""WITH {HITS_SQL},
    t AS (SELECT query_id, query, list_slice(list_filter(string_split({nai("query")}, ' '), lambda t: length(t) >= 4), 1, 8) AS toks FROM queries),
    n AS (SELECT vec_id, {nai("text")} AS norm FROM corpus),
    p AS (SELECT h.*, norm, list_min(list_filter(list_transform(toks, lambda t: strpos(norm, t)), lambda p: p > 0)) AS f
          FROM hits h JOIN t USING (query_id) JOIN n USING (vec_id))
    SELECT query_id, vec_id, ord - 1 AS abs_id, (ord - 1) // 25 AS batch_no, CASE WHEN length(text) <= 600 THEN text
      ELSE substring(text, coalesce(greatest(0, floor((f - 1) * (length(text) / greatest(1, length(norm))::DOUBLE)) - 120), 0)::INT + 1, 600)
      END AS excerpt FROM p""",
)
def _batches(spark, sd):
    # words of queries and normal forms of chunks are taken before the lists spread them
    q = queries(spark, sd).select("query_id", X.excerpt_tokens("query").alias("query_tokens"))
    h = hits(spark, sd, prepare=J.with_excerpt_norm, top=lists(spark, sd).join(q, "query_id"))
    return J.judge_batches(h).select("query_id", "vec_id", "abs_id", "batch_no", "excerpt")


WORD = "regexp_extract(text, '[A-Za-z]+')"
ITEMS = """'{"results": [{"id": ' || doc_id || ', "label": "entailment", "relevance": ' || (doc_id % 13) || '.5, "evidence": " ' || w || ' "},
  {"id": "' || doc_id || '", "label": "NEUTRAL", "relevance": 3}, {"id": 7, "label": "maybe", "relevance": "x"},
  {"id": 8, "label": "Neutral", "relevance": "-4", "evidence": null}]}'"""
RESPONSE = f"""CASE doc_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || {ITEMS} || chr(10) || '```'
   WHEN 1 THEN {ITEMS} WHEN 2 THEN left({ITEMS}, 60) ELSE '```' || {ITEMS} || '``` done' END"""


@query(
    "parse_decisions",
    rf"""WITH r AS (SELECT doc_id, {RESPONSE} AS response FROM (SELECT doc_id, {WORD} AS w FROM documents)),
    b AS (SELECT doc_id, CASE WHEN regexp_matches(response, '(?s)```.*?```')
            THEN trim(regexp_extract(response, '(?s)```(?:json)?\s*(.*?)```', 1), E' \n\t\r') ELSE response END AS j FROM r),
    d AS (SELECT doc_id, unnest(from_json(json_extract(j, '$.results'), '["json"]')) AS d,
            unnest(range(0, json_array_length(j, '$.results')::INT)) AS seq FROM b WHERE json_valid(j))
    SELECT doc_id, seq, CAST(d->>'id' AS DOUBLE) AS id,
      CASE upper(coalesce(d->>'label', '')) WHEN 'ENTAILMENT' THEN 'ENTAILMENT' WHEN 'NEUTRAL' THEN 'NEUTRAL' ELSE 'CONTRADICTION' END AS label,
      greatest(0, least(10, floor(coalesce(TRY_CAST(d->>'relevance' AS DOUBLE), 0) + 0.5)))::INT AS relevance,
      trim(coalesce(d->>'evidence', '')) AS evidence
    FROM d WHERE json_type(d, '$.id') <> 'VARCHAR'""",
)
def _parse(spark, sd):
    d = read(spark, sd, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w"))
    r = d.select("doc_id", F.expr(RESPONSE.replace("left(", "left(")).alias("response"))
    return J.parse_decisions(r, ["doc_id"])


def decided(spark, sd):
    """The decisions on all hits, stored without the chunks' texts: several branches read them."""
    j = judged(spark, sd).select("query_id", "vec_id", "abs_id", "score", "label", "relevance", "evidence")
    return write_table(j, "decided")


DUPES_SQL = f"""{JUDGED_SQL},
    dec AS (SELECT query_id, abs_id::DOUBLE AS id, raw_label AS label, relevance, evidence, abs_id AS seq FROM judged
      UNION ALL SELECT query_id, abs_id, CASE WHEN vec_id % 2 = 0 THEN 'ENTAILMENT' ELSE raw_label END, 5, 'again', 1000 + abs_id FROM judged WHERE vec_id % 3 = 0
      UNION ALL SELECT query_id, abs_id + 1000, raw_label, relevance, evidence, 2000 + abs_id FROM judged WHERE vec_id % 5 = 0
      UNION ALL SELECT query_id, abs_id + 0.5, raw_label, relevance, evidence, 3000 + abs_id FROM judged WHERE vec_id % 7 = 0)"""


def raw_decisions(spark, sd):
    j = decided(spark, sd).withColumn("id", F.col("abs_id").cast("double"))
    cols = ["query_id", "id", "label", "relevance", "evidence"]
    base = j.select(*cols, F.col("abs_id").alias("seq"))
    again = j.where("vec_id % 3 = 0").select(
        "query_id", "id", F.when(F.col("vec_id") % 2 == 0, "ENTAILMENT").otherwise(F.col("label")).alias("label"),
        F.lit(5).alias("relevance"), F.lit("again").alias("evidence"), (1000 + F.col("abs_id")).alias("seq"),
    )
    far = j.where("vec_id % 5 = 0").withColumn("id", F.col("id") + 1000).select(*cols, (2000 + F.col("abs_id")).alias("seq"))
    half = j.where("vec_id % 7 = 0").withColumn("id", F.col("id") + 0.5).select(*cols, (3000 + F.col("abs_id")).alias("seq"))
    return base.unionByName(again).unionByName(far).unionByName(half), j


@query(
    "dedupe_decisions",
    f"""WITH {DUPES_SQL},
    known AS (SELECT dec.* FROM dec SEMI JOIN judged j ON j.query_id = dec.query_id AND j.abs_id = dec.id)
    SELECT query_id, id::INT AS abs_id, label, relevance, seq FROM known QUALIFY row_number() OVER (PARTITION BY query_id, id
      ORDER BY CASE label WHEN 'ENTAILMENT' THEN 2 WHEN 'NEUTRAL' THEN 1 ELSE 0 END DESC, relevance DESC, seq) = 1""",
)
def _dedupe(spark, sd):
    dec, h = raw_decisions(spark, sd)
    return J.dedupe_decisions(dec, h).select("query_id", "abs_id", "label", "relevance", "seq")


@query(
    "decision_issues",
    f"""WITH {DUPES_SQL},
    n AS (SELECT query_id, id, count(*) AS n, id < 1000 AS known FROM dec WHERE id = floor(id) GROUP BY ALL)
    SELECT query_id, sum(CASE WHEN known THEN 0 ELSE n END)::BIGINT AS unknown_ids,
           sum(CASE WHEN known THEN n - 1 ELSE 0 END)::BIGINT AS duplicate_ids FROM n GROUP BY query_id""",
)
def _issues(spark, sd):
    return J.decision_issues(*raw_decisions(spark, sd))


@query(
    "coverage_fallback",
    f"""WITH {JUDGED_SQL}, c AS (SELECT *, count(*) FILTER (vec_id % 4 <= query_id % 4) OVER w / count(*) OVER w AS share
        FROM judged WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, abs_id) AS rank
    FROM c WHERE share < 0.6 QUALIFY rank <= 8""",
)
def _coverage(spark, sd):
    j = decided(spark, sd)
    h = j.drop("label", "relevance", "evidence")
    return J.coverage_fallback(J.with_coverage(h, j.where("vec_id % 4 <= query_id % 4"))).select("query_id", "vec_id", "rank")


@query("evidence_gate", f"WITH {JUDGED_SQL} SELECT query_id, abs_id, raw_label, label, downgrade_reason FROM gated")
def _gate(spark, sd):
    return gated(spark, sd).select("query_id", "abs_id", "raw_label", "label", "downgrade_reason")


@query(
    "downgrade_reasons",
    f"""WITH {JUDGED_SQL} SELECT query_id, downgrade_reason, count(*) AS n FROM gated
    WHERE downgrade_reason IS NOT NULL GROUP BY ALL""",
)
def _reasons(spark, sd):
    return J.downgrade_reasons(gated(spark, sd))


# every fourth query gets no entailment at all
STRONG_SQL = f"""{JUDGED_SQL},
    g AS (SELECT * EXCLUDE (label), CASE WHEN query_id % 4 = 0 AND label = 'ENTAILMENT' THEN 'NEUTRAL' ELSE label END AS label FROM gated
          WHERE label <> 'CONTRADICTION'),
    ent AS (SELECT DISTINCT query_id, source_name, chunk_index FROM g WHERE label = 'ENTAILMENT'),
    f AS (SELECT g.*, bool_or(label = 'ENTAILMENT') OVER w AS has_ent,
            row_number() OVER (PARTITION BY query_id ORDER BY score DESC, abs_id) AS best,
            regexp_matches(text, '(?i){"|".join(X.DIRECT_ANSWER)}')::INT AS boost,
            EXISTS (SELECT 1 FROM ent e WHERE e.query_id = g.query_id AND e.source_name = g.source_name
                    AND abs(e.chunk_index - g.chunk_index) BETWEEN 1 AND 2) AS near,
            greatest(len(regexp_extract_all(text, '(?m){BULLET}')), len(regexp_extract_all(text, '(?mi){NUMBERED}')),
                     len(list_distinct(regexp_extract_all(text, '{CODE}')))) >= 2 AS listed
          FROM g WINDOW w AS (PARTITION BY query_id)),
    t AS (SELECT *, CASE WHEN NOT has_ent THEN 0 WHEN label = 'ENTAILMENT' THEN 0 WHEN near AND listed THEN 1
                         WHEN score >= 0.8 THEN 2 WHEN best <= 3 THEN 3 END AS tier FROM f),
    selected AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier,
        CASE WHEN has_ent AND tier = 0 THEN boost ELSE 0 END DESC, CASE WHEN has_ent AND tier = 0 THEN relevance ELSE 0 END DESC,
        score DESC, abs_id) AS rank FROM t WHERE tier IS NOT NULL QUALIFY rank <= 8)"""


def selected(spark, sd, top=None):
    """What the judge keeps of the lists, without the chunks' texts."""
    none = (F.col("query_id") % 4 == 0) & (F.col("label") == "ENTAILMENT")
    g = gated(spark, sd, top).withColumn("label", F.when(none, "NEUTRAL").otherwise(F.col("label")))
    texts = ("text", "content_without_overlap", "norm_text", "query", "evidence")
    # read by two branches: gated once
    return J.rerank_select(write_table(g.drop(*texts), "gated"))


# the hits that the judge kept, in its order
PICKED_SQL = f"""{STRONG_SQL},
    picked AS (SELECT h.* REPLACE (s.rank AS ord) FROM hits h JOIN selected s ON s.query_id = h.query_id AND s.abs_id = h.ord - 1)"""


def picked(spark, sd, top, sized=False):
    """The rows of hit lists that the judge kept, ``ord`` being their rank."""
    s = selected(spark, sd, top).select("query_id", (F.col("abs_id") + 1).alias("ord"), "rank")
    rows = top.join(s, ["query_id", "ord"]).drop("ord").withColumnRenamed("rank", "ord")
    return attach(write_table(rows, "selection"), corpus(spark, sd, sized).drop("question_text"))


@query("rerank_select", f"WITH {STRONG_SQL} SELECT query_id, abs_id, label, tier, rank FROM selected")
def _rerank(spark, sd):
    return selected(spark, sd).select("query_id", "abs_id", "label", "tier", "rank")


@query(
    "selection_stats",
    f"""WITH {STRONG_SQL} SELECT query_id, count(*) AS output_count, count(*) FILTER (has_ent AND tier = 0) AS entailment_count,
      count(*) FILTER (NOT has_ent OR tier IN (1, 2)) AS neutral_kept FROM selected GROUP BY query_id""",
)
def _selection(spark, sd):
    return J.selection_stats(selected(spark, sd))


@query(
    "pipeline_stats",
    f"""WITH {PICKED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r,
             max(score) OVER (PARTITION BY query_id) AS top FROM hits),
    k AS (SELECT query_id, count(*) AS kept, count(DISTINCT source_name) AS sources FROM picked GROUP BY query_id)
    SELECT query_id, count(*) AS initial_count, count(*) FILTER (r <= 12 OR score >= top - 0.5) AS after_threshold,
      coalesce(any_value(kept), 0) AS after_rerank, coalesce(any_value(kept), 0) AS after_expansion, coalesce(any_value(sources), 0) AS sources_found
    FROM c LEFT JOIN k USING (query_id) GROUP BY query_id""",
)
def _pipeline_stats(spark, sd):
    top = lists(spark, sd)
    h = hits(spark, sd, top=top)
    c = H.candidate_cut(h, top_n=12, delta=0.5)
    kept = write_table(picked(spark, sd, top).select("query_id", "vec_id", "score", "ord", "source_name"), "picked")
    return H.pipeline_stats(h, c, kept, H.source_boost(kept))
