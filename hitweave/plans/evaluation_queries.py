"""Evaluation over all example queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import evaluation as V
from hitweave.operators import expansion as E
from hitweave.plans.context_queries import BUDGET, ORDERED_SQL
from hitweave.plans.judge_queries import PICKED_SQL, picked
from hitweave.plans.registry import query
from hitweave.plans.tables import HITS_SQL, corpus, hits, lists, queries, read
from hitweave.session import write_table

# the source after that of the query's own vector is expected; every twelfth case must be refused, and some cases,
# with negative ids, have no results
CASES_SQL = f"""{HITS_SQL},
    cases AS (SELECT query_id, CASE WHEN vec_id % 12 = 0 THEN [] ELSE ['SRC-' || (label + 1) % 10, 'other'] END AS source_matches,
                     vec_id % 12 = 0 AS should_refuse
              FROM (SELECT vec_id AS query_id, vec_id, label FROM embeddings UNION ALL
                    SELECT -1 - vec_id, vec_id, label FROM embeddings WHERE vec_id % 10 = 3 OR vec_id % 60 = 0)),
    ranked15 AS (SELECT query_id, ord, source_name, CASE WHEN query_id % 24 = 0 THEN score * 0.3 ELSE score END AS score, text FROM hits
                 WHERE ord <= 15),
    per AS (SELECT c.query_id, any_value(should_refuse) AS should_refuse, any_value(len(source_matches)) AS n, count(source_name) AS total_chunks,
              min(ord) FILTER (len(list_filter(source_matches, lambda m: contains(lower(source_name), lower(m)))) > 0) AS f, arg_min(score, ord) AS top
            FROM cases c LEFT JOIN ranked15 USING (query_id) GROUP BY c.query_id),
    ev AS (SELECT query_id, should_refuse, total_chunks, coalesce(CASE WHEN n = 0 THEN total_chunks = 0 OR top < 0.4 ELSE f IS NOT NULL END, false) AS hit,
             CASE WHEN n > 0 AND f IS NOT NULL THEN 1.0 / f ELSE 0 END::DOUBLE AS mrr, coalesce(f, 0) AS rank,
             CASE WHEN should_refuse THEN coalesce(total_chunks = 0 OR top < 0.4, false) ELSE f IS NOT NULL END AS success FROM per),
    judged AS (SELECT *, query_id % 9 = 4 OR query_id % 36 = 0 AS refused FROM ev),
    outcomes AS (SELECT *, CASE WHEN should_refuse THEN CASE WHEN NOT refused AND total_chunks > 0 THEN 'FAIL_HALLUCINATION' ELSE 'PASS' END
        WHEN NOT hit THEN 'FAIL_RETRIEVAL' WHEN refused THEN 'FAIL_FALSE_NEGATIVE' ELSE 'PASS' END AS outcome FROM judged)"""


def cases(spark, sd):
    i = F.col("vec_id")
    e = read(spark, sd, "embeddings").withColumn("query_id", i)
    e = e.unionByName(e.where((i % 10 == 3) | (i % 60 == 0)).withColumn("query_id", -1 - i))
    none = F.expr("cast(array() as array<string>)")
    expected = F.array(F.concat(F.lit("SRC-"), (F.col("label") + 1) % 10), F.lit("other"))
    return e.select(
        "query_id",
        F.when(i % 12 == 0, none).otherwise(expected).alias("source_matches"),
        (i % 12 == 0).alias("should_refuse"),
    )


def ranked(spark, sd):
    h = hits(spark, sd).where("ord <= 15")
    return h.withColumn("score", F.when(F.col("query_id") % 24 == 0, F.col("score") * 0.3).otherwise(F.col("score")))


def evaluated(spark, sd):
    return V.eval_retrieval(cases(spark, sd), ranked(spark, sd))


def outcomes(spark, sd):
    i = F.col("query_id")
    return V.eval_outcome(evaluated(spark, sd).withColumn("refused", (i % 9 == 4) | (i % 36 == 0)))


@query("eval_hit", f"WITH {CASES_SQL} SELECT query_id, hit, success, total_chunks FROM ev")
def _hit(spark, sd):
    return evaluated(spark, sd).select("query_id", "hit", "success", "total_chunks")


@query("eval_mrr", f"WITH {CASES_SQL} SELECT query_id, round(mrr, 4) AS mrr, rank FROM ev")
def _mrr(spark, sd):
    return evaluated(spark, sd).select("query_id", F.round("mrr", 4).alias("mrr"), "rank")


@query(
    "eval_report",
    f"""WITH {CASES_SQL} SELECT count(*) AS total, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed,
      round(avg(success::INT) * 100, 2) AS accuracy, round(avg(900 + query_id % 97 * 13), 2) AS avg_latency_ms, round(avg(mrr), 4) AS avg_mrr FROM ev""",
)
def _report(spark, sd):
    return V.eval_report(evaluated(spark, sd).withColumn("latency_ms", 900 + F.col("query_id") % 97 * 13))


@query(
    "eval_context",
    rf"""WITH {CASES_SQL}
    SELECT query_id, string_agg('SOURCE: ' || source_name || E'\nTEXT: ' || CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || '... (truncated)' ELSE text END,
      E'\n\n---\n\n' ORDER BY ord) AS context FROM ranked15 WHERE ord <= 10 GROUP BY query_id""",
)
def _context(spark, sd):
    return V.eval_context(ranked(spark, sd))


@query("eval_outcome", f"WITH {CASES_SQL} SELECT query_id, outcome FROM outcomes")
def _outcome(spark, sd):
    return outcomes(spark, sd).select("query_id", "outcome")


KEYWORDS = "['the', 'De la', 'zzz', left(source, 4)]"


@query(
    "eval_keywords",
    f"""SELECT doc_id, array_to_string(list_filter({KEYWORDS}, lambda k: contains(lower(text), lower(k))), ',') AS present,
      array_to_string(list_filter({KEYWORDS}, lambda k: NOT contains(lower(text), lower(k))), ',') AS missing FROM documents""",
)
def _keywords(spark, sd):
    d = read(spark, sd, "documents").select("doc_id", F.col("text").alias("answer"), "source")
    d = d.withColumn("keywords", F.array(F.lit("the"), F.lit("De la"), F.lit("zzz"), F.left("source", F.lit(4))))
    k = V.eval_keywords(d)
    return k.select(
        "doc_id", F.array_join("keywords_present", ",").alias("present"), F.array_join("keywords_missing", ",").alias("missing")
    )


MARKED = "replace(replace(text, '. ', '. [Fuente: x] '), chr(10), chr(10) || 'Fuente: y ')"


@query(
    "eval_citations",
    f"""SELECT doc_id, len(regexp_extract_all(t, '\\[Fuente:')) + len(regexp_extract_all(t, 'Fuente:')) AS citations
    FROM (SELECT doc_id, {MARKED} AS t FROM documents)""",
)
def _citations(spark, sd):
    d = read(spark, sd, "documents").select("doc_id", F.expr(MARKED).alias("t"))
    return d.select("doc_id", V.eval_citations("t").alias("citations"))


@query(
    "eval_rates",
    f"""WITH {CASES_SQL} SELECT count(*) AS total, round(avg(hit::INT) * 100, 2) AS hit_rate,
      round(coalesce(avg((outcome = 'FAIL_HALLUCINATION')::INT) FILTER (should_refuse), 0) * 100, 2) AS hallucination_rate,
      round(coalesce(avg((outcome = 'FAIL_FALSE_NEGATIVE')::INT) FILTER (NOT should_refuse), 0) * 100, 2) AS false_negative_rate,
      round(avg((outcome = 'PASS')::INT) * 100, 2) AS success_rate FROM outcomes""",
)
def _rates(spark, sd):
    return V.eval_rates(outcomes(spark, sd))


@query("eval_percentile", "SELECT event_type, quantile_disc(value, 0.95) AS percentile FROM events GROUP BY event_type")
def _percentile(spark, sd):
    return V.eval_percentile(read(spark, sd, "events"), "event_type", "value", 0.95)


@query(
    "trace_summary",
    f"""WITH {PICKED_SQL}, {ORDERED_SQL},
    r AS (SELECT query_id, count(*) AS hits, count(DISTINCT source_name) AS sources FROM hits GROUP BY query_id),
    k AS (SELECT query_id, count(*) AS filter_out FROM picked GROUP BY query_id),
    e AS (SELECT query_id, count(*) FILTER (is_expansion) AS added, count(*) FILTER (NOT is_expansion) AS retrieved, sum(length(text)) AS used,
            count(*) FILTER (ord <= 5) AS chunks, string_agg(left(text, 900), '' ORDER BY ord) FILTER (ord <= 5) AS context FROM expanded GROUP BY query_id),
    l AS (SELECT user_id AS query_id, round(sum(value), 2) AS latency FROM events GROUP BY user_id)
    SELECT query_id, hits, sources, hits AS filter_in, coalesce(filter_out, 0) AS filter_out, coalesce(added, 0) AS added,
      coalesce(used, 0) || '/{BUDGET}' AS budget, coalesce(chunks, 0) AS chunks, coalesce(ceil(length(context) / 4.0)::BIGINT, 0) AS tokens,
      coalesce(chunks, 0) - least(coalesce(chunks, 0), coalesce(retrieved, 0)) AS expanded_in_context,
      CASE WHEN query_id % 8 = 0 THEN 'refused' ELSE 'ok' END AS status, latency
    FROM r LEFT JOIN k USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN l USING (query_id)""",
)
def _trace(spark, sd):
    top = lists(spark, sd)
    h = hits(spark, sd, top=top)
    kept = write_table(picked(spark, sd, top), "picked")
    spread_ = write_table(E.ordered_expand(kept, corpus(spark, sd), budget=BUDGET), "expanded")
    texts = F.array_sort(F.collect_list(F.struct("ord", F.left("text", F.lit(900)).alias("t"))))
    contexts = spread_.where("ord <= 5").groupBy("query_id").agg(
        F.count("*").alias("used_chunks"), F.array_join(F.transform(texts, lambda x: x["t"]), "").alias("context")
    )
    refusals = queries(spark, sd).select("query_id", F.when(F.col("query_id") % 8 == 0, "no_chunks").alias("refusal_reason"))
    latencies = read(spark, sd, "events").select(F.col("user_id").alias("query_id"), F.col("value").alias("ms"))
    return V.trace_summary(h, kept, spread_, contexts, refusals, BUDGET, latencies)


@query("trace_top", f"WITH {HITS_SQL} SELECT query_id, source_name, chunk_index, round(score, 4) AS score, ord AS pos FROM hits WHERE ord <= 5")
def _top(spark, sd):
    t = V.trace_top(hits(spark, sd))
    return t.select("query_id", "source_name", "chunk_index", F.round("score", 4).alias("score"), "pos")


