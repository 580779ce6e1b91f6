"""Candidate shaping over the hit lists of all queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import shaping as H
from hitweave.plans.registry import query
from hitweave.plans.tables import HITS_SQL, hits

CUT_SQL = f"""{HITS_SQL},
    cut AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS ord FROM hits
            QUALIFY ord <= 12 OR score >= max(score) OVER (PARTITION BY query_id) - 0.5)"""


def cut(spark, sd):
    # a short list and a wide delta, so that both rules decide some rows
    return H.candidate_cut(hits(spark, sd), top_n=12, delta=0.5)


@query(
    "candidate_cut",
    f"""WITH {HITS_SQL} SELECT query_id, vec_id, r AS ord FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r,
             max(score) OVER (PARTITION BY query_id) AS top FROM hits) WHERE r <= 12 OR score >= top - 0.5""",
)
def _cut(spark, sd):
    return cut(spark, sd).select("query_id", "vec_id", "ord")


@query("mmr_select")
def _mmr(spark, sd):
    return H.mmr_select(H.candidate_cut(hits(spark, sd, prepare=H.with_word_text)), "vec_id")


@query(
    "source_aggregate",
    f"""WITH {HITS_SQL} SELECT query_id, source_name, round(avg(score), 4) AS avg_score, count(*) AS match_count,
      string_agg(chunk_index::VARCHAR, ',' ORDER BY ord) AS chunks FROM hits GROUP BY query_id, source_name""",
)
def _aggregate(spark, sd):
    a = H.source_aggregate(hits(spark, sd))
    return a.select(
        "query_id", "source_name", F.round("avg_score", 4).alias("avg_score"), "match_count",
        F.array_join("chunk_indices", ",").alias("chunks"),
    )


BOOST_SQL = """
    b AS (SELECT *, round(avg(score) OVER w * (1 + least(0.2, count(*) OVER w * 0.05)), 9) AS boost FROM hits
          WINDOW w AS (PARTITION BY query_id, source_name)),
    boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boost DESC, source_name, score DESC, ord) AS pos FROM b)"""


@query("source_boost", f"WITH {HITS_SQL}, {BOOST_SQL} SELECT query_id, vec_id, pos AS ord, round(boost, 4) AS source_boost FROM boosted")
def _boost(spark, sd):
    b = H.source_boost(hits(spark, sd))
    return b.select("query_id", "vec_id", "ord", F.round("source_boost", 4).alias("source_boost"))
