"""The chain from questions to packed contexts as two calls, around the model that judges the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators import context as K
from hitweave.operators import judge as J
from hitweave.operators import question as Q
from hitweave.operators import search as S
from hitweave.operators import shaping as H
from hitweave.operators.expansion import expansion_lane
from hitweave.session import write_table


def settings(questions: DataFrame) -> DataFrame:
    """``query_id, query, embedding`` (and ``previous_question``) -> the search settings of each question that is searched."""
    if "previous_question" not in questions.columns:
        questions = questions.withColumn("previous_question", F.lit(None).cast("string"))
    q = Q.prepare_query(questions)
    q = Q.fetch_budget(Q.hybrid_alpha(Q.classify_query(q, "embed_query"), "embed_query"))
    return q.where("do_search")


def retrieve(questions: DataFrame, chunks: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Hit lists ready to be judged: search of both collections with each question's budget, cut, diversity, source boost.

    ``chunks`` has ``key, collection, source_name, chunk_index, text, content_without_overlap, question_text, embedding``.
    The search runs once: its hits are written to the shared folder before they are shaped.
    """
    q = write_table(settings(questions), "questions")
    asked = q.select("query_id", F.col("bm25_query").alias("query"), "embedding", "alpha", "fusion", "fetch_n")
    found = write_table(S.hybrid_search_both(asked, chunks, key, "fetch_n", "alpha", "fusion"), "found")
    rest = [c for c in columns or chunks.columns if c not in ("embedding", "collection", key)]
    hits = found.join(chunks.select(key, *rest), key)
    hits = write_table(H.candidate_cut(hits), "candidates")
    picked = H.mmr_select(hits, key)
    return H.source_boost(hits.drop("ord").join(picked, ["query_id", key]))


def answer_contexts(hits: DataFrame, questions: DataFrame, decisions: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row for each question: packed context, sources, and why no answer should be given, if so.

    ``decisions`` has ``query_id, key, label, relevance, evidence``; a question with decisions on too few of its hits falls
    back to the best hits by score.
    """
    q = questions.select("query_id", "query")
    numbered = J.judge_batches(hits.join(q, "query_id"))
    told = decisions.join(numbered.select("query_id", key, "abs_id"), ["query_id", key]).drop(key)
    judged = write_table(J.with_coverage(numbered, told), "judged")
    low = J.coverage_fallback(judged)
    gated = J.evidence_gate(judged.where("not use_fallback"))
    chosen = J.rerank_select(gated)
    same = [c for c in low.columns if c in chosen.columns]
    kept = write_table(
        chosen.select(*same, "has_entailment", "tier").unionByName(
            low.select(*same, F.lit(False).alias("has_entailment"), F.lit(2).alias("tier"))
        ),
        "kept",
    )
    kept = kept.withColumn("ord", F.col("rank"))
    stats = J.selection_stats(kept)
    rows, lanes = expansion_lane(judged, kept, chunks, stats)
    rows = write_table(rows, "context-rows")
    contexts = K.build_context(rows)
    counts = judged.groupBy("query_id").agg(
        F.count("*").alias("results"), F.max("score").alias("top_score"), F.first("use_fallback").alias("used_fallback")
    )
    per = q.select("query_id").join(counts, "query_id", "left").join(stats, "query_id", "left").join(lanes, "query_id", "left")
    per = per.join(rows.groupBy("query_id").agg(F.count("*").alias("context_rows")), "query_id", "left")
    per = per.join(contexts.select("query_id", "context", "used_chunks", "total_chars", "sources"), "query_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("results", "entailment_count", "neutral_kept", "context_rows", "used_chunks")}
    per = per.withColumns(zero).withColumns(
        {
            "kept": F.coalesce("output_count", F.lit(0)),
            "used_fallback": F.coalesce("used_fallback", F.lit(False)),
            "list_mode": F.coalesce(F.col("lane") == "list", F.lit(False)),
        }
    )
    return K.answer_gate(per).select(
        "query_id", "context", "sources", "results", "kept", "context_rows", "used_chunks", "lane", "refusal_reason"
    )
