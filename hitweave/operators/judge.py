"""Judge batches, decisions and the evidence-gated selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.lists import detect_list
from hitweave.functions.ranking import explode_rows, top_rank
from hitweave.functions.text import direct_answer_boost, excerpt_window, norm_accent_insensitive, text_or_empty, trim_ws
from hitweave.operators.shaping import by_query, score_or_zero
from hitweave.params import JUDGE


def with_excerpt_norm(chunks: DataFrame) -> DataFrame:
    """The normal forms that ``judge_batches`` wants of long texts, made once for each chunk and not for each hit."""
    return chunks.withColumn("excerpt_norm", F.when(F.length("text") > JUDGE.excerpt_chars, norm_accent_insensitive("text")))


def judge_batches(hits: DataFrame, query: str = "query", max_batches: int | None = JUDGE.max_batches) -> DataFrame:
    """Number the hits from 0, cut them into prompts (all, or ``max_batches`` per query) and attach the excerpt to show.

    Hits may come with ``excerpt_norm`` (``with_excerpt_norm``) and ``query_tokens`` (``excerpt_tokens`` of the query).
    """
    norm, toks = (F.col(c) if c in hits.columns else None for c in ("excerpt_norm", "query_tokens"))
    # cut first: the lists are dealt by query without the whole texts, where nobody reads these
    out = hits.withColumn("excerpt", excerpt_window("text", query, JUDGE.excerpt_chars, norm, toks)).drop("excerpt_norm", "query_tokens")
    out = out.withColumn("abs_id", F.row_number().over(by_query().orderBy("ord")) - 1)
    out = out.withColumn("batch_no", F.floor(F.col("abs_id") / JUDGE.batch_size).cast("int"))
    return out if max_batches is None else out.where(F.col("batch_no") < max_batches)


# fixed value: the shape of a judge answer
RESPONSE = "results array<struct<id: double, label: string, relevance: string, evidence: string>>"


def parse_decisions(responses: DataFrame, keep: list[str], response: str = "response") -> DataFrame:
    """JSON answers (optionally fenced) -> one row per decision; broken JSON gives none."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.col(response).rlike(r"(?s)```.*?```"), trim_ws(fenced)).otherwise(F.col(response))
    df = responses.select(*keep, body.alias("_j"))
    parsed = F.from_json(F.when(F.try_parse_json("_j").isNotNull(), F.col("_j")), RESPONSE)
    rows = explode_rows(df, keep, parsed["results"], "seq", "_d").where(F.col("_d.id").isNotNull())
    label = F.upper(text_or_empty("_d.label"))
    relevance = F.coalesce(F.col("_d.relevance").try_cast("double"), F.lit(0.0))
    relevance = F.when(F.isnan(relevance) | (F.abs(relevance) == float("inf")), 0.0).otherwise(relevance)
    return rows.select(
        *keep,
        "seq",
        F.col("_d.id").alias("id"),
        F.when(label.isin("ENTAILMENT", "NEUTRAL"), label).otherwise("CONTRADICTION").alias("label"),
        F.greatest(F.lit(0), F.least(F.lit(10), F.floor(relevance + 0.5))).cast("int").alias("relevance"),
        trim_ws(text_or_empty("_d.evidence")).alias("evidence"),
    )


def _label_rank() -> Column:
    return F.when(F.col("label") == "ENTAILMENT", 2).when(F.col("label") == "NEUTRAL", 1).otherwise(0)


def dedupe_decisions(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Drop ids the hit list does not have; of several keep the strongest label, then relevance, then the first."""
    whole = decisions.where(F.col("id") == F.floor("id")).withColumn("abs_id", F.col("id").cast("int"))
    known = whole.join(hits.select("query_id", "abs_id"), ["query_id", "abs_id"], "left_semi")
    order = [_label_rank().desc(), F.desc("relevance"), F.asc("seq")]
    return top_rank(known, ["query_id", "abs_id"], order, 1, "_r").drop("_r", "id")


def decision_issues(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: decisions with unknown ids, and surplus decisions for one id."""
    whole = decisions.where(F.col("id") == F.floor("id")).withColumn("abs_id", F.col("id").cast("int"))
    per_id = whole.groupBy("query_id", "abs_id").agg(F.count("*").alias("n"))
    marked = per_id.join(hits.select("query_id", "abs_id", F.lit(True).alias("_known")), ["query_id", "abs_id"], "left")
    return marked.groupBy("query_id").agg(
        F.sum(F.when(F.col("_known"), 0).otherwise(F.col("n"))).alias("unknown_ids"),
        F.sum(F.when(F.col("_known"), F.col("n") - 1).otherwise(0)).alias("duplicate_ids"),
    )


def with_coverage(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hits with their decision (null if undecided) and ``use_fallback`` per query."""
    joined = hits.join(decisions.select("query_id", "abs_id", "label", "relevance", "evidence"), ["query_id", "abs_id"], "left")
    share = F.count("label").over(by_query()) / F.count("*").over(by_query())
    return joined.withColumn("use_fallback", share < JUDGE.min_coverage)


def coverage_fallback(judged: DataFrame, keep: int = JUDGE.keep) -> DataFrame:
    """Poorly covered queries: the best ``keep`` hits by retrieval score."""
    low = judged.where("use_fallback")
    return top_rank(low, ["query_id"], [score_or_zero().desc(), F.asc("abs_id")], keep, "rank")


def evidence_gate(judged: DataFrame, query: str = "query") -> DataFrame:
    """Final label and the reason an entailment was not believed.

    It needs evidence that occurs in the chunk, is not the question itself, and a high relevance.
    """
    df = judged.withColumn("raw_label", F.coalesce("label", F.lit("NEUTRAL")))
    df = df.withColumn("relevance", F.coalesce("relevance", F.lit(0))).withColumn("evidence", trim_ws(text_or_empty("evidence")))
    body = F.col("norm_text") if "norm_text" in df.columns else norm_accent_insensitive("text")
    df = df.withColumns({"_e": norm_accent_insensitive("evidence"), "_q": norm_accent_insensitive(query), "_t": body})
    has = F.col("evidence") != ""
    found = F.contains("_t", "_e")
    asked = F.col("evidence").contains("?") | ((F.col("_e") != "") & F.contains("_q", "_e"))
    reason = (
        F.when(F.col("raw_label") != "ENTAILMENT", None)
        .when(~has, "no_evidence")
        .when(~found, "evidence_mismatch")
        .when(asked, "evidence_is_question")
        .when(F.col("relevance") < JUDGE.min_relevance, "low_relevance")
    )
    df = df.withColumn("downgrade_reason", reason)
    label = F.when(F.col("downgrade_reason").isNotNull(), "NEUTRAL").otherwise(F.col("raw_label"))
    return df.withColumn("label", label).drop("_e", "_q", "_t")


def downgrade_reasons(gated: DataFrame) -> DataFrame:
    return (
        gated.where(F.col("downgrade_reason").isNotNull())
        .groupBy("query_id", "downgrade_reason")
        .agg(F.count("*").alias("n"))
    )


def rerank_select(gated: DataFrame, keep: int = JUDGE.keep) -> DataFrame:
    """At most ``keep`` hits per query, in four tiers.

    0 entailments; 1 neutral list parts within two chunks of an entailment; 2 neutrals with a trusted
    retrieval score; 3 the best three by retrieval. Without any entailment the best by retrieval.
    """
    s = score_or_zero()
    ent = F.col("label") == "ENTAILMENT"
    # what is wanted of the texts comes first: the shuffles below need not carry them
    items = F.col("list_items") if "list_items" in gated.columns else detect_list("text")["item_count"]
    boost = F.col("answer_boost") if "answer_boost" in gated.columns else direct_answer_boost("text")
    df = gated.where(F.col("label") != "CONTRADICTION")
    df = df.withColumns({"_items": F.when(~ent, items), "_boost": F.when(ent, boost)})
    df = df.withColumn("_any", F.max(ent.cast("int")).over(by_query()) == 1)
    df = df.withColumn("_best", F.row_number().over(by_query().orderBy(s.desc(), F.asc("abs_id"))))
    steps = [d for d in range(-JUDGE.adjacency, JUDGE.adjacency + 1) if d]
    near = (
        df.where(ent)
        .select("query_id", "source_name", F.explode(F.array(*[F.col("chunk_index") + d for d in steps])).alias("chunk_index"))
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    df = df.join(near, ["query_id", "source_name", "chunk_index"], "left")
    listed = F.when(F.col("_near") & ~ent, F.col("_items") >= 2)
    tier = (
        F.when(~F.col("_any"), F.lit(0))
        .when(ent, 0)
        .when(F.coalesce(listed, F.lit(False)), 1)
        .when(s >= JUDGE.trust_score, 2)
        .when(F.col("_best") <= JUDGE.safety_net, 3)
    )
    df = df.withColumn("tier", tier).where(F.col("tier").isNotNull())
    strong = F.col("_any") & (F.col("tier") == 0)
    order = [
        F.asc("tier"),
        F.when(strong, F.col("_boost")).otherwise(0).desc(),
        F.when(strong, F.col("relevance")).otherwise(0).desc(),
        s.desc(),
        F.asc("abs_id"),
    ]
    out = top_rank(df, ["query_id"], order, keep, "rank").drop("_best", "_near", "_items", "_boost")
    return out.withColumnRenamed("_any", "has_entailment")


def passthrough(hits: DataFrame, keep: int = JUDGE.keep) -> DataFrame:
    """Judge switched off: the first ``keep`` hits, unchanged."""
    return top_rank(hits, ["query_id"], [F.asc("ord")], keep, "rank")


def selection_stats(selected: DataFrame) -> DataFrame:
    """Per query: kept hits, kept entailments, and neutrals kept on purpose (not by the safety net)."""
    ent = F.col("has_entailment") & (F.col("tier") == 0)
    neutral = F.when(F.col("has_entailment"), F.col("tier").isin(1, 2)).otherwise(True)
    return selected.groupBy("query_id").agg(
        F.count("*").alias("output_count"),
        F.count_if(ent).alias("entailment_count"),
        F.count_if(neutral).alias("neutral_kept"),
    )


