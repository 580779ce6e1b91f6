"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.ranking import top_rank
from hitweave.functions.text import text_or_empty

NEGATIVE_SCORE = 0.4


def _relevant() -> Column:
    return F.exists("source_matches", lambda m: F.contains(F.lower("source_name"), F.lower(m)))


def eval_retrieval(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per case: ``hit``, ``mrr``, ``success``, number of results. Cases without results stay."""
    r = cases.select("query_id", "source_matches", "should_refuse").join(
        ranked.select("query_id", "ord", "source_name", "score"), "query_id", "left"
    )
    rel = F.col("source_name").isNotNull() & _relevant()
    per = r.groupBy("query_id").agg(
        F.first("should_refuse").alias("should_refuse"),
        F.first(F.size("source_matches")).alias("_n"),
        F.min(F.when(rel, F.col("ord"))).alias("_first"),
        F.count("source_name").alias("total_chunks"),
        F.min_by("score", "ord").alias("_top"),
    )
    quiet = (F.col("total_chunks") == 0) | (F.col("_top") < NEGATIVE_SCORE)
    hit = F.when(F.col("_n") == 0, quiet).otherwise(F.col("_first").isNotNull())
    out = per.withColumn("hit", F.coalesce(hit, F.lit(False)))
    out = out.withColumn("mrr", F.when((F.col("_n") > 0) & F.col("_first").isNotNull(), 1 / F.col("_first")).otherwise(0.0))
    out = out.withColumn("rank", F.coalesce("_first", F.lit(0)))
    success = F.when(F.col("should_refuse"), F.coalesce(quiet, F.lit(False))).otherwise(F.col("hit"))
    return out.withColumn("success", success).drop("_n", "_first", "_top")


def eval_report(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, accuracy in percent, mean latency, mean reciprocal rank."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.avg(F.col("success").cast("double")) * 100, 2).alias("accuracy"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        F.round(F.avg("mrr"), 4).alias("avg_mrr"),
    )


def eval_context(ranked: DataFrame, first: int = 10, cut: int = 1500) -> DataFrame:
    """The first ten hits as one text per case."""
    top = top_rank(ranked, ["query_id"], [F.asc("ord")], first, "_r")
    t = text_or_empty("text")
    shown = F.when(F.length(t) > cut, F.concat(F.substring(t, 1, cut), F.lit("... (truncated)"))).otherwise(t)
    part = F.concat(F.lit("SOURCE: "), F.col("source_name"), F.lit("\nTEXT: "), shown)
    items = F.array_sort(F.collect_list(F.struct("_r", part.alias("t"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def eval_outcome(df: DataFrame) -> DataFrame:
    """Adds ``outcome`` from should_refuse, refused, hit and total_chunks."""
    outcome = (
        F.when(F.col("should_refuse"), F.when(~F.col("refused") & (F.col("total_chunks") > 0), "FAIL_HALLUCINATION").otherwise("PASS"))
        .when(~F.col("hit"), "FAIL_RETRIEVAL")
        .when(F.col("refused"), "FAIL_FALSE_NEGATIVE")
        .otherwise("PASS")
    )
    return df.withColumn("outcome", outcome)


def eval_keywords(df: DataFrame, answer: str = "answer", keywords: str = "keywords") -> DataFrame:
    """Adds the expected keywords found in the answer, and those missing."""
    low = F.lower(text_or_empty(answer))
    return df.withColumns(
        {
            "keywords_present": F.filter(keywords, lambda k: F.contains(low, F.lower(k))),
            "keywords_missing": F.filter(keywords, lambda k: ~F.contains(low, F.lower(k))),
        }
    )


def eval_citations(answer: Column | str) -> Column:
    """Source markers; a bracketed one counts twice, as marker and as word."""
    a = text_or_empty(answer)
    return F.size(F.regexp_extract_all(a, F.lit(r"\[Fuente:"), F.lit(0))) + F.size(
        F.regexp_extract_all(a, F.lit("Fuente:"), F.lit(0))
    )


def eval_rates(results: DataFrame) -> DataFrame:
    """Hit, hallucination and false-negative rates (percent), each over its own denominator."""
    refuse = F.col("should_refuse")

    def rate(bad: str, among: Column) -> Column:
        share = F.avg(F.when(among, (F.col("outcome") == bad).cast("double")))
        return F.round(F.coalesce(share, F.lit(0.0)) * 100, 2)

    return results.agg(
        F.count("*").alias("total"),
        F.round(F.avg(F.col("hit").cast("double")) * 100, 2).alias("hit_rate"),
        rate("FAIL_HALLUCINATION", refuse).alias("hallucination_rate"),
        rate("FAIL_FALSE_NEGATIVE", ~refuse).alias("false_negative_rate"),
        F.round(F.avg((F.col("outcome") == "PASS").cast("double")) * 100, 2).alias("success_rate"),
    )


def eval_percentile(df: DataFrame, by: str, value: str, p: float, accuracy: int = 10000) -> DataFrame:
    """Exact nearest-rank percentile per group.

    Approximate percentiles on both sides give bounds that hold the wanted rank; the rows below are counted, and only the
    distinct values within the bounds are sorted. No task sees a whole group, whatever its values are.
    """
    d = df.where(F.col(value).isNotNull()).select(by, value)
    off = 2 / accuracy
    sides = F.array(F.lit(max(0.0, p - off)), F.lit(min(1.0, p + off)))
    bounds = d.groupBy(by).agg(F.percentile_approx(value, sides, accuracy).alias("_b"))
    bounds = bounds.select(by, F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    marked = d.join(bounds, by)
    v = F.col(value)
    counts = marked.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(v < F.col("_lo")).alias("_below"))
    near = marked.where(v.between(F.col("_lo"), F.col("_hi"))).groupBy(by, value).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.greatest(F.lit(1), F.ceil(F.col("_n") * p)) - F.col("_below")
    reached = near.withColumn("_upto", upto).join(counts, by).where(F.col("_upto") >= rank)
    return reached.groupBy(by).agg(F.min(value).alias("percentile"))


def trace_summary(
    results: DataFrame, kept: DataFrame, expanded: DataFrame, contexts: DataFrame, refusals: DataFrame, budget: int, latencies: DataFrame
) -> DataFrame:
    """Per query one line over all stages: counts, budget use, tokens, status, and how long its calls took.

    ``latencies`` has ``query_id, ms`` for every timed call of a query, which are made outside; their sum is ``latency``.
    """
    size = F.length(text_or_empty("text"))
    r = results.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_distinct("source_name").alias("sources"))
    k = kept.groupBy("query_id").agg(F.count("*").alias("filter_out"))
    e = expanded.groupBy("query_id").agg(
        F.count_if("is_expansion").alias("added"), F.count_if(~F.col("is_expansion")).alias("retrieved"), F.sum(size).alias("_used")
    )
    c = contexts.select("query_id", F.col("used_chunks").alias("chunks"), F.ceil(F.length("context") / 4).alias("tokens"))
    out = r.join(k, "query_id", "left").join(e, "query_id", "left").join(c, "query_id", "left").join(refusals, "query_id", "left")
    out = out.join(latencies.groupBy("query_id").agg(F.round(F.sum("ms"), 2).alias("latency")), "query_id", "left")
    out = out.fillna(0, ["filter_out", "added", "retrieved", "_used", "chunks", "tokens"])
    return out.select(
        "query_id",
        "hits",
        "sources",
        F.col("hits").alias("filter_in"),
        "filter_out",
        "added",
        F.concat_ws("/", F.col("_used").cast("string"), F.lit(str(budget))).alias("budget"),
        "chunks",
        "tokens",
        (F.col("chunks") - F.least("chunks", "retrieved")).alias("expanded_in_context"),
        F.when(F.col("refusal_reason").isNotNull(), "refused").otherwise("ok").alias("status"),
        "latency",
    )


def trace_top(expanded: DataFrame, first: int = 5) -> DataFrame:
    return top_rank(expanded, ["query_id"], [F.asc("ord")], first, "pos")
