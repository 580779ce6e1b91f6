"""The flagship query: from raw documents to the best chunks for every benchmark passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.functions.text import sanitize_text
from hitweave.operators.chunking import sentence_chunk
from hitweave.operators.search import DOC_FIELDS, bm25_topk
from hitweave.operators.shaping import candidate_cut, source_boost
from hitweave.plans.tables import docs, read


def flagship(spark: SparkSession, sf_dir: str, keep: int = 5, fetch: int = 48) -> DataFrame:
    """Clean, chunk, search by keywords, cut, boost sources, keep the best five per passage."""
    d = docs(spark, sf_dir).withColumn("text", sanitize_text("text"))
    chunks = sentence_chunk(d).withColumn("chunk_key", F.col("doc_id") * (1 << 27) + F.col("chunk_index"))
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = bm25_topk(q, chunks, "chunk_key", DOC_FIELDS, fetch)
    hits = hits.withColumn("source_name", F.shiftright("chunk_key", 27).cast("string"))
    best = source_boost(candidate_cut(hits)).where(F.col("ord") <= keep)
    return best.select(
        "query_id",
        "ord",
        "source_name",
        (F.col("chunk_key") % (1 << 27)).alias("chunk_index"),
        F.round("score", 4).alias("score"),
        F.round("source_boost", 4).alias("source_boost"),
    )
