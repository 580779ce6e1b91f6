"""Candidate shaping: cut, diversity, source boost, stage statistics.

All of these work inside one query's hit list, which the search has already
cut to its fetch budget (at most 80 rows), so per-query arrays stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from hitweave.functions.lists import detect_list
from hitweave.functions.text import direct_answer_boost, norm_accent_insensitive, word_set
from hitweave.operators.search import SCORE_DIGITS
from hitweave.params import RANK

def by_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def score_or_zero(score: str = "score") -> Column:
    return F.coalesce(F.col(score), F.lit(0.0))


def candidate_cut(hits: DataFrame, top_n: int = RANK.cut_top_n, delta: float = RANK.cut_delta) -> DataFrame:
    """Rank by score; keep the first ``top_n`` and everything within ``delta`` of the best."""
    s = score_or_zero()
    rank = F.row_number().over(by_query().orderBy(s.desc(), F.asc("ord")))
    cut = hits.withColumn("_r", rank).withColumn("_top", F.max(s).over(by_query()))
    kept = cut.where((F.col("_r") <= top_n) | (s >= F.col("_top") - delta))
    return kept.withColumn("ord", F.col("_r")).drop("_r", "_top")


def _similarity(words: pa.ListArray) -> np.ndarray:
    """Jaccard similarity of all pairs of word lists (distinct words each; null: none)."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    member = np.zeros((len(words), len(coded.dictionary)), dtype=np.float32)
    member[np.repeat(np.arange(len(words)), size), coded.indices.to_numpy()] = 1
    both = (member @ member.T).astype(np.float64)
    union = size[:, None] + size[None, :] - both
    return np.where((size[:, None] > 0) & (size[None, :] > 0), both / np.where(union == 0, 1, union), 0.0)


def _mmr_positions(score: np.ndarray, sim: np.ndarray, k: int, lam: float) -> list[int]:
    nearest, left, out = np.zeros(len(score)), np.ones(len(score), dtype=bool), []
    for _ in range(k):
        value = np.where(left, lam * score - (1 - lam) * nearest, -np.inf)
        best = int(np.argmax(value))
        out.append(best)
        left[best] = False
        nearest = np.maximum(nearest, sim[best])
    return out


def with_word_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """The word set as one string: words hold no spaces, and an array takes twice the room in a shuffle."""
    words = F.col("word_set") if "word_set" in rows.columns else word_set(text)
    return rows.withColumn("word_text", F.array_join(words, " "))


def mmr_select(
    hits: DataFrame, key: str, k: int = RANK.mmr_k, lam: float = RANK.mmr_lambda, text: str = "text"
) -> DataFrame:
    """Maximal marginal relevance: (query_id, ord, key) of the k picked hits; shorter lists stay as they are.

    Each pick depends on the ones before, so a query's list goes through one small grouped call; the lists
    are bounded by the fetch budget of the search.
    """
    hits = hits if "word_text" in hits.columns else with_word_text(hits, text)
    words = F.nullif("word_text", F.lit("")).alias("words")
    rows = hits.select("query_id", "ord", F.col(key).alias("key"), score_or_zero().alias("score"), words)

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord").combine_chunks()
        if table.num_rows > k:
            sim = _similarity(pc.split_pattern(table["words"].chunk(0), " "))
            table = table.take(_mmr_positions(table["score"].to_numpy(), sim, k, lam))
        place = pa.array(np.arange(1, table.num_rows + 1), pa.int32())
        return pa.table({"query_id": table["query_id"], "ord": place, key: table["key"]})

    return rows.groupBy("query_id").applyInArrow(pick, f"query_id long, ord int, {key} long")


def with_features(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Per chunk what selection needs of its text: normalised form, word set, number of list items, boost of a direct answer.

    Belongs to ingestion: a chunk appears in many hit lists, its text need be analysed only once.
    """
    return chunks.withColumns(
        {
            "norm_text": norm_accent_insensitive(text),
            "word_set": word_set(text),
            "list_items": detect_list(text)["item_count"],
            "answer_boost": direct_answer_boost(text),
        }
    )


def source_aggregate(hits: DataFrame) -> DataFrame:
    """Per query and source: mean score, number of hits and their chunk numbers in list order."""
    name = F.coalesce(F.nullif("source_name", F.lit("")), F.lit("unknown")).alias("source_name")
    return hits.groupBy("query_id", name).agg(
        F.round(F.avg(score_or_zero()), SCORE_DIGITS).alias("avg_score"),
        F.count("*").alias("match_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_index"))), lambda x: x["chunk_index"]).alias(
            "chunk_indices"
        ),
    )


def source_boost(hits: DataFrame, per_match: float = RANK.boost_per_match, most: float = RANK.boost_max) -> DataFrame:
    """Reorder: sources by mean score x (1 + min(most, hits x per_match)), then hits by score."""
    w = Window.partitionBy("query_id", "source_name")
    boost = F.avg(score_or_zero()).over(w) * (1 + F.least(F.lit(most), F.count("*").over(w) * per_match))
    out = hits.withColumn("source_boost", F.round(boost, SCORE_DIGITS))
    order = by_query().orderBy(F.desc("source_boost"), F.asc("source_name"), score_or_zero().desc(), F.asc("ord"))
    return out.withColumn("ord", F.row_number().over(order))


def pipeline_stats(initial: DataFrame, cut: DataFrame, picked: DataFrame, final: DataFrame) -> DataFrame:
    """Row counts after each stage and the sources of the final list, per query."""
    stages = [("initial_count", initial), ("after_threshold", cut), ("after_rerank", picked), ("after_expansion", final)]
    tagged = None
    for name, df in stages:
        src = F.col("source_name") if name == "after_expansion" else F.lit(None).cast("string")
        rows = df.select("query_id", F.lit(name).alias("stage"), src.alias("source_name"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("query_id").agg(
        *[F.count_if(F.col("stage") == n).alias(n) for n, _ in stages],
        F.count_distinct("source_name").alias("sources_found"),
    )
