"""Retrieval operators: nearest vectors, keyword scoring and their fusion.

Queries come as a table, so thousands are answered by one job. Queries are
shipped to the tasks in blocks of a bounded size, each block for one pass over
the chunks; the same code runs for few and for many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.ranking import explode_rows, top_rank
from hitweave.functions.text import norm_accent_insensitive
from hitweave.params import SEARCH
from hitweave.session import write_table

SCORE_DIGITS = 9
# keyword scores below it are rounded to 0
LEAST = 0.4 * 10.0**-SCORE_DIGITS
# scores that are held at once in a task, and chunks scored at once by words
TILE = 2_000_000
BATCH = 4096


# --- nearest vectors -------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


class _Running:
    """Best k so far of every query over the batches of one task; scores below ``least`` never count."""

    def __init__(self, ids: np.ndarray, k: int, least: float = -np.inf) -> None:
        self.ids, self.k, self.least = ids, k, least
        self.score = np.full((len(ids), k), -np.inf)
        self.keys = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, keys: np.ndarray, score: np.ndarray, first: int = 0) -> None:
        """``score`` has one row per query, from query ``first`` on, and one column per key.

        Only cells that can still enter a list are rounded and sorted; everything tied with the last of a list may.
        """
        last = np.maximum(self.score[first : first + len(score), -1], self.least)
        short = np.flatnonzero(np.isneginf(last))
        if len(short) and score.shape[1] > self.k:
            last[short] = -np.partition(-score[short], self.k - 1, axis=1)[:, self.k - 1]
        at = np.flatnonzero(score >= last[:, None] - 2 * 10.0**-SCORE_DIGITS)
        row, col = at // score.shape[1], at % score.shape[1]
        if len(row):
            self._merge(row + first, keys[col], np.round(score[row, col], SCORE_DIGITS))

    def _merge(self, row: np.ndarray, keys: np.ndarray, score: np.ndarray) -> None:
        """The best k of each touched list and its new cells, ties by key."""
        rows, at = np.unique(row, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        score = np.concatenate([self.score[rows].ravel(), score])
        keys = np.concatenate([self.keys[rows].ravel(), keys])
        order = np.lexsort((keys, -score, owner))
        owner = owner[order]
        best = order[np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(rows)))[owner] < self.k]
        self.score[rows], self.keys[rows] = score[best].reshape(-1, self.k), keys[best].reshape(-1, self.k)

    def rows(self, key: str, above: float = -1.0) -> pd.DataFrame:
        keep = self.score > above
        ids = np.repeat(self.ids, keep.sum(axis=1))
        return pd.DataFrame({"query_id": ids, key: self.keys[keep], "score": self.score[keep]})


def _tiles(n: int, columns: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries whose scores against ``columns`` chunks are ``TILE`` cells at most."""
    step = max(1, TILE // max(1, columns))
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def query_blocks(queries: DataFrame, row_bytes: int, limit: int) -> Iterator[DataFrame]:
    """The queries in blocks of about ``limit`` bytes, by hash of their id; one block is one pass over the chunks."""
    n = max(1, -(-queries.count() * row_bytes // limit))
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)


def _cut(best: DataFrame, queries: DataFrame, k: int | str, key: str) -> DataFrame:
    """The best k of each query over all tasks; ``k`` may be a column of the queries."""
    if isinstance(k, int):
        return top_rank(best, ["query_id"], [F.desc("score"), F.asc(key)], k)
    ranked = best.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))))
    return ranked.join(queries.select("query_id", F.col(k).alias("_k")), "query_id").where("ord <= _k").drop("_k")


def _most(queries: DataFrame, k: int | str) -> int:
    return k if isinstance(k, int) else int(queries.agg(F.max(k).alias("k")).first().k or 1)


def _cosine(unit: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, unit @ _unit(vectors).T)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def vector_topk(
    queries: DataFrame, chunks: DataFrame, key: str, k: int | str, limit_bytes: int = SEARCH.broadcast_bytes
) -> DataFrame:
    """The k nearest chunks by cosine, score ``max(0, 1 - distance)``, ties by ``key``.

    ``queries(query_id long, embedding)``, ``chunks(key long, embedding)``; ``k`` is a number or a column of the queries.
    Rows without a vector have no neighbours; a vector of another length stops the job.

    Queries are sent to the tasks in blocks of a fixed size. The vectors are dealt once over the cores; a task multiplies
    tiles of ``TILE`` cells of queries and chunks and keeps k rows per query, so scored pairs never exist as rows.
    """
    some = F.col("embedding").isNotNull()
    chunks = chunks.where(some).select(key, "embedding").repartition(chunks.sparkSession.sparkContext.defaultParallelism)
    asked = queries.where(some)
    schema = f"query_id long, {key} long, score double"
    head = asked.select(F.size("embedding").alias("d")).first()
    if head is None:
        return chunks.sparkSession.createDataFrame([], schema + ", ord int")
    d, most = head["d"], _most(queries, k)
    vector = F.when(F.size("embedding") == d, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {d} numbers expected")))
    chunks, asked = chunks.withColumn("embedding", vector), asked.withColumn("embedding", vector)
    best = None
    for block in query_blocks(asked.select("query_id", "embedding"), (d + 2 * most) * 8, limit_bytes):
        local = block.toPandas()
        if not len(local):
            continue
        shared = chunks.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy(), _unit(_stack(local["embedding"]))))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, unit = shared.value
            run = _Running(ids, most)
            for b in batches:
                if len(b):
                    keys, vectors = b[key].to_numpy(), _unit(_stack(b["embedding"])).T
                    for lo, hi in _tiles(len(ids), len(b)):
                        run.add(keys, np.maximum(0.0, unit[lo:hi] @ vectors), lo)
            yield run.rows(key)

        part = chunks.mapInPandas(score, schema)
        best = part if best is None else best.unionByName(part)
    return _cut(best, queries, k, key)


# --- keyword scoring -------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.filter(F.split(norm_accent_insensitive(text), " "), lambda t: t != "")


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    return explode_rows(queries, ["query_id"], F.array_distinct(tokens(F.col(text))), value="term").drop("_i")


def bm25_topk(
    queries: DataFrame,
    chunks: DataFrame,
    key: str,
    fields: dict[str, float],
    k: int | str,
    text: str = "query",
    limit_bytes: int = SEARCH.broadcast_bytes,
    tokenised: DataFrame | None = None,
) -> DataFrame:
    """BM25F over weighted text fields: the best k chunks per query, ties by ``key``; ``k`` is a number or a column.

    Field frequencies are length-normalised and weighted before saturation;
    idf = ln(1 + (N - df + .5) / (df + .5)), df counted over all fields.

    Chunks are tokenised once into a table in the shared folder (``tokenised`` passes one that exists) and never shuffled.
    Queries are sent to the tasks in blocks of a fixed size: one pass counts the document frequencies of their terms, a
    second adds up, tile by tile, the postings of each query's terms in a batch and keeps k rows per query. Frequent words
    cost arithmetic, not rows.
    """
    tok = field_tokens(chunks, key, fields) if tokenised is None else tokenised
    weights, most = list(fields.values()), _most(queries, k)
    best = None
    # some tens of terms of some tens of bytes each
    for block in query_blocks(queries.select("query_id", text), 2048 + 16 * most, limit_bytes):
        part = _bm25_block(query_terms(block, text), tok, key, weights, most)
        best = part if best is None else best.unionByName(part)
    return _cut(best, queries, k, key)


def field_tokens(chunks: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    return write_table(chunks.select(key, *[tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)]), "tokens")


def _bm25_block(terms: DataFrame, tok: DataFrame, key: str, weights: list[float], k: int) -> DataFrame:
    asked = terms.toPandas()  # one block of queries
    ids, row = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    col, vocabulary = pd.factorize(asked["term"])
    df, n_chunks, average = _bm25_totals(tok, list(vocabulary), len(weights))
    idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
    order = np.argsort(row, kind="stable")
    shared = tok.sparkSession.sparkContext.broadcast((ids, row[order], col[order], list(vocabulary), idf, average))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row, col, words, idf, average = shared.value
        words, run = pa.array(words, pa.string()), _Running(ids, k, LEAST)
        for batch in batches:
            for lo in range(0, batch.num_rows if len(words) else 0, BATCH):
                part = batch.slice(lo, BATCH)
                chunk, weight, first = _postings(part, words, weights, average)
                _add_keyword_scores(run, row, col, idf, part.column(0).to_numpy(), chunk, weight, first)
        yield pa.RecordBatch.from_pandas(run.rows(key, above=0.0), preserve_index=False)

    return tok.mapInArrow(score, f"query_id long, {key} long, score double")


def _add_keyword_scores(
    run: _Running, row: np.ndarray, col: np.ndarray, idf: np.ndarray, keys: np.ndarray, chunk: np.ndarray, weight: np.ndarray, first: np.ndarray
) -> None:
    """Add up, tile by tile, the saturated weights of each query's terms in the chunks ``keys``.

    Query ``row[j]`` has term ``col[j]`` (sorted by query); the postings of term ``t`` are ``first[t]:first[t + 1]``.
    """
    weight = weight * (SEARCH.k1 + 1) / (weight + SEARCH.k1) * np.repeat(idf, np.diff(first))
    for a, b in _tiles(len(run.ids), len(keys)):
        p, q = np.searchsorted(row, [a, b])
        size = first[col[p:q] + 1] - first[col[p:q]]
        at = np.arange(size.sum()) + np.repeat(first[col[p:q]] - np.cumsum(size) + size, size)
        cell = np.repeat(row[p:q] - a, size) * len(keys) + chunk[at]
        run.add(keys, np.bincount(cell, weight[at], (b - a) * len(keys)).reshape(b - a, len(keys)), a)


def _postings(
    part: pa.RecordBatch, words: pa.Array, weights: list[float], average: list[float]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the batch that hold a term, by term, with their frequencies: field counts over their length norm, weighted and summed.

    The postings of term ``t`` are ``first[t]:first[t + 1]``.
    """
    n, cells, sums = part.num_rows, [], []
    for i, (w, mean) in enumerate(zip(weights, average)):
        tokens_ = part.column(i + 1)
        length = pc.list_value_length(tokens_).to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(tokens_.flatten(), value_set=words), -1).to_numpy()
        cell = term.astype(np.int64) * n + np.repeat(np.arange(n), length)
        cell, count = np.unique(cell[term >= 0], return_counts=True)
        norm = 1 - SEARCH.b + SEARCH.b * length / mean if mean else np.ones(n)
        cells.append(cell)
        sums.append(w * count / norm[cell % n])
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    weight = np.bincount(at, np.concatenate(sums), len(cell))
    return cell % n, weight, np.searchsorted(cell, np.arange(len(words) + 1) * n)


def _bm25_totals(tok: DataFrame, vocabulary: list[str], n: int) -> tuple[np.ndarray, int, list[float]]:
    """Document frequency per vocabulary term, number of chunks, mean field lengths.

    Every task emits one small count per term it met (term -1: chunks, -2-i: length of field i).
    """
    shared = tok.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value, pa.string())
        v = len(words)
        total = np.zeros(v + 1 + n, dtype=np.int64)
        for batch in batches:
            met = []
            for i in range(n):
                lists = batch.column(i + 1)
                size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy()
                met.append((np.repeat(np.arange(batch.num_rows), size) * v + term)[term >= 0])
                total[v + 1 + i] += int(size.sum())
            total[v] += batch.num_rows
            total[:v] += np.bincount(np.unique(np.concatenate(met)) % max(v, 1), minlength=v)[:v].astype(np.int64)
        ids = np.concatenate([np.arange(v), np.arange(-1, -2 - n, -1)])
        keep = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(total[keep])], ["id", "n"])

    sums = tok.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(sums["id"], sums["n"]))
    chunks = int(found.get(-1, 0))
    df = np.array([found.get(i, 0) for i in range(len(vocabulary))], dtype=np.float64)
    return df, chunks, [float(found.get(-2 - i, 0)) / chunks if chunks else 0.0 for i in range(n)]


# --- fusion ----------------------------------------------------------------


def minmax_score(df: DataFrame, by: list[str], score: str = "score", out: str = "norm_score") -> DataFrame:
    """(s - min) / (max - min) inside a result list; a flat list keeps denominator 1."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return df.withColumn(out, (F.col(score) - lo) / span)


def _relative(df: DataFrame, by: list[str]) -> DataFrame:
    """Min-max for fusion: a flat list scores 1."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("_rel", F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def fuse_relative(vector: DataFrame, keyword: DataFrame, alpha: Column, by: list[str], key: str) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword over min-max scores; absent in a list counts 0."""
    tagged = _relative(vector, by).select(*by, key, (alpha * F.col("_rel")).alias("_part")).unionByName(
        _relative(keyword, by).select(*by, key, ((1 - alpha) * F.col("_rel")).alias("_part"))
    )
    return tagged.groupBy(*by, key).agg(F.round(F.sum("_part"), SCORE_DIGITS).alias("score"))


def fuse_ranked(vector: DataFrame, keyword: DataFrame, alpha: Column, by: list[str], key: str) -> DataFrame:
    """Weighted reciprocal ranks."""
    k = SEARCH.rrf_k
    tagged = vector.select(*by, key, (alpha / (k + F.col("ord"))).alias("_part")).unionByName(
        keyword.select(*by, key, ((1 - alpha) / (k + F.col("ord"))).alias("_part"))
    )
    return tagged.groupBy(*by, key).agg(F.round(F.sum("_part"), SCORE_DIGITS).alias("score"))


# fixed values: weighted keyword fields of the two collections
DOC_FIELDS = {"content_without_overlap": 2.0, "text": 1.0}
QNA_FIELDS = {"question_text": 4.0, "content_without_overlap": 2.0, "text": 1.0}


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    key: str,
    limit: int | str,
    alpha: float | str,
    fields: dict[str, float],
    fusion: str | None = None,
) -> DataFrame:
    """Both searches cut at ``limit``, fused by relative score, best ``limit`` kept.

    ``alpha`` is the share of the vector score. Both may be numbers or columns of ``queries``. ``fusion`` names a column
    that says ``ranked`` for queries whose lists are fused by reciprocal ranks.
    """
    v, b, a = _both_lists(queries, chunks, key, limit, alpha, fields)
    if fusion is None:
        return _cut(fuse_relative(v, b, a, ["query_id"], key), queries, limit, key)
    v, b = write_table(v, "vector-hits"), write_table(b, "keyword-hits")
    ranked = queries.where(F.col(fusion) == "ranked").select("query_id")
    of = lambda df, how: df.join(ranked, "query_id", how)
    fused = fuse_ranked(of(v, "left_semi"), of(b, "left_semi"), a, ["query_id"], key)
    fused = fused.unionByName(fuse_relative(of(v, "left_anti"), of(b, "left_anti"), a, ["query_id"], key))
    return _cut(fused, queries, limit, key)


def _both_lists(queries, chunks, key, limit, alpha, fields):
    v = vector_topk(queries, chunks, key, limit)
    b = bm25_topk(queries, chunks, key, fields, limit)
    if isinstance(alpha, str):
        a = queries.select("query_id", F.col(alpha).alias("_alpha"))
        return v.join(a, "query_id"), b.join(a, "query_id"), F.col("_alpha")
    return v, b, F.lit(float(alpha))


def ranked_fusion(
    queries: DataFrame, chunks: DataFrame, key: str, limit: int | str, alpha: float | str, fields: dict[str, float]
) -> DataFrame:
    """As ``hybrid_search`` with weighted reciprocal ranks."""
    v, b, a = _both_lists(queries, chunks, key, limit, alpha, fields)
    fused = fuse_ranked(v, b, a, ["query_id"], key)
    return _cut(fused, queries, limit, key)


def hybrid_search_both(
    queries: DataFrame, chunks: DataFrame, key: str, limit: int | str, alpha: float | str, fusion: str | None = None
) -> DataFrame:
    """Per collection the best ``limit``, then the best ``limit`` of both; ``limit`` may be a column of ``queries``."""
    doc = hybrid_search(queries, chunks.where("collection = 'doc'"), key, limit, alpha, DOC_FIELDS, fusion)
    qna = hybrid_search(queries, chunks.where("collection = 'qna'"), key, limit, alpha, QNA_FIELDS, fusion)
    both = doc.withColumn("collection", F.lit("doc")).unionByName(qna.withColumn("collection", F.lit("qna")))
    order = [F.desc("score"), F.asc("collection"), F.asc(key)]
    if isinstance(limit, int):
        return top_rank(both.drop("ord"), ["query_id"], order, limit)
    ranked = both.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.join(queries.select("query_id", F.col(limit).alias("_k")), "query_id").where("ord <= _k").drop("_k")


def autocut(hits: DataFrame, jumps: int, threshold: float = 0.1) -> DataFrame:
    """Keep an ordered list up to its ``jumps``-th score drop larger than ``threshold``
    (as a share of the list's score range)."""
    w = Window.partitionBy("query_id").orderBy("ord")
    whole = Window.partitionBy("query_id")
    span = F.max("score").over(whole) - F.min("score").over(whole)
    gap = F.lag("score").over(w) - F.col("score")
    drop = F.coalesce((gap > threshold * F.col("_span")).cast("int"), F.lit(0))
    out = hits.withColumn("_span", span).withColumn("_drop", drop)
    out = out.withColumn("_n", F.sum("_drop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("_n") < jumps).drop("_span", "_drop", "_n")


def search_fallback(queries: DataFrame, hybrid: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Queries without a hybrid result get the vector search; 40 hits for low alpha, else 25."""
    # read by each pass over the queries without a result: searched once
    hybrid = write_table(hybrid.select("query_id", key, "score", "ord"), "hybrid-hits")
    missing = queries.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    limit = F.when(F.col("alpha") <= SEARCH.low_alpha, 40).otherwise(25)
    v = vector_topk(missing, chunks, key, 40)
    v = v.join(queries.select("query_id", limit.alias("_limit")), "query_id").where(F.col("ord") <= F.col("_limit"))
    v = v.select("query_id", key, "score", "ord", F.lit("vector").alias("mode"))
    return hybrid.select("query_id", key, "score", "ord", F.lit("hybrid").alias("mode")).unionByName(v)
