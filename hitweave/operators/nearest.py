"""Approximate nearest vectors by random-projection buckets, with exact scores.

A table of hash bits is the side on which a vector lies of ``bits`` random planes; ``tables`` of them give every vector so
many buckets. A query is scored exactly against all chunks that share a bucket with it in any table, so what is found has
the score, rounding and tie-break of ``vector_topk``, and only neighbours that share no bucket are missed. A pair at angle
``a`` shares a bucket with chance ``1 - (1 - (1 - a / pi) ** bits) ** tables``: choose both by the similarity of the
neighbours that matter. For neighbours at small angles that is a small part of all pairs; for vectors without any close
neighbours (random directions) a recall of 0.9 takes most of the pairs, and the exact search is cheaper.

A bucket is met in blocks of at most ``BLOCK`` chunks and ``BLOCK`` queries, all of which meet, so a bucket that holds a third
of all vectors is no special case and no pair of a bucket is left out. Each meeting keeps k rows for a query; scored pairs
never exist as rows.

Defined cases: null vectors have no neighbours and are nobody's; zero vectors lie on one side of all planes and score 0;
equal vectors are ordered by key; vectors of another length stop the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.functions.ranking import top_rank
from hitweave.operators.search import _Running, _tiles, _unit

BITS, TABLES, SEED = 8, 16, 7
BLOCK = 1 << 14


def shared_bucket_chance(similarity: float, bits: int = BITS, tables: int = TABLES) -> float:
    """Chance that two vectors of this cosine meet in some table."""
    return 1 - (1 - (1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi) ** bits) ** tables


def _buckets(rows: DataFrame, key: str, d: int, bits: int, tables: int) -> DataFrame:
    """``key, embedding, cell``: a row for each table; ``cell`` is table and bucket."""
    planes = np.random.default_rng(SEED).normal(size=(d, tables * bits))
    powers = 1 << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                h = ((v @ planes > 0).reshape(len(v), tables, bits) @ powers) + (np.arange(tables) << bits)
                rows = np.repeat(np.arange(len(v)), tables)
                yield part.take(pa.array(rows)).append_column("cell", pa.array(h.ravel(), pa.int64()))

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` long, embedding {kind}, cell long")


def vector_topk_lsh(
    queries: DataFrame, chunks: DataFrame, key: str, k: int, bits: int = BITS, tables: int = TABLES, block: int = BLOCK
) -> DataFrame:
    """Like ``vector_topk``: ``query_id, key, score, ord`` of the k nearest chunks among those that share a bucket."""
    some = F.col("embedding").isNotNull()
    head = queries.where(some).select(F.size("embedding").alias("d")).first()
    if head is None:
        return chunks.sparkSession.createDataFrame([], f"query_id long, {key} long, score double, ord int")
    d = head.d
    same = F.when(F.size("embedding") == d, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors of {d} numbers expected")))
    sides = []
    for rows, name in ((queries, "query_id"), (chunks, key)):
        r = rows.where(some).select(F.col(name).cast("long").alias(name), same.alias("embedding"))
        sides.append(_buckets(r, name, d, bits, tables))
    # blocks of both sides of each bucket: tables * 2 ** bits rows
    counts = [s.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for s, n in zip(sides, ("q_blocks", "c_blocks"), strict=True)]
    blocks = F.broadcast(counts[0].join(counts[1], "cell"))
    q, c = (s.join(blocks, "cell") for s in sides)
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda name, n: F.pmod(F.xxhash64(F.lit(SEED), name), F.col(n)).cast("int")
    q = q.select("query_id", "embedding", "cell", of("query_id", "q_blocks").alias("qb"), others("c_blocks").alias("cb"))
    c = c.select(key, "embedding", "cell", others("q_blocks").alias("qb"), of(key, "c_blocks").alias("cb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        run = _Running(left.column("query_id").to_numpy(), k)
        if left.num_rows and right.num_rows:
            a, b = (_unit(np.stack(t.column("embedding").to_numpy()).astype(np.float64)) for t in (left, right))
            keys = right.column(key).to_numpy()
            for lo, hi in _tiles(len(a), len(keys)):
                run.add(keys, np.maximum(0.0, a[lo:hi] @ b.T), lo)
        return pa.Table.from_pandas(run.rows(key), preserve_index=False)

    by = ["cell", "qb", "cb"]
    found = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(meet, f"query_id long, {key} long, score double")
    return top_rank(found.distinct(), ["query_id"], [F.desc("score"), F.asc(key)], k)
