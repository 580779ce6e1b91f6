"""A stored inverted index for keyword search: postings by term, appendable, read only where terms are asked for.

Chunks are tokenised and inverted in the task that reads them, ``SHARD`` chunks at a time, without a shuffle of texts: a row
holds the postings of one term in one shard (the chunks' places there, and the counts of each field) and so at most
``SHARD`` of them; one more row of the shard has its chunks' keys and field lengths. Rows are dealt to folders by hash of the term and sorted by term, so a search reads the folders of its
terms. Every append adds a folder ``batch=N``; document frequencies and mean lengths are sums
over the batches, so scores are those of one index over all chunks.

A search reads term and number of postings first (document frequencies), then the postings of the asked terms, dealt by
shard: each shard's scores are added up tile by tile and the best k of every query leave the task. Postings never become
rows of queries, so frequent words cost arithmetic, and rare words read little.

Defined cases: null texts are empty; chunks without words count for totals only; a chunk appended twice is two chunks of
equal key; queries without known terms have no hits; an index without batches finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators.search import LEAST, _add_keyword_scores, _cut, _most, _Running, query_blocks, query_terms, tokens
from hitweave.params import SEARCH

SHARD = 1 << 13
BUCKETS = 64


def _ints(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _inverted(parts: list[pa.RecordBatch], fields: int, shard: int) -> pa.RecordBatch:
    """Postings of some chunks. Columns: key, and the tokens of each field."""
    table = pa.Table.from_batches(parts).combine_chunks()
    keys, n = table.column(0).to_numpy(), table.num_rows
    lists = [pc.fill_null(table.column(i + 1), pa.scalar([], pa.list_(pa.string()))).combine_chunks() for i in range(fields)]
    length = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    words = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
    term = words.indices.to_numpy().astype(np.int64)
    owner = np.concatenate([np.repeat(np.arange(n), x) for x in length])
    of_field = np.repeat(np.arange(fields), [x.sum() for x in length])
    cell, at = np.unique(term * n + owner, return_inverse=True)  # by term, then chunk
    counts = [np.bincount(at[of_field == i], minlength=len(cell)) for i in range(fields)]
    first = np.searchsorted(cell, np.arange(len(words.dictionary) + 1) * n)
    chunk = cell % max(n, 1)
    terms = len(first) - 1
    # the last row is the shard's own
    last = lambda values, kind: pa.concat_arrays([pa.nulls(terms, pa.list_(kind)), pa.array([values], pa.list_(kind))])
    rest = lambda lists: pa.concat_arrays([lists, pa.nulls(1, lists.type)])
    columns = [
        pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())]), pa.array(np.full(terms + 1, shard), pa.int64()),
        pa.array(np.append(np.diff(first), n), pa.int32()), last(keys, pa.int64()), rest(_ints(first, chunk, pa.int32())),
    ]
    for i in range(fields):
        columns += [rest(_ints(first, counts[i], pa.int32())), last(length[i], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _schema(fields).split(", ")])


def _schema(fields: int) -> str:
    lists = "".join(f", count{i} array<int>, length{i} array<int>" for i in range(fields))
    return f"term string, shard long, n int, keys array<long>, at array<int>{lists}"


class KeywordIndex:
    """An index below ``path`` over ``fields`` (name: weight) of chunks known by a number."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], buckets: int = BUCKETS, shard: int = SHARD) -> None:
        self.spark, self.path, self.fields, self.buckets, self.shard = spark, path, fields, buckets, shard

    def _bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def append(self, chunks: DataFrame, key: str, batch: int) -> None:
        """Add the postings of these chunks. A batch number that exists is written anew, so a failed append can be repeated."""
        n, shard_rows = len(self.fields), self.shard
        words = chunks.select(F.col(key).cast("long").alias("key"), *[tokens(F.coalesce(f, F.lit(""))).alias(f"t{i}") for i, f in enumerate(self.fields)])

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, done, kept, rows = TaskContext.get().partitionId() << 32, 0, [], 0
            for b in batches:
                while b.num_rows:
                    take = b.slice(0, shard_rows - rows)
                    kept, rows, b = [*kept, take], rows + take.num_rows, b.slice(take.num_rows)
                    if rows == shard_rows:
                        yield _inverted(kept, n, first + done)
                        kept, rows, done = [], 0, done + 1
            if rows:
                yield _inverted(kept, n, first + done)

        rows = words.mapInArrow(invert, _schema(n))
        rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(self._bucket("term")))
        rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "shard")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_schema(len(self.fields))}, batch int, bucket int").parquet(self.path)

    def totals(self) -> tuple[int, list[float]]:
        """Number of chunks and mean length of each field."""
        sums = [F.sum(F.expr(f"aggregate(length{i}, 0L, (a, x) -> a + x)")) for i in range(len(self.fields))]
        r = self.postings().where("bucket = -1").agg(F.sum("n"), *sums).first()
        return int(r[0] or 0), [float(x or 0) / r[0] if r[0] else 0.0 for x in r[1:]]

    def asked(self, terms: DataFrame) -> DataFrame:
        """The index rows of some terms (``term``; few enough to be sent to the tasks)."""
        buckets = [r[0] for r in terms.select(self._bucket("term").alias("b")).distinct().collect()]  # one row for each bucket
        few = F.broadcast(terms.select("term").distinct())
        return self.postings().where(F.col("bucket").isin(buckets)).join(few, "term", "left_semi")

    def search(self, queries: DataFrame, k: int | str, key: str = "key", text: str = "query", limit_bytes: int = SEARCH.broadcast_bytes) -> DataFrame:
        """The best k chunks of each query, ``query_id, key, score, ord``, as ``bm25_topk`` over all appended chunks."""
        most, best = _most(queries, k), None
        n_chunks, average = self.totals()
        for block in query_blocks(queries.select("query_id", text), 2048 + 16 * most, limit_bytes):
            part = self._block(query_terms(block, text), key, most, n_chunks, average)
            best = part if best is None else best.unionByName(part)
        return _cut(best, queries, k, key)

    def _block(self, terms: DataFrame, key: str, k: int, n_chunks: int, average: list[float]) -> DataFrame:
        asked = terms.toPandas()  # one block of queries
        ids, row = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        col, vocabulary = pd.factorize(asked["term"])
        rows = self.asked(self.spark.createDataFrame([(str(t),) for t in vocabulary], "term string"))
        found = {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # terms of the block at most
        df = np.array([found.get(t, 0) for t in vocabulary], dtype=np.float64)
        idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
        order = np.argsort(row, kind="stable")
        shared = self.spark.sparkContext.broadcast((ids, row[order], col[order], list(vocabulary), idf))
        weights = list(self.fields.values())

        def score(table: pa.Table) -> pa.Table:
            ids, row, col, words, idf = shared.value
            run = _Running(ids, k, LEAST)
            own = table.filter(pc.is_null(table.column("term"))).slice(0, 1)
            table = table.filter(pc.is_valid(table.column("term"))).combine_chunks()
            term = pc.index_in(table.column("term").combine_chunks(), value_set=pa.array(words, pa.string())).to_numpy()
            table = table.take(pa.array(np.argsort(term, kind="stable")))
            size = np.zeros(len(words) + 1, np.int64)
            size[np.sort(term) + 1] = table.column("n").to_numpy()
            flat = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy()
            keys, chunk = flat(own, "keys"), flat(table, "at")
            weight = np.zeros(len(chunk))
            for i, (w, mean) in enumerate(zip(weights, average, strict=True)):
                norm = 1 - SEARCH.b + SEARCH.b * flat(own, f"length{i}") / mean if mean else np.ones(len(keys))
                weight += w * flat(table, f"count{i}") / norm[chunk]
            _add_keyword_scores(run, row, col, idf, keys, chunk, weight, np.cumsum(size))
            return pa.Table.from_pandas(run.rows(key, above=0.0), preserve_index=False)

        shards = rows.select("batch", "shard").distinct()
        owns = self.postings().where("bucket = -1").join(shards, ["batch", "shard"], "left_semi").select(*rows.columns)
        rows = rows.unionByName(owns)
        return rows.drop("bucket").groupBy("batch", "shard").applyInArrow(score, f"query_id long, {key} long, score double")
