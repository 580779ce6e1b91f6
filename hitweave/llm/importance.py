"""Importance resampling towards a target distribution: hashed word runs, array-scored weights, a cut-off by bisection.

Every run of 1 to ``longest`` words falls into one of ``buckets`` by its crc32. The log ratio of a bucket's share in
the target and in the corpus is its gain; the gains are one array of fixed size, and a document's weight is the sum of
the array's entries at its features. Weight plus Gumbel noise, which a hash of the id fixes, is the score; the highest
scores are a sample without replacement in proportion to ``exp(weight / 1000)``.

The cut-off is found by exact count jobs over the stored scores: each narrows the range of integers that can be the
cut-off to a sixteenth, first for the score, then for the ids tied at it. Only what is drawn is then dealt by range, sorted
and numbered: a row's rank is its place in its partition plus the rows of the partitions before.

Defined cases: null and empty texts have no features and weight 0; a null id is written as an empty one and comes last
among ties; rows of equal score and id share their place in the order and are numbered one after another (so some may be
drawn and others not); without documents of ``least_words`` words nothing is drawn; an empty target has equal shares in all buckets; empty tables
give empty results. Columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import Words, slices, words
from hitweave.session import write_table

BUCKETS = 10000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
WAYS = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.frombuffer(b" ", np.uint8)
_STEPWISE = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _feed(state: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after ``length`` more bytes of ``data`` from ``at``, for all words at once, byte by byte."""
    short = np.minimum(length, _STEPWISE + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    longer = np.cumsum(np.bincount(short, minlength=_STEPWISE + 2)[::-1])[::-1]  # words of at least so many bytes
    out, at = state[order], at[order]
    first = int(longer[_STEPWISE + 1])
    for k in range(first):  # the few very long ones
        part = data[at[k] : at[k] + length[order[k]]].tobytes()
        out[k] = zlib.crc32(part, int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(_STEPWISE):
        n = int(longer[j + 1])
        if n == first:
            break
        s = out[first:n]
        out[first:n] = _CRC[(s ^ data[at[first:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def run_crcs(w: Words, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``longest``: crc32 of all runs of n words, joined by one space, and the index of their first words."""
    data = _LOWER[w.data]
    length = w.end - w.start
    first = np.arange(len(w.start))
    ends = np.repeat(w.first[1:], w.counts())
    state = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for n in range(longest):
        if n:
            keep = first + n < ends[first]
            first, state = first[keep], state[keep]
            state = _CRC[(state ^ _SPACE) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _feed(state, data, w.start[first + n], length[first + n])
        yield state ^ np.uint32(0xFFFFFFFF), first


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features in each bucket, over all texts. A task gives one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, text):
            for crc, _ in run_crcs(words(batch.column(0)), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(F.col(text).alias(text)).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket, from the counts of both."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.na.fill(0, ["s", "t"])
    total = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    over = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets))
    under = (F.col("s") + 1.0) * (F.col("all_t") + float(buckets))
    one = both.join(F.broadcast(total), F.lit(True))  # one row
    return one.select("bucket", F.floor(F.lit(1000.0) * F.log(over / under)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight`` of every document. ``gain`` has an entry for each bucket."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            w = words(batch.column(1))
            n_features, weight = np.zeros((2, batch.num_rows), np.int64)
            owner = w.owner()
            for crc, first in run_crcs(w, longest):
                n_features += np.bincount(owner[first], minlength=batch.num_rows)
                upto = np.concatenate([[0], np.cumsum(gain[crc % buckets])])
                edge = np.searchsorted(first, w.first)
                weight += np.diff(upto[edge])
            out = [batch.column(0), *map(pa.array, (w.counts().astype(np.int64), n_features, weight))]
            yield pa.RecordBatch.from_arrays(out, [key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: str | Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise times 1000, rounded down, that a hash of the seed and the id fixes."""
    k = F.col(key) if isinstance(key, str) else key
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def highest_reached(rows: DataFrame, value: Column, want: int, ways: int = WAYS) -> int:
    """The largest integer that the values of at least ``want`` rows reach, by count jobs. There must be so many rows."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        step = -(-(high - low) // ways)
        at = list(range(low + step, high, step)) + [high]
        reached = rows.agg(*[F.count_if(value >= F.lit(t)) for t in at]).first()
        enough = sum(n >= want for n in reached)  # counts fall with the threshold
        low, high = at[enough - 1] if enough else low, at[enough] - 1 if enough < len(at) else high
    return low


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3... in an order without ties: dealt by range, sorted, numbered by partition."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    d = write_table(d.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ranked")
    before, offsets = 0, []
    for r in sorted(d.groupBy("_part").count().collect()):  # one row for each partition
        offsets.append((r[0], before))
        before += r[1]
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    d = d.join(F.broadcast(table), "_part")
    return d.withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    ``key`` is an integer. Drawn are ``percent`` of the documents of at least ``least_words`` words.
    """
    table = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():  # one row for each bucket
        gain[r.bucket] = r.gain
    d = weigh(docs, gain, longest, key, text).withColumn("score", F.col("weight") + noise(key, seed))
    d = write_table(d.withColumn("_row", F.monotonically_increasing_id()), "scores")
    names = [key, "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    able = d.where(F.col("n_words") >= least_words)
    want = able.count() * percent // 100
    if not want:
        return d.select(*names, none)
    score = highest_reached(able, F.col("score"), want)
    above, tied = able.where(F.col("score") > score), able.where(F.col("score") == score)
    # smaller ids are larger here
    turned = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(-(1 << 63)))
    least = highest_reached(tied, turned, want - above.count())
    chosen = (F.col("n_words") >= least_words) & ((F.col("score") > score) | (F.col("score") == score) & (turned >= least))
    order = [F.desc("score"), F.col(key).asc_nulls_last(), F.col("_row").asc()]
    drawn = ranked(d.where(chosen), order)
    # repeated rows at the cut-off may be one too many
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return drawn.select(*names, "rank").unionByName(d.where(~chosen).select(*names, none))
