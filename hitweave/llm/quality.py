"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Every text is reduced to ``FEATURES`` numbers. ``cos(W x + b)`` with normal ``W`` approximates a Gaussian kernel on
them; each partition sums its normal equations, the sums are added by row of the matrix, and one small system is
solved. Scores become chances by isotonic regression over ``BINS`` score bins of a fold that the fit has not seen.
All labelled rows take part; what reaches the driver has a fixed size.

Defined cases: null texts count as empty and are scored like others; labels without value or document are left out;
without labels of both kinds every score is 0.5; repeated rows get equal scores; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.llm.columns import unused_prefix
from hitweave.llm.words import mix, raw, shingles, slices, words
from hitweave.session import write_table

FEATURES = (
    "words", "word_length", "long_words", "short_words", "distinct", "repeated", "upper", "digits", "spaces", "lines",
    "line_words", "stops", "marks", "symbols", "other_bytes", "word_bytes", "after_mark", "bars",
)
DIMENSIONS = 256
WIDTH = 3.0
RIDGE = 1.0
BINS = 1024
REJECT = 0.3
SEED = 9


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_UPPER, _DIGIT, _SPACE, _LINE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\r\f\v"), _class("\n")
_STOP, _MARK, _SYMBOL, _BAR = _class(".,;:?"), _class("!\"'()-"), _class("*%$#&@^~<>=+_/\\[]{}"), _class("|")
_OTHER = np.zeros(256, np.uint8)
_OTHER[128:] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """Texts x ``FEATURES``."""
    w = words(column)
    n = len(column)
    size = np.diff(w.offsets)
    count, owner, length = w.counts(), w.owner(), w.end - w.start

    def per_text(table: np.ndarray) -> np.ndarray:
        run = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(table[w.data], dtype=np.int64, out=run[1:])
        return np.diff(run[w.offsets])

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n)

    def distinct(text: np.ndarray, h: np.ndarray) -> np.ndarray:
        key = mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        return np.bincount(text[at], minlength=n)

    h5, text5, _ = shingles(w)
    total5 = np.bincount(text5, minlength=n)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    lines = per_text(_LINE) + 1
    marked = np.zeros(len(owner), bool)
    inside = w.end < len(w.data)
    marked[inside] = (_SYMBOL + _MARK)[w.data[w.end[inside]]] > 0
    columns = [
        np.log1p(count), of_words(length) / some, of_words(length > 12) / some, of_words(length <= 3) / some,
        distinct(owner, w.hash) / some, 1 - distinct(text5, h5) / np.maximum(total5, 1), per_text(_UPPER) / bytes_,
        per_text(_DIGIT) / bytes_, per_text(_SPACE) / bytes_, np.log1p(lines), np.log1p(count / lines), per_text(_STOP) / some,
        per_text(_MARK) / some, per_text(_SYMBOL) / some, per_text(_OTHER) / bytes_, of_words(length) / bytes_,
        of_words(marked) / some, per_text(_BAR) / some,
    ]
    return np.column_stack(columns).astype(np.float64)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the array ``x`` of statistics for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = statistics(batch.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], [key, "x"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, x array<double>")


def fold(key: str | Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(k.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], DIMENSIONS)) / WIDTH
        b = rng.uniform(0, 2 * np.pi, DIMENSIONS)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / DIMENSIONS), np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.values is None:
            return np.full(len(x), 0.5)
        return np.round(np.interp(self.margin(x), self.knots, self.values), 6)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _normal_equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.lift(_matrix(batch.column(0)))
                total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        rows = [pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["i", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    s = np.sum([np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist()], axis=0)
    return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([s.tobytes()], pa.binary())})


def isotonic(count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing chances of bins in order: pools of neighbours that violate the order share their mean."""
    pools: list[list[float]] = []
    for i, (n, k) in enumerate(zip(count, ones, strict=True)):
        pools.append([n, k, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n1, k1, w1 = pools.pop()
            pools[-1] = [pools[-1][0] + n1, pools[-1][1] + k1, pools[-1][2] + w1]
    return np.concatenate([np.full(int(w), k / n) for n, k, w in pools])


def fit(x: DataFrame, labels: DataFrame, folds: int = 5, key: str = "doc_id") -> Model:
    """Learn from the labelled rows outside fold 0: the last fold calibrates, the others set the weights.

    ``labels`` has ``key, y``.
    """
    y = labels.where(F.col("y").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg("y").cast("double").alias("y"))
    rows = x.join(y, key).withColumn("fold", fold(key, folds)).where("fold <> 0").select("x", "y", "fold")
    rows = write_table(rows, "labelled")
    learn, check = rows.where(F.col("fold") != folds - 1), rows.where(F.col("fold") == folds - 1)
    n = len(FEATURES)
    stats = [f(F.col("x")[i]) for i in range(n) for f in (F.avg, F.stddev_pop)]
    got = learn.agg(F.count("*"), F.min("y"), F.max("y"), *stats).first()
    if not got[0] or got[1] == got[2]:
        return Model(np.zeros(n), np.ones(n))
    model = Model(np.array(got[3::2], float), np.maximum(np.array(got[4::2], float), 1e-6))
    parts = learn.select("x", "y").mapInArrow(_normal_equations(model), "i int, sums binary")
    sums = parts.groupBy("i").applyInArrow(_add, "i int, sums binary").collect()  # one row for each dimension
    m = np.array([np.frombuffer(r.sums, np.float64) for r in sorted(sums, key=lambda r: r.i)])
    a = m[:, :-1] + RIDGE * np.eye(len(m))
    model.weights = np.linalg.solve(a, m[:, -1])
    bin_of = F.floor((F.col("m") + 0.5) / 2.0 * (BINS - 1))
    seen = margins(check, model).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("k"), F.avg("m").alias("m"))
    hist = sorted((r.b, r.n, r.k, r.m) for r in seen.collect())  # BINS rows at most
    if hist:
        _, n_, k, at = (np.array(c, float) for c in zip(*hist, strict=True))
        # one row of either kind at the ends keeps chances off 0 and 1
        n_, k = np.concatenate([[1], n_, [1]]), np.concatenate([[0], k, [1]])
        model.knots, model.values = at, isotonic(n_, k)[1:-1]
    return model


def margins(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.margin(_matrix(batch.column(0)))), batch.column(1)], ["m", "y"])

    return rows.select("x", "y").mapInArrow(run, "m double, y double")


def score_features(x: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], [key, "score"])

    return x.select(key, "x").mapInArrow(run, f"`{key}` {x.schema[key].dataType.simpleString()}, score double")


def score_texts(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of the documents and their score, in one pass without a shuffle. ``out`` must be a new name."""
    names = [*docs.columns, out]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            s = pa.array(model.score(statistics(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, s], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").alias("y"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` of every document."""
    x = write_table(features(docs), "statistics")
    return score_features(x, fit(x, quality_labels(labels)))


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents whose score is not below ``reject``."""
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    x = features(docs.select("doc_id", "text"))
    model = fit(x.join(known, "doc_id", "left_semi"), quality_labels(labels))
    score = unused_prefix(docs) + "score"
    return score_texts(docs, model, out=score).where(F.col(score) >= reject).drop(score)
