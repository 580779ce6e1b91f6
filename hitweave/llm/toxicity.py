"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

A segment is a word with its punctuation removed (single letters in a row are one segment) after a start mark. The
kernel of two segments counts their common subsequences of ``ORDER`` symbols, gaps allowed, weighted by ``DECAY`` for
each symbol spanned, up to ``SPAN`` symbols; so ``id-i.ot``, ``i d i o t`` and ``idxiot`` stay near ``idiot``.

Training takes ``LABELLED`` labelled texts at most, chosen by hash of the id, so that their labels can be sent to all
tasks and texts are not shuffled. Every labelled sentence passes the label of its text to its segments. Segments are
counted by label over three quarters of these texts; landmarks and training segments (numbers below) are chosen from the counts, and a squared-hinge
machine is fitted in the landmarks' Nystroem space. As the kernel's feature space is small (``SYMBOLS ** ORDER``), the
machine is folded back into one weight for each subsequence, and a text is scored in time linear in its length,
without landmarks. A text's score is a logistic function of its segments' values, fitted on the other quarter.

Defined cases: null texts count as empty and get the score of a text without segments; labels without value or document
are left out; without training labels of both kinds every score is 0; repeated rows get equal scores; empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import raw, slices
from hitweave.session import write_table

ORDER = 3
SPAN = 6
DECAY = 0.7
SYMBOLS = 48
LANDMARKS = 256
SUSPECTS = 3000
COMMON = 8000
OTHERS = 4000
LABELLED = 50000
LEAST_Z = 3.0
RIDGE = 1e-3
TOXIC = 0.7
_FLUSH = 200_000

# symbols of bytes: 0 is left out, 255 ends a segment; digits stand for letters that look like them
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 255
_SYMBOL[97:123] = np.arange(2, 28)
for _digit, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}.items():
    _SYMBOL[ord(_digit)] = _SYMBOL[ord(_letter)]
_SYMBOL[0x80:0xC0] = 28 + np.arange(64) % 20
_MARKS = re.compile(r"[^\w\s]|_")
_START = 1


@dataclass
class Segments:
    """Symbols of all segments, each after a start mark. ``first`` and ``text`` are by segment."""

    symbols: np.ndarray
    of: np.ndarray
    first: np.ndarray
    text: np.ndarray


def segments(column: pa.Array) -> Segments:
    data, offsets = raw(pc.utf8_lower(column))
    kind = _SYMBOL[data]
    space = kind == 255
    start = np.zeros(len(data) + 1, bool)
    start[offsets[:-1]] = True
    token = np.cumsum(space | start[:-1])
    at = np.flatnonzero((kind > 0) & ~space)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Segments(np.zeros(0, np.uint8), none, none, none)
    own, text = token[at], np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = own[1:] != own[:-1]
    begin = np.flatnonzero(new)
    single = np.diff(begin, append=len(at)) == 1
    joined = np.zeros(len(begin), bool)
    joined[1:] = single[1:] & single[:-1] & (text[begin[1:]] == text[begin[:-1]])
    begin = begin[~joined]
    new = np.zeros(len(at), bool)
    new[begin] = True
    of = np.cumsum(new) - 1
    symbols = np.full(len(at) + len(begin), _START, np.uint8)
    place = np.arange(len(at)) + of + 1
    symbols[place] = kind[at]
    first = place[begin] - 1
    return Segments(symbols, np.repeat(np.arange(len(begin)), np.diff(first, append=len(symbols))), first, text[begin])


def _norms(most: int) -> np.ndarray:
    """Kernel of a segment of each length with itself, were all its symbols different."""
    n = np.zeros(most + 1)
    for size in range(most + 1):
        n[size] = sum(max(0, size - b) * (b - 1) * DECAY ** (2 * (b + 1)) for b in range(ORDER - 1, SPAN + 1))
    return np.sqrt(np.maximum(n, DECAY ** (2 * ORDER)))


_NORM = _norms(4096)


def subsequences(s: Segments) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For all pairs of gaps: positions where a subsequence begins, its number, and its weight."""
    n = len(s.symbols)
    wide = s.symbols.astype(np.int32)
    for a in range(1, SPAN):
        if n <= a:
            return
        pair = wide[: n - a] * (SYMBOLS * SYMBOLS) + wide[a:] * SYMBOLS
        for b in range(a + 1, SPAN + 1):
            if n <= b:
                break
            at = s.of[: n - b] == s.of[b:]
            yield at, pair[: n - b] + wide[b:], DECAY ** (b + 1)


def values(s: Segments, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of every segment."""
    total = np.zeros(len(s.symbols), np.float32)
    for at, number, decay in subsequences(s):
        total[: len(number)] += weights[number] * (np.float32(decay) * at)
    size = np.diff(s.first, append=len(s.symbols))
    out = np.add.reduceat(total, s.first) if len(s.first) else total
    return out / _NORM[np.minimum(size, len(_NORM) - 1)] + bias


def features(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Texts x 6: what the segments' values say of each text."""
    s = segments(column)
    n = len(column)
    v = np.clip(values(s, weights, bias), -1.5, 1.5)
    count = np.bincount(s.text, minlength=n)
    top = np.full(n, -1.5)
    np.maximum.at(top, s.text, v)
    high = np.bincount(s.text, np.maximum(v - 0.5, 0), n)
    some = np.bincount(s.text, np.maximum(v - 0.25, 0), n)
    many = np.bincount(s.text, v > 0.5, n)
    root = np.sqrt(np.maximum(count, 1))
    return np.column_stack([top, np.log1p(high), np.log1p(many), high / root, some / root, np.log1p(count)])


def _vectors(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Subsequence numbers and normalised weights of single segments."""
    s = segments(pa.array([w if len(w) > 1 else w * 2 for w in words], pa.string()))
    size = np.diff(s.first, append=len(s.symbols))
    number, weight, owner = [], [], []
    for at, k, decay in subsequences(s):
        where = np.flatnonzero(at)
        number.append(k[where])
        owner.append(s.of[where])
        weight.append(np.full(len(where), decay) / _NORM[np.minimum(size[s.of[where]], len(_NORM) - 1)])
    number, weight, owner = map(np.concatenate, (number, weight, owner))
    text = s.text[owner]
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(1, len(words)))
    return np.split(number[order], cuts), np.split(weight[order], cuts)


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    logit: np.ndarray | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.logit is None:
            return np.zeros(len(column))
        return self.chance(features(column, self.weights, self.bias))

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = _expand((x - self.mean) / self.scale) @ self.logit
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)


def _expand(z: np.ndarray) -> np.ndarray:
    return np.hstack([z, z[:, :3] ** 2, z[:, :1] * z[:, 5:6], np.ones((len(z), 1))])


def train_machine(words: list[str], toxic: np.ndarray, clean: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """Fit the squared-hinge machine; ``toxic`` and ``clean`` are the weights of both labels for each segment.

    Returns one weight for each subsequence, and the bias.
    """
    number, weight = _vectors(landmarks)
    used, column = np.unique(np.concatenate(number), return_inverse=True)
    base = np.zeros((len(used), len(landmarks)))
    np.add.at(base, (column, np.repeat(np.arange(len(landmarks)), [len(x) for x in number])), np.concatenate(weight))
    k_mm = base.T @ base
    e, u = np.linalg.eigh(k_mm)
    keep = e > 1e-6 * e.max()
    root = u[:, keep] / np.sqrt(e[keep])
    x = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 1000):
        number, weight = _vectors(words[at : at + 1000])
        for i, (n, w) in enumerate(zip(number, weight, strict=True)):
            p = np.minimum(np.searchsorted(used, n), len(used) - 1)
            ok = used[p] == n
            x[at + i] = w[ok] @ base[p[ok]]
    x = np.hstack([x @ root, np.ones((len(words), 1))])
    # both labels of a segment take part, each with its weight; Newton steps on the active set
    beta, reg = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    reg[-1, -1] = 1e-9
    for _ in range(30):
        f = x @ beta
        a, b = toxic * (f < 1), clean * (f > -1)
        h = x.T @ (x * (a + b)[:, None]) + reg
        new = np.linalg.solve(h, x.T @ (a - b))
        done = np.abs(new - beta).max() < 1e-6
        beta = new
        if done:
            break
    weights = np.zeros(SYMBOLS**ORDER, np.float32)
    weights[used] = base @ (root @ beta[:-1])
    return weights, float(beta[-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a segment."""
    names = ["word", "toxic", "clean"]
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        all_words = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(all_words, pa.string()), *(pa.array([c[w] for w in all_words], pa.int64()) for c in (counts[1], counts[0]))]
        counts[0].clear()
        counts[1].clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in slices(batches, "text"):
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            counts[y.as_py()].update(set(_MARKS.sub("", (text.as_py() or "").lower()).split()))
            if len(counts[0]) + len(counts[1]) > _FLUSH:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels`` (``doc_id, y``): three quarters by a hash of the id train the machine, the rest calibrates."""
    y = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(LABELLED)
    # LABELLED pairs of numbers at most
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    rows = write_table(rows, "labelled")
    learn, check = rows.where("part <> 0"), rows.where("part = 0")
    n = {r.y: r["count"] for r in learn.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    words = learn.select("text", "y").mapInArrow(_count, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p = n[1] / (n[0] + n[1])
    total = F.col("toxic") + F.col("clean")
    words = write_table(words.withColumn("z", (F.col("toxic") - 0.5 - total * p) / F.sqrt(total * p * (1 - p))), "segments")
    suspects = words.where((F.col("toxic") >= 2) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "word").limit(SUSPECTS)
    common = words.orderBy(F.desc(total), "word").limit(COMMON)
    others = words.orderBy(F.xxhash64("word"), "word").limit(OTHERS)
    got = suspects.union(common).union(others).distinct().orderBy("word").toPandas()
    got = got[got.word.str.len() > 1]
    toxic, clean = got.toxic.to_numpy() / n[1], got.clean.to_numpy() / n[0]
    rank = got.sort_values("z", ascending=False).word.tolist()[: LANDMARKS // 2]
    often = [w for w in got.assign(n=got.toxic + got.clean).sort_values("n", ascending=False).word if w not in set(rank)]
    if not rank or not often:
        return Model()
    model = Model(*train_machine(got.word.tolist(), toxic, clean, rank + often[: LANDMARKS // 2]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column(0), model.weights, model.bias)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows, batch.column(1)], ["x", "y"])

    seen = check.select("text", "y").mapInArrow(measure, "x array<double>, y int").toPandas()
    if seen.y.nunique() < 2:
        return model
    x, t = np.stack(seen.x), seen.y.to_numpy()
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = _expand((x - model.mean) / model.scale)
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        c = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (c * (1 - c) + 1e-9)[:, None]) + 0.1 * np.eye(len(beta)), z.T @ (t - c) - 0.1 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    model.logit = beta
    return model


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, score`` of every document; labels of rows for which ``held_out`` is true are never read."""
    y = labels.where(~held_out).select("doc_id", F.col("toxic").alias("y"))
    return score_texts(docs, fit(docs, y))
