"""Language-model scoring: class-based bigrams with classes from exchange clustering, and exact word counts.

Tokens are runs between white space, A-Z lower-cased, and one end for each text. All training tokens are counted, by a
64-bit hash. The ``HEAD`` most frequent tokens at most are units of the clustering, each rarer one belongs to the unit of
its spelling (a hash of its last two bytes, ``SPELLINGS`` units), and the end is a unit. So every token of every text counts
in the bigrams of units, whose number is bounded by the square of the units, not by the corpus.

Exchange clustering starts with units dealt round by frequency. In each round every unit of a sixteenth moves to the class
that raises the likelihood of the class bigrams most, given the classes of all others; units are rows with their
neighbours' counts, so a round is a scan of one small table. Only class matrices and new classes reach the driver.

``P(token | before) = P(class | class before) P(unit | class) P(token | unit)``, each smoothed, the last for spelling units
alone: ``(c + 1) / (tokens + distinct tokens + 1)``, so that all unseen tokens of a spelling share one.

Counts of up to ``KNOWN`` most frequent tokens (all tokens, where there are no more) are sent to the tasks. The others, a
few hundredths of all tokens, leave the scan as rows and are joined with their counts.

Defined cases: null texts are empty and consist of their end; without training texts all counts are 0; repeated rows
count as often as they occur and get equal scores; empty tables give empty results. Columns of other names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import Words, slices, tokens
from hitweave.session import write_table

HEAD = 4096
SPELLINGS = 64
CLASSES = 64
ROUNDS = 48
PARTS = 16
KNOWN = 1 << 20
SMOOTH = 20.0
STEPS = 8
END = np.uint64(0x9E3779B97F4A7C15)


def spelling(w: Words) -> np.ndarray:
    """Number of a token's spelling unit, from its last two bytes."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    lower = lambda b: b + 32 * ((b >= 0x41) & (b <= 0x5A))
    return (lower(last) * 31 + lower(before) * 7) % SPELLINGS


def _with_ends(w: Words, inside: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens with ``end`` behind each text, and where each text begins there."""
    texts = len(w.first) - 1
    out = np.full(len(inside) + texts, end, inside.dtype)
    out[np.arange(len(inside)) + w.owner()] = inside
    return out, w.first + np.arange(texts + 1)


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token, spelling, n`` of all distinct tokens, the end included (spelling -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            w = tokens(batch.column(0))
            h, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            s = spelling(w)[at]
            h, s, n = np.append(h, END), np.append(s, -1), np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s, pa.int32()), pa.array(n)], ["token", "spelling", "n"])

    parts = texts.select(F.col(text).alias(text)).mapInArrow(run, "token long, spelling int, n long")
    # the spelling is a function of the token
    return parts.groupBy("token").agg(F.min("spelling").alias("spelling"), F.sum("n").alias("n"))


def _step(n: str | Column = "n") -> Column:
    return F.floor(F.log2(F.col(n) if isinstance(n, str) else n) * STEPS).cast("int")


def _least_step(steps: list[tuple[int, int]], most: int) -> int:
    """The lowest step of frequency from which on there are ``most`` tokens at most. ``steps``: step, tokens."""
    total, least = 0, max((s for s, _ in steps), default=-1) + 1
    for step, n in sorted(steps, reverse=True):
        total += n
        if total > most:
            break
        least = step
    return least


@dataclass
class Vocabulary:
    """Tokens whose counts all tasks know, by hash; their units (-1: by spelling); totals."""

    token: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    head_n: np.ndarray
    rare_n: np.ndarray
    rare_v: np.ndarray
    total: int
    distinct: int
    ends: int
    least_step: int

    @property
    def units(self) -> int:
        return len(self.head_n) + SPELLINGS + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of tokens, -1 for those not here."""
        if not len(self.token):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        return np.where(self.token[at] == h, at, -1)

    def units_of(self, w: Words, at: np.ndarray) -> np.ndarray:
        by_spelling = len(self.head_n) + spelling(w)
        if not len(self.unit):
            return by_spelling
        own = np.where(at >= 0, self.unit[at], -1)
        return np.where(own >= 0, own, by_spelling)


def vocabulary(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """``counts`` as of ``token_counts``, stored."""
    words = counts.where("spelling >= 0")
    steps = [(r.step, r.v) for r in words.groupBy(_step().alias("step")).agg(F.count("*").alias("v")).collect()]  # 64 * STEPS rows at most
    of_known, of_head = _least_step(steps, known), _least_step(steps, head)
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("spelling") < 0, F.col("n")))).first()
    table = words.where(_step() >= of_known).select("token", "n").toArrow()  # KNOWN rows at most
    token, n = (table.column(c).to_numpy() for c in ("token", "n"))
    token = token.view(np.uint64)
    order = np.argsort(token)
    token, n = token[order], n[order]
    is_head = np.floor(np.log2(np.maximum(n, 1)) * STEPS) >= of_head
    unit = np.full(len(token), -1, np.int32)
    by_count = np.lexsort((token[is_head], -n[is_head]))
    unit[np.flatnonzero(is_head)[by_count]] = np.arange(is_head.sum())
    rare_n, rare_v = np.zeros((2, SPELLINGS), np.int64)
    for r in words.where(_step() < of_head).groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # SPELLINGS rows
        rare_n[r.spelling], rare_v[r.spelling] = r.n, r.v
    return Vocabulary(token, n, unit, n[is_head][by_count], rare_n, rare_v, total[0] or 0, total[1] or 0, total[2] or 0, of_known)


def unit_bigrams(texts: DataFrame, vocab, text: str = "text") -> DataFrame:
    """``i, j, n``: how often unit ``j`` follows unit ``i``; the end also stands before each text.

    ``vocab`` is a broadcast vocabulary. A task sums in one array and gives a row for each pair at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        size = v.units
        total = np.zeros(size * size, np.uint32)
        for batch in slices(batches, text):
            w = tokens(batch.column(0))
            u, _ = _with_ends(w, v.units_of(w, v.find(w.hash)), size - 1)
            code, n = np.unique(np.append(size - 1, u[:-1]) * size + u, return_counts=True)
            total[code] += n.astype(np.uint32)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 18):
            c = some[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c // size, pa.int32()), pa.array(c % size, pa.int32()), pa.array(total[c].astype(np.int64))], ["i", "j", "n"]
            )

    parts = texts.select(F.col(text).alias(text)).mapInArrow(run, "i int, j int, n long")
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"))


def neighbours(bigrams: DataFrame) -> DataFrame:
    """A row for each unit: ``u, before, before_n, after, after_n``, arrays of as many entries as there are units at most."""

    def side(own: str, other: str, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(other).alias("v"), "n")))
        d = bigrams.groupBy(F.col(own).alias("u")).agg(pairs.alias("p"))
        return d.select("u", F.col("p.v").alias(name), F.col("p.n").alias(f"{name}_n"))

    return side("i", "j", "after").join(side("j", "i", "before"), "u")


def _class_counts(ids: pa.Array, n: pa.Array, cls: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: ids, counts, and counts by class."""
    ends = ids.offsets.to_numpy()
    all_ids, all_n = (x.values.to_numpy(zero_copy_only=False) for x in (ids, n))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield all_ids[a:b], all_n[a:b], np.bincount(cls[all_ids[a:b]], all_n[a:b], classes)


def class_matrix(units: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """How often a class follows a class: sums of each task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, classes))
        for batch in batches:
            rows = _class_counts(batch.column(1), batch.column(2), cls, classes)
            for u, (_, _, by_class) in zip(batch.column(0).to_numpy(), rows, strict=True):
                total[cls[u]] += by_class
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["c", "sums"])

    def add(table: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist()], axis=0)
        return pa.table({"c": table.column("c").slice(0, 1), "sums": pa.array([s.tobytes()], pa.binary())})

    parts = units.select("u", "after", "after_n").mapInArrow(run, "c int, sums binary")
    out = np.zeros((classes, classes))
    for r in parts.groupBy("c").applyInArrow(add, "c int, sums binary").collect():  # one row for each class
        out[r.c] = np.frombuffer(r.sums, np.float64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """The part of the class bigrams' log-likelihood that depends on the classes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def gains(m: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, self_n: float) -> np.ndarray:
    """Likelihood for a unit in every class, but for a term that is the same for all.

    ``before`` and ``after`` count the neighbours by class, without the unit itself, which follows itself ``self_n`` times.
    """
    m = m.copy()
    m[own] -= after
    m[:, own] -= before
    m[own, own] -= self_n
    at = np.arange(len(m))
    f = _xlogx(m)
    row, col = _xlogx(m + after) - f, _xlogx(m + before[:, None]) - f
    diagonal = m[at, at]
    both = _xlogx(diagonal + after + before + self_n) - f[at, at]
    inner = row.sum(1) - row[at, at] + col.sum(0) - col[at, at] + both
    # the neighbours' own totals are the same whatever class the unit is in
    out_n, in_n = m.sum(1) + before, m.sum(0) + after
    outer = _xlogx(out_n + after.sum() + self_n) - _xlogx(out_n) + _xlogx(in_n + before.sum() + self_n) - _xlogx(in_n)
    return inner - outer


def moves(units: DataFrame, cls: np.ndarray, m: np.ndarray, part: int, parts: int) -> DataFrame:
    """``u, c``: the units of a part that have a better class, and which. The last class belongs to the end alone."""
    classes, end = len(m), len(cls) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = _class_counts(batch.column(1), batch.column(2), cls, classes)
            before = _class_counts(batch.column(3), batch.column(4), cls, classes)
            found = []
            for u, (ids, n, right), (_, _, left) in zip(batch.column(0).to_numpy(), after, before, strict=True):
                if u == end:
                    continue
                self_n, own = float(n[ids == u].sum()), cls[u]
                right[own] -= self_n
                left[own] -= self_n
                gain = gains(m, own, left, right, self_n)[:-1]
                best = int(np.argmax(gain))
                if gain[best] > gain[own] + 1e-6:
                    found.append((u, best))
            us, cs = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int32()), pa.array(cs, pa.int32())], ["u", "c"])

    turn = units.where(F.col("u") % parts == part)
    return turn.select("u", "after", "after_n", "before", "before_n").mapInArrow(run, "u int, c int")


def exchange(units: DataFrame, n_units: int, classes: int = CLASSES, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units, and the class matrix. A round that lowers the likelihood is taken back."""
    cls = (np.arange(n_units) % (classes - 1)).astype(np.int64)
    cls[-1] = classes - 1
    m = class_matrix(units, cls, classes)
    still = 0
    for k in range(rounds):
        new = cls.copy()
        for r in moves(units, cls, m, k % parts, parts).collect():  # one row for each unit at most
            new[r.u] = r.c
        to = class_matrix(units, new, classes) if (new != cls).any() else m
        better = likelihood(to) > likelihood(m)
        still = 0 if better else still + 1
        if better:
            cls, m = new, to
        if still >= parts:
            break
    return cls, m


@dataclass
class Model:
    vocab: Vocabulary
    cls: np.ndarray
    step: np.ndarray  # log10 of class transitions
    emit: np.ndarray  # log10 of a unit in its class, and for spelling units of a token that occurs never

    def score(self, w: Words, at: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, but for ``log10(c + 1)`` of the tokens of spelling units."""
        u, first = _with_ends(w, self.vocab.units_of(w, at), self.vocab.units - 1)
        c = self.cls[u]
        p = self.step[np.append(self.cls[-1], c[:-1]), c] + self.emit[u]
        upto = np.concatenate([[0.0], np.cumsum(p)])
        return np.diff(upto[first])


def build(vocab: Vocabulary, cls: np.ndarray, m: np.ndarray) -> Model:
    of_class = np.bincount(cls, minlength=len(m))
    some = of_class > 0  # a class without units has no chance
    prior = (m.sum(0) + some) / (m.sum() + some.sum())
    step = np.log10(np.where(some, m + SMOOTH * prior, 1.0) / (m.sum(1, keepdims=True) + SMOOTH))
    n = np.concatenate([vocab.head_n, vocab.rare_n, [vocab.ends]]).astype(float)
    size = np.bincount(cls, n, len(m))
    emit = np.log10((n + 1) / (size + of_class)[cls])
    emit[len(vocab.head_n) : -1] -= np.log10(vocab.rare_n + vocab.rare_v + 1)
    return Model(vocab, cls, step, emit)


def fit(training: DataFrame, text: str = "text", head: int = HEAD, known: int = KNOWN, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of these texts, and their stored token counts."""
    counts = write_table(token_counts(training, text), "lm-counts")
    vocab = vocabulary(counts, head, known)
    sent = training.sparkSession.sparkContext.broadcast(vocab)
    bigrams = write_table(unit_bigrams(training, sent, text), "lm-bigrams")  # both sides read them
    units = write_table(neighbours(bigrams), "lm-units")
    cls, m = exchange(units, vocab.units, classes, rounds)
    return build(vocab, cls, m), counts


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every document.

    ``base_score`` is that of single tokens with one added to each count, ``score`` the model's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        v, of_end = m.vocab, math.log10(m.vocab.ends + 1)
        n_head = len(v.head_n)
        log_n = np.append(np.log10(v.n + 1.0), 0.0)  # the last for those not known here
        for batch in slices(batches, text):
            w = tokens(batch.column(1))
            owner, rows = w.owner(), batch.num_rows
            at = v.find(w.hash)
            there = at >= 0
            by_count = log_n[at]
            in_spelling = by_count * (v.units_of(w, at) >= n_head)
            base = np.bincount(owner, by_count, rows) + of_end
            score = m.score(w, at) + np.bincount(owner, in_spelling, rows)
            known = np.bincount(owner, there, rows).astype(np.int64) + (v.ends > 0)
            gone, count = w.hash[~there], np.bincount(owner[~there], minlength=rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            rest = pa.ListArray.from_arrays(offsets, pa.array(gone.view(np.int64)))
            out = [batch.column(0), *map(pa.array, (w.counts() + 1, known, base, score)), rest]
            yield pa.RecordBatch.from_arrays(out, [key, "n_tokens", "n_known", "base", "score", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, base double, score double, rest array<long>")
    d = write_table(d.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")
    # tokens whose counts are not sent; those of no training text add log10(1)
    rest = d.select("_row", F.explode("rest").alias("token")).groupBy("_row", "token").agg(F.count("*").alias("tf"))
    few = counts.where((F.col("spelling") >= 0) & (_step() < model.vocab.least_step)).select("token", "n")
    found = rest.join(few, "token").groupBy("_row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("_more"), F.sum("tf").alias("_known"))
    d = d.drop("rest").join(found, "_row", "left").na.fill(0, ["_more", "_known"])
    n, each = F.col("n_tokens"), math.log10(model.vocab.total + model.vocab.distinct + 1)
    return d.select(
        key, "n_tokens", (F.col("n_known") + F.col("_known")).alias("n_known"), F.lit(model.vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("_more") - n * each).alias("base_score"), (F.col("score") + F.col("_more")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_scores(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores of all documents by the model of those for which ``training`` holds."""
    model, counts = fit(docs.where(training), text, **options)
    return score_texts(docs, model, counts, key, text)
