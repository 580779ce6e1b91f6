"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage of every document.

Passages are runs of ``PASSAGE`` words, one every half passage. A passage's distinct words are the query; an item's
BM25 score is divided by the score it gets from its own words (for items longer than ``COVERED`` words, from the part
that a passage can hold), so one threshold fits all items. All items at or above the threshold are retrieved by
block-max WAND: lists are moved to the first item whose list maxima reach the threshold, and blocks whose maxima do not
reach it are skipped. Items are numbered by length, so that items of one block have like maxima. Two tests of the search
are done for all passages of a batch at once: whether the maxima of all lists reach the threshold, and whether their
maxima in any of ``STRIPES`` ranges of items do. Few passages are left after them.

What is retrieved is verified on the text around the passage: the runs of ``GRAM`` words of the item's question and of
its answer must occur there to a share of ``OVERLAP`` each. The first sentence of an item is its question, the rest its
answer; an item of one sentence has a question only.

The index is sent to all tasks, so its size is checked: items are split by hash into as many indexes as their bytes
need, one that is built larger than ``INDEX_BYTES`` is halved, and documents are read once for each of them. An index is
a few flat arrays, so tasks hold about as much as its bytes.

Defined cases: null and empty items are never found, null and empty documents hold nothing; an item of fewer than ``GRAM``
words is found where its words stand together in order, so one of a single word in every document with this word; equal items are each found;
upper and lower case are equal for all letters; repeated documents give equal rows; empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import Words, shingles, slices, words

PASSAGE = 64
STEP = PASSAGE // 2
COVERED = 48
K1, B = 1.2, 0.75
THRESHOLD = 0.5
GRAM = 3
OVERLAP = 0.6
POSTING_BLOCK = 32
STRIPES = 64
STRIPE_LEAST = 4
INDEX_BYTES = 128 << 20
#: bytes of an index for a byte of text, about
GROWTH = 8
_SENTENCE = re.compile(r".*?[.!?。](?=\s|$)", re.S)


def lower_words(column: pa.Array) -> Words:
    return words(pc.utf8_lower(column))


def question_and_answer(text: str) -> tuple[str, str]:
    """The first sentences that have ``GRAM`` words together, and the rest if it has as many; else all and nothing."""
    at, enough = 0, re.compile(rf"(?:\w+\W+){{{GRAM - 1}}}\w")
    while m := _SENTENCE.match(text, at):
        at = m.end()
        if enough.search(text, 0, at):
            return (text[:at], text[at:]) if enough.search(text, at) else (text, "")
    return text, ""


@dataclass
class Posting:
    items: np.ndarray
    scores: np.ndarray
    most: float
    block_most: np.ndarray
    block_last: np.ndarray


@dataclass
class Lists:
    """Lists of equal fields, end to end in arrays; ``first[i]:first[i + 1]`` is list ``i``."""

    first: np.ndarray
    values: list[np.ndarray]

    def of(self, i: int) -> list[np.ndarray]:
        return [v[self.first[i] : self.first[i + 1]] for v in self.values]


def _lists(owner: np.ndarray, n: int, *values: np.ndarray) -> Lists:
    """Lists from sorted owners."""
    return Lists(np.searchsorted(owner, np.arange(n + 1)), list(values))


class Index:
    """Postings, their block maxima, range maxima and the items' runs, in a few flat arrays."""

    def __init__(self, ids: pa.Array | list, texts: list[str | None]):
        order = np.argsort([len((t or "").split()) for t in texts], kind="stable").tolist()
        self.ids = (pa.array(ids) if isinstance(ids, list) else ids).take(pa.array(order, pa.int64()))
        texts = [texts[i] for i in order]
        parts = [question_and_answer(t or "") for t in texts]
        w = lower_words(pa.array([t or "" for t in texts], pa.string()))
        self.length = w.counts()
        n, owner = len(texts), w.owner()
        self.terms, term = np.unique(w.hash, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + owner, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = max(1.0, self.length.mean()) if n else 1.0
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[item] / mean))
        own = np.bincount(item, score, n) * np.minimum(1, COVERED / np.maximum(self.length, 1))
        score = score / np.maximum(own[item], 1e-9)
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, term, score)
        self.postings = _lists(term, len(self.terms), item.astype(np.int32), score)
        # blocks begin anew with each list
        place = np.arange(len(term)) - self.postings.first[term]
        begin = np.flatnonzero(place % POSTING_BLOCK == 0)
        end = np.append(begin[1:], len(term)) if len(begin) else begin
        most = np.maximum.reduceat(score, begin) if len(begin) else score
        self.blocks = _lists(term[begin], len(self.terms), most, item[end - 1].astype(np.int32))
        # maxima in ranges of items, where a list has any
        wide = max(STRIPE_LEAST, -(-n // STRIPES))
        self.n_stripes = max(1, -(-n // wide))
        cell, at = np.unique(term * self.n_stripes + item // wide, return_index=True)
        best = np.maximum.reduceat(score, at).astype(np.float32) * np.float32(1 + 1e-6) if len(at) else score.astype(np.float32)
        self.stripes = _lists(cell // self.n_stripes, len(self.terms), (cell % self.n_stripes).astype(np.uint8), best)
        # runs of GRAM words of question and answer; of all its words, if an item has fewer
        self.grams, self.gram = [], []
        for side in (0, 1):
            ws = lower_words(pa.array([p[side] for p in parts], pa.string()))
            h, of, _ = shingles(ws, GRAM)
            unique = np.unique(np.rec.fromarrays([of, h])) if len(h) else np.rec.fromarrays([of, h])
            self.grams.append(_lists(unique.f0, n, unique.f1.copy()))
            self.gram.append(np.clip(ws.counts(), 1, GRAM))

    def nbytes(self) -> int:
        lists = [self.postings, self.blocks, self.stripes, *self.grams]
        arrays = [self.terms, self.most, self.length, *self.gram, *(x.first for x in lists), *(v for x in lists for v in x.values)]
        return sum(a.nbytes for a in arrays) + self.ids.nbytes

    def find(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Items whose score for the distinct query terms is ``least`` or more, by block-max WAND."""
        lists = [Posting(*self.postings.of(t), float(self.most[t]), *self.blocks.of(t)) for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while live:
            live.sort(key=lambda x: lists[x].items[at[x]])
            total, pivot = 0.0, -1
            for k, x in enumerate(live):
                total += lists[x].most
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = int(lists[live[pivot]].items[at[live[pivot]]])
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            bound, stop = 0.0, int(lists[live[pivot + 1]].items[at[live[pivot + 1]]]) if pivot + 1 < len(live) else len(self.ids)
            for x in live[: pivot + 1]:
                p = lists[x]
                b = bisect_left(p.block_last, item, at[x] // POSTING_BLOCK)
                if b < len(p.block_last):
                    bound += float(p.block_most[b])
                    stop = min(stop, int(p.block_last[b]) + 1)
            if bound < least:
                to = max(stop, item + 1)  # no item before it can reach the threshold
            elif lists[live[0]].items[at[live[0]]] == item:
                score = sum(float(lists[x].scores[at[x]]) for x in live[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for x in live[: pivot + 1]:
                at[x] = bisect_left(lists[x].items, to, at[x])
            live = [x for x in live if at[x] < len(lists[x].items)]
        return found


def _range_bounds(index: Index, term: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """For each passage the largest sum of its terms' maxima in one range of items."""
    begin, size = index.stripes.first[term], np.diff(index.stripes.first)[term]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    stripe, most = index.stripes.values
    cell = np.repeat(passage, size) * index.n_stripes + stripe[at]
    n = int(passage[-1]) + 1
    return np.bincount(cell, most[at], n * index.n_stripes).reshape(n, -1).max(axis=1)


def _passages(w: Words, index: Index, least: float) -> Iterator[tuple[int, int, list[int]]]:
    """Text, first word and distinct index terms of each passage whose list maxima reach the threshold."""
    if not len(index.terms) or not len(w.hash):
        return
    at = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hash)
    term, owner = at[known], np.searchsorted(w.first, known, "right") - 1
    half = (known - w.first[owner]) // STEP
    halves = -(-w.counts() // STEP)
    begin = np.concatenate([[0], np.cumsum(halves)])
    sums = np.bincount(begin[owner] + half, index.most[term], begin[-1] + 1)
    last = np.zeros(begin[-1] + 1, bool)  # a text's last half has no successor
    last[begin[1:] - 1] = True
    upper = sums + np.where(last, 0.0, np.concatenate([sums[1:], [0.0]]))
    hot = upper >= least
    # the same with each word once
    key = []
    for back in (0, 1):
        p = begin[owner] + half - back
        ok = (half >= back) & hot[np.maximum(p, 0)]
        key.append(p[ok] * len(index.terms) + term[ok])
    key = np.unique(np.concatenate(key))
    passage, term = key // len(index.terms), key % len(index.terms)
    ok = (np.bincount(passage, index.most[term], begin[-1] + 1) >= least)[passage]
    passage, term = passage[ok], term[ok]
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    for at in range(0, len(first), 4096):
        a, b = first[at], first[at + 4096] if at + 4096 < len(first) else len(passage)
        bound = _range_bounds(index, term[a:b], np.searchsorted(first[at : at + 4096], np.arange(a, b), "right") - 1)
        for k in (np.flatnonzero(bound >= least * (1 - 1e-5)) + at).tolist():
            a, b = first[k], first[k + 1] if k + 1 < len(first) else len(passage)
            p = int(passage[a])
            text = int(np.searchsorted(begin, p, "right")) - 1
            yield text, (p - int(begin[text])) * STEP, term[a:b].tolist()


def matches(column: pa.Array, index: Index, least: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """``text, item, score, question overlap, answer overlap, first word`` of each verified pair of this column."""
    w = lower_words(column)
    found: dict[tuple[int, int], tuple] = {}
    for text, start, terms in _passages(w, index, least):
        for item, score in index.find(terms, least):
            if (old := found.get((text, item))) and old[0] >= score:
                continue
            length = int(index.length[item])
            a, b = w.first[text], w.first[text + 1]
            a, b = max(a, a + start - length), min(b, a + start + PASSAGE + length)
            here = Words(np.array([0, b - a]), w.start[a:b], w.end[a:b], w.hash[a:b], w.data, w.offsets[:2])
            shares = []
            for own, size in zip(index.grams, index.gram, strict=True):
                g = own.of(item)[0]
                shares.append(float(np.isin(g, shingles(here, int(size[item]))[0]).mean()) if len(g) else 1.0)
            question, answer = shares
            if question >= overlap and answer >= overlap:
                found[text, item] = (score, question, answer, start)
    return [(*k, *v) for k, v in sorted(found.items())]


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", most: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of all items, each of at most ``most`` bytes as built, or of one item."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text) + 16), F.lit(0)).alias("n")).first().n
    parts = -(-size // max(1, most // GROWTH)) or 1
    rows = items.select(key, text, F.pmod(F.xxhash64(key, text), F.lit(parts)).alias("part"))
    for p in range(parts):
        got = rows.where(F.col("part") == p).toArrow()  # about most // GROWTH bytes
        todo = [got]
        while todo:
            t = todo.pop()
            index = Index(t.column(0).combine_chunks(), t.column(1).to_pylist())
            if index.nbytes() <= most or t.num_rows < 2:
                yield index
            else:
                todo += [t.slice(0, t.num_rows // 2), t.slice(t.num_rows // 2)]


PAIR = "score double, question_overlap double, answer_overlap double, first_word long"


def contaminated_pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id`` and measures of every document that holds an item."""
    kinds, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for index in indexes(items, most=most):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [key, "item_id", *(x.split()[0] for x in PAIR.split(", "))]
            for batch in slices(batches, text):
                rows = matches(batch.column(1), sent.value)
                if rows:
                    at, item, *values = zip(*rows, strict=True)
                    ids = sent.value.ids.take(pa.array(item))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids, *map(pa.array, values)], names)

        part = docs.select(key, text).mapInArrow(run, f"`{key}` {kinds}, item_id {item_kind}, {PAIR}")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no item, in one pass for each index and without a shuffle."""
    at = docs.columns.index(text)
    for index in indexes(items, most=most):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in matches(batch.column(at), sent.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
