"""Words of whole Arrow columns as numpy arrays: positions and 64-bit hashes without a Python loop per word.

A word is a run of digits, ASCII letters (A-Z lower-cased) and code points from U+0080 on, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_POW = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAB = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_TAB[0x41:0x5B] = _TAB[0x61:0x7B]
_TAB[~_IS_WORD] = 0
_MIX = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SLICE_BYTES = 1 << 20
_HASH_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each part hold ``most`` bytes at most, or are one text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, at = np.cumsum(size), 0
        while at < n:
            before = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of some texts in order. ``first[i]:first[i + 1]`` are those of text ``i``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


#: tokens between white space: every byte but 20 and 09-0D belongs to one
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[0x20, *range(0x09, 0x0E)]] = False
TOKEN_HASH = np.random.default_rng(20240307).integers(1, 1 << 63, 256, dtype=np.uint64)
TOKEN_HASH[0x41:0x5B] = TOKEN_HASH[0x61:0x7B]
TOKEN_HASH[~TOKEN_BYTES] = 0


def tokens(column: pa.Array) -> Words:
    """Like ``words`` for runs of ``[^\\x20\\x09-\\x0D]+``."""
    return words(column, TOKEN_BYTES, TOKEN_HASH)


def words(column: pa.Array, members: np.ndarray = _IS_WORD, hash_of: np.ndarray = _TAB) -> Words:
    """Words of a column. ``members`` marks the bytes of words, ``hash_of`` has a random number for each of them and 0 for others."""
    data, offsets = raw(column)
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return Words(np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64), data, offsets)
    inside = members[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    opens[edge] = inside[edge]  # a word ends with its text
    closes[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _HASH_BYTES)))
        own = start[at:to] - start[at]
        part = data[start[at] : end[to - 1]]
        gap = np.diff(own, append=len(part))
        place = (np.arange(len(part)) - np.repeat(own, gap)) & 4095
        out[at:to] = np.add.reduceat(hash_of[part] * _POW[place], own)
        at = to
    return Words(first, start, end, mix(out), data, offsets)


def hashes(terms: list[str]) -> np.ndarray:
    """Hashes of single words."""
    w = words(pa.array(terms, pa.string()))
    if not np.all(w.counts() == 1):
        raise ValueError("each term must be one word")
    return w.hash


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, the text of each, and the index of its first word.

    A text of fewer words, but one at least, has one shingle of all its words.
    """
    count = w.counts()
    total = len(w.hash)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([w.hash, np.zeros(n - 1, np.uint64)])
    left = np.repeat(w.first[1:], count) - np.arange(total)  # words from here to the end of the text
    keep = (left >= n) | (np.arange(total) == np.repeat(w.first[:-1], count)) & (np.repeat(count, count) < n)
    h = np.zeros(total, np.uint64)
    for j in range(n):
        h += np.where(left > j, padded[j : j + total] * _MIX[j], np.uint64(0))
    at = np.flatnonzero(keep)
    return mix(h[at]), w.owner()[at], at
