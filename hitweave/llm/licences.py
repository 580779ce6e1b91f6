"""Licence scan by a positional index of rare words.

Licence notices are templates: their words with positions, a label, and key phrases that must be there. The document
frequency of every licence word is counted over all texts. In each text the occurrences of its ``RARE`` highest-IDF
licence words, and of each template's rarest key word, are looked up in the template postings; postings that agree on
the place where the template would begin are an alignment. It counts if all key phrases stand there, give or take
``DRIFT`` words. A template cannot be verified without the rarest word of its key phrases, so texts without any such
word need no further look, and every occurrence of it is looked up: no place is missed.

Base phrases are templates that are their own key phrase and allow no drift.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; repeated rows get equal results;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import hashes, slices, words

RARE = 8
DRIFT = 3
LEAST = 0.5

# fixed values: phrases and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# fixed values: notices of public licences, their labels and the phrases that must occur
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ("gnu lesser general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "this software and associated documentation files")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc0-1.0", "released under cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use in source and binary forms", "with or without modification")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[tuple[int, list[str]]]
    base: bool


def templates(notices=NOTICES, base=BASE) -> list[Template]:
    out = [Template(label, p.split(), [(0, p.split())], True) for p, label in base.items()]
    for label, text, phrases in notices:
        w, keys = text.split(), []
        for p in map(str.split, phrases):
            keys.append((next(i for i in range(len(w)) if w[i : i + len(p)] == p), p))
        out.append(Template(label, w, keys, False))
    return out


class Index:
    """Postings of all templates, by term number; terms are sorted by hash."""

    def __init__(self, of: list[Template]):
        self.templates = of
        terms = sorted({x for t in of for x in t.words})
        h = hashes(terms)
        order = np.argsort(h)
        self.hash = h[order]
        number = {terms[j]: i for i, j in enumerate(order)}
        self.words = [[number[x] for x in t.words] for t in of]
        self.keys = [[(at, [number[x] for x in p]) for at, p in t.keys] for t in of]
        self.postings = defaultdict(list)
        for t, w in enumerate(self.words):
            for at, x in enumerate(w):
                self.postings[x].append((t, at))
        self.idf = np.ones(len(terms))
        self.anchor = np.zeros(len(terms), bool)

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for others."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def weigh(self, df: np.ndarray, texts: int) -> None:
        self.idf = np.log(1 + (texts - df + 0.5) / (df + 0.5))
        for keys in self.keys:
            self.anchor[max((x for _, p in keys for x in p), key=lambda x: (self.idf[x], x))] = True


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> tuple[np.ndarray, int]:
    """Texts that hold each licence word, over all texts, and the number of texts."""
    n = len(index.hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(n, np.int64), 0
        for batch in slices(batches, text):
            w = words(batch.column(0))
            t = index.terms(w.hash)
            hit = t >= 0
            df += np.bincount(np.unique(w.owner()[hit] * n + t[hit]) % n, minlength=n)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array([*df, rows], pa.int64())], ["term", "df"])

    got = docs.select(text).mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(n + 1)
    for r in got:  # one row for each licence word
        df[r.term] = r.df
    return df[:n], int(df[n])


def _scan(t: np.ndarray, index: Index) -> tuple[list[int], set[str], set[str], float]:
    """Places of base phrases, base labels, all labels and the best score of one text."""
    where = np.flatnonzero(t >= 0)
    own = t[where]
    seen = np.unique(own)
    use = index.anchor.copy()
    use[seen[np.argsort(-index.idf[seen], kind="stable")[:RARE]]] = True
    votes: dict[tuple[int, int], float] = defaultdict(float)
    for at, x in zip(where[use[own]].tolist(), own[use[own]].tolist(), strict=True):
        for k, offset in index.postings[x]:
            votes[k, at - offset] += index.idf[x]

    def stands(at: int, phrase: list[int]) -> bool:
        return at >= 0 and at + len(phrase) <= len(t) and t[at : at + len(phrase)].tolist() == phrase

    places: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    score = 0.0
    for k, begin in votes:
        tpl, w = index.templates[k], index.words[k]
        if tpl.base:
            if stands(begin, w):
                places.append(begin)
                base_labels.add(tpl.label)
                score = max(score, LEAST)
            continue
        if not all(any(stands(begin + at + d, p) for d in range(-DRIFT, DRIFT + 1)) for at, p in index.keys[k]):
            continue
        total = got = 0.0
        for at, x in enumerate(w):
            near = t[max(0, begin + at - DRIFT) : max(0, begin + at + DRIFT + 1)]
            total += index.idf[x]
            got += index.idf[x] * bool((near == x).any())
        if got >= LEAST * total:
            labels.add(tpl.label)
            score = max(score, got / total)
    return places, base_labels, labels | base_labels, min(1.0, round(score, 6))


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", of: list[Template] | None = None) -> DataFrame:
    """One row for each text: number of words, places of base phrases, labels, score."""
    index = Index(of or templates())
    index.weigh(*document_frequencies(docs, index, text))
    names = [key, *(x.split()[0] for x in RESULT.split(", "))]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            w = words(batch.column(1))
            t = index.terms(w.hash)
            count = w.counts()
            rows = [(int(c), 0, None, None, "", "", 0.0) for c in count]
            hit = np.flatnonzero((t >= 0) & index.anchor[t])
            for i in np.unique(np.searchsorted(w.first, hit, "right") - 1).tolist():
                places, base_labels, labels, score = _scan(t[w.first[i] : w.first[i + 1]], index)
                ends = (min(places), max(places)) if places else (None, None)
                rows[i] = (int(count[i]), len(places), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {RESULT}")
