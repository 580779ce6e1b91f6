"""Personal data by a skip-chain conditional random field.

Regular expressions with checks give the base spans (e-mail, IP address, card, phone). The field's nodes are these spans
and candidates that no expression accepts: numbers of 7 to 19 digits, and words equal (but for the case of ASCII letters)
to the name part of an address that the text holds, if that has more than ``SHORT_NAME`` characters and not letters alone,
which an ordinary word has too. Neighbours in the text are joined by chain edges; nodes with equal digits, equal last digits or equal
names, however far apart, are joined by skip edges to the first base span among them, or else to the first node. Loopy
belief propagation (``ROUNDS`` damped rounds) lets linked nodes agree over the whole text; base spans keep their label.
A candidate whose most probable label is a kind of personal data, with ``LEAST`` or more, is added as a span.

Potentials are trained by pseudo-likelihood on the first ``SAMPLE_NODES`` nodes of ``SAMPLE`` different rows at most, the
least by a hash of id and nodes: base
spans have their kind, candidates without a link to a base span have none, and linked candidates, whose label is
unknown, take no part. Skip edges add ``SKIP_PRIOR`` to the learnt weight.

Positions count code points, ends are exclusive. Defined cases: null texts count as empty; texts without spans have
counts 0 and the hash of the empty string; repeated rows get equal results; a table without nodes trains nothing; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.words import slices
from hitweave.session import write_table

# fixed values: kinds in order, and their expressions
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# a match never ends inside a run of digits, so it never begins inside one
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile(r"\(?[0-9][0-9().\x20-]{4,}[0-9]")
# all that could be the name part of an address, but does not stand before a domain
NAME = re.compile(r"[A-Za-z0-9._%+-]++(?!@)")
TRIGGER = re.compile(r"[0-9@]")
LABELS = 5
SAMPLE = 20000
SAMPLE_NODES = 64
SHORT_NAME = 3
ROUNDS = 12
DAMPING = 0.5
LEAST = 0.5
SKIP_PRIOR = 4.0
BOUND = 2.5
CLAMP = 12.0
LAST = 8
BITS = 26


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: all local characters before an ``@``, back to the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if begin < at else None
        last = m.end() if m else at + 1
        if m:
            yield begin, last
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of all base spans in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big") + 1 if s else 0


def _bits(part: str, number: str, before: str, handle: bool) -> int:
    """Features of a node as a set of bits."""
    n, dots = len(number), part.count(".")
    edges = (7, 9, 10, 11, 12, 13, 14, 16, 17, 20)
    on = [next((i for i, e in enumerate(edges) if n < e), 10)]  # 0 to 10: number of digits
    on += [11] * part.startswith("+") + [12] * ("(" in part) + [13] * ("-" in part) + [14] * (" " in part)
    on.append(15 + (0 if dots == 0 else 1 if dots < 3 else 2 if dots == 3 else 3))  # 15 to 18
    on += [19] * (n > 1 and luhn(number)) + [20] * ("@" in part) + [21] * handle + [22] * before.isalpha() + [23] * (before == "+")
    on += [24] * part.isdigit() + [25]
    return sum(1 << i for i in set(on))


def nodes(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """``start, end, label, bits, key, near key`` of all nodes in order; label 0 is a candidate, else a kind + 1."""
    base = base_spans(text)
    out, taken = [], []
    names = set()
    for a, kind, b in base:
        part = text[a:b]
        d = digits(part) if kind else ""
        local = part.split("@")[0].lower() if kind == 0 else ""
        names.add(local if len(local) > SHORT_NAME and not local.isalpha() else "")
        out.append((a, b, kind + 1, _bits(part, d, text[a - 1 : a], False), _hash(d or local), _hash(d[-LAST:] if len(d) > LAST and kind > 1 else "")))
        taken.append((a, b))
    free = [(m.start(), m.end(), False) for m in NUMBER.finditer(text)]
    if names - {""}:
        free += [(m.start(), m.end(), True) for m in NAME.finditer(text) if m[0].lower() in names]
    taken.sort()
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.array([])
    for a, b, handle in free:
        k = int(np.searchsorted(starts, b)) - 1  # spans that begin before b; the furthest end among them
        if k >= 0 and ends[k] > a:
            continue
        part = text[a:b]
        d = "" if handle else digits(part)
        if handle or 7 <= len(d) <= 19:
            key, near = _hash(d or part.lower()), _hash(d[-LAST:] if len(d) > LAST else "")
            out.append((a, b, 0, _bits(part, d, text[a - 1 : a], handle), key, near))
    return sorted(out)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


NODE = "struct<start: long, end: long, label: int, bits: long, key: long, near: long>"
_NODE = pa.list_(pa.struct([(n, pa.int32() if n == "label" else pa.int64()) for n in ("start", "end", "label", "bits", "key", "near")]))
_FIELDS = ("start", "end", "label", "bits", "key", "near")


def find_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the array ``nodes`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for x in batch.column(1):
                t = x.as_py() or ""
                rows.append([dict(zip(_FIELDS, n, strict=True)) for n in nodes(t)] if TRIGGER.search(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _NODE)], [key, "nodes"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, nodes array<{NODE}>")


class Graph:
    """Nodes and edges of several texts."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.count = np.diff(column.offsets.to_numpy())
        self.owner = np.repeat(np.arange(len(column)), self.count)
        self.fields = {n: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, n in enumerate(_FIELDS)}
        n = len(self.owner)
        one = np.arange(n)
        self.x = (self.fields["bits"][:, None] >> np.arange(BITS) & 1).astype(np.float64)
        same = self.owner[1:] == self.owner[:-1]
        self.chain = np.column_stack([one[:-1][same], one[1:][same]])
        pairs = [np.zeros((0, 2), np.int64)]
        for name in ("key", "near"):
            k = self.fields[name]
            # in each group the first base span, or else the first node, is joined to all others
            order = np.lexsort((one, self.fields["label"] == 0, k, self.owner))
            new = np.ones(n, bool)
            new[1:] = (self.owner[order[1:]] != self.owner[order[:-1]]) | (k[order[1:]] != k[order[:-1]])
            hub = order[np.maximum.accumulate(np.where(new, one, 0))] if n else order
            ok = ~new & (k[order] > 0)
            pairs.append(np.column_stack([hub[ok], order[ok]]))
        self.skip = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)


class Field:
    """Potentials: labels by feature, label pairs of chain neighbours, agreement of skip neighbours."""

    def __init__(self):
        self.unary = np.zeros((BITS, LABELS))
        self.unary[:, 0] = 0.1
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = 0.0

    def fit(self, g: Graph, rounds: int = 200) -> None:
        y = g.fields["label"]
        n = len(y)
        linked = np.zeros(n, bool)
        for a, b in (g.skip.T, g.skip.T[::-1]):
            linked[a[(y[b] > 0) & (y[a] == 0)]] = True
        use = ~linked
        if not use.any():
            return
        one_hot = np.eye(LABELS)[y]
        before, after, agree = np.zeros((n, LABELS)), np.zeros((n, LABELS)), np.zeros((n, LABELS))
        a, b = g.chain.T
        before[b], after[a] = one_hot[a], one_hot[b]
        a, b = g.skip.T
        np.add.at(agree, a, one_hot[b])
        np.add.at(agree, b, one_hot[a])
        x, before, after, agree, t = g.x[use], before[use], after[use], agree[use], one_hot[use]
        theta = [self.unary, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for step in range(1, rounds + 1):
            z = x @ theta[0] + before @ theta[1] + after @ theta[2] + agree * theta[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (t - p / p.sum(axis=1, keepdims=True)) / len(t)
            grads = [x.T @ d, before.T @ d, after.T @ d, np.array([(agree * d).sum()])]
            for i, g_i in enumerate(grads):
                g_i = g_i - 1e-3 * theta[i]
                first[i] = 0.9 * first[i] + 0.1 * g_i
                second[i] = 0.999 * second[i] + 0.001 * g_i**2
                theta[i] = theta[i] + 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.unary, self.chain, self.skip = theta[0], (theta[1] + theta[2].T) / 2, float(max(0.0, theta[3][0]))

    def marginals(self, g: Graph) -> np.ndarray:
        """Label chances of all nodes by loopy belief propagation."""
        y = g.fields["label"]
        n = len(y)
        own = g.x @ self.unary
        own = np.clip(own - own.mean(axis=1, keepdims=True), -BOUND, BOUND)
        own[y > 0] += CLAMP * np.eye(LABELS)[y[y > 0]]
        agree = (self.skip + SKIP_PRIOR) * np.eye(LABELS)
        source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        target = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        c, s = len(g.chain), len(g.skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        message = np.zeros((len(source), LABELS))
        open_ = (y == 0).astype(np.float64)  # what is observed hears nothing

        def belief() -> np.ndarray:
            return own + open_[:, None] * np.column_stack([np.bincount(target, message[:, k], n) for k in range(LABELS)])

        for _ in range(ROUNDS if len(source) else 0):
            out = belief()[source] - open_[source, None] * message[back]
            new = np.empty_like(message)
            for part, pair in ((slice(0, c), self.chain), (slice(c, 2 * c), self.chain.T), (slice(2 * c, None), agree)):
                z = out[part][:, :, None] + pair[None]
                top = z.max(axis=1, keepdims=True)
                new[part] = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            new -= new.mean(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        b = belief()
        p = np.exp(b - b.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(found: DataFrame, key: str = "doc_id") -> Field:
    field = Field()
    some = found.where(F.size("nodes") > 0).select(F.slice("nodes", 1, SAMPLE_NODES).alias("nodes"), F.xxhash64(F.lit(10), key, "nodes").alias("h"))
    n = some.agg(F.approx_count_distinct("h").alias("n")).first().n
    if n:
        # about twice as many rows as wanted are dealt by hash and sorted; repeated rows count once
        share = F.pmod("h", F.lit(1 << 20)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 20)) + 1
        rows = some.where(share).groupBy("h").agg(F.first("nodes").alias("nodes")).orderBy("h").limit(SAMPLE)
        field.fit(Graph(rows.select("nodes").toArrow().column(0).combine_chunks()))
    return field


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def label_nodes(found: DataFrame, field: Field, key: str = "doc_id") -> DataFrame:
    names = [key, *(x.split()[0] for x in RESULT.split(", "))]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g = Graph(batch.column(1))
            p = field.marginals(g)
            label = g.fields["label"]
            best = np.where(label > 0, label, np.where(p.max(axis=1) >= LEAST, p.argmax(axis=1), 0)) if len(p) else label
            rows, at = [], 0
            for n in g.count.tolist():
                start, end, was, now = (v[at : at + n].tolist() for v in (g.fields["start"], g.fields["end"], label, best))
                at += n
                base = [(a, w - 1, b) for a, b, w in zip(start, end, was, strict=True) if w]
                every = [(a, w - 1, b) for a, b, w in zip(start, end, now, strict=True) if w]
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    kind = found.schema[key].dataType.simpleString()
    return found.select(key, "nodes").mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every document: ``doc_id``, counts of base spans, their hash, all spans, and how many were added."""
    found = write_table(find_nodes(docs), "nodes")
    return label_nodes(found, train(found))
