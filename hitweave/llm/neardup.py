"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its runs of ``SHINGLE`` words: ``1 + ln`` of the term frequency, times the inverse document
frequency plus ``SMOOTH``, so that a few rare or repeated words do not decide alone. Counting the frequency of every run
would shuffle more than the corpus, so the IDF of a run is the mean of its words', and word frequencies are counted over
all texts in ``DF_BINS`` hash bins (words in one bin share a count).

``SAMPLES`` consistent samples of each set agree with a chance equal to the weighted Jaccard similarity of two sets.
Bands of ``ROWS`` samples are bucket keys. Links are searched in two rounds, without making the pairs of a bucket:

1. the members of each bucket are compared with its most central member; copies of one original meet there, even where
   they differ from each other;
2. members of one bucket that are still in different classes are joined exactly: every pair is compared or ruled out by
   a bound, in pairs of blocks of some ``BLOCK`` runs. No bucket is too large, none of its pairs is left out.

Centrality looks at a sketch beside the samples: the least run of each of ``BINS`` ranges of hashes, which costs nothing
as runs are in the order of their hashes. The most central member is the one that agrees best with the commonest value of
each bin; two texts that few samples tell apart differ there.

Every link is verified by the exact weighted Jaccard similarity of the whole texts. Classes are the connected
components of links, and of equal texts, which are one node from the start.

Defined cases: null texts count as empty; texts without words are in one class only with equal texts; a text of fewer
than five words is one run; repeated rows are in one class; a null id never becomes a class id unless the class has no
other; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.columns import unused_prefix
from hitweave.llm.words import mix, shingles, slices, words
from hitweave.session import write_table

SHINGLE = 5
SIMILAR = 0.8
ROWS = 3
BANDS = 8
SAMPLES = ROWS * BANDS
SMOOTH = 4.0
DF_BINS = 1 << 18
DF_BLOCK = 4096
BINS = 64
BLOCK = 1 << 17
_CHUNK = 1 << 17

_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 1 << 63, (SAMPLES, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# quantiles of the Gamma(2, 1) distribution: sorted draws, the same in every process
_GAMMA = np.sort(-np.log(_rng.random(1 << 20)) - np.log(_rng.random(1 << 20)))[128::256]
_GAMMA_EXP = np.exp(-_GAMMA)
_U64 = np.uint64


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """IDF by hash bin of a word, counted over all texts."""
    blocks = DF_BINS // DF_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DF_BINS, np.int64), 0
        for batch in slices(batches, text):
            w = words(batch.column(0))
            key, owner = w.hash, w.owner().astype(np.uint64)
            _, at = np.unique(mix(key + owner * _U64(0x9E3779B97F4A7C15)), return_index=True)
            df += np.bincount((key[at] & _U64(DF_BINS - 1)).astype(np.int64), minlength=DF_BINS)
            rows += batch.num_rows
        parts = [p.tobytes() for p in df.reshape(blocks, DF_BLOCK)]
        counts = [*parts, np.array([rows], np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(counts, pa.binary())], ["b", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()], axis=0)
        return pa.table({"b": table.column("b").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    got = docs.select(text).mapInArrow(run, "b int, n binary").groupBy("b").applyInArrow(add, "b int, n binary").collect()
    df, rows = np.ones(DF_BINS), 1
    for r in got:  # DF_BINS counts in all
        n = np.frombuffer(r.n, np.int64)
        if r.b == blocks:
            rows = max(1, int(n[0]))
        else:
            df[r.b * DF_BLOCK : (r.b + 1) * DF_BLOCK] = np.maximum(n, 1)
    return np.log1p(rows / df).astype(np.float32)


@dataclass
class Sets:
    """Weighted sets of some texts. ``first[i]:first[i + 1]`` are the runs of text ``i``, each once, of weight ``tf * idf``."""

    first: np.ndarray
    run: np.ndarray
    tf: np.ndarray
    idf: np.ndarray


def weighted_sets(column: pa.Array, idf: np.ndarray) -> Sets:
    w = words(column)
    h, owner, at = shingles(w, SHINGLE)
    n = len(column)
    if not len(h):
        return Sets(np.zeros(n + 1, np.int64), h, np.zeros(0), np.zeros(0))
    each = np.concatenate([[0.0], np.cumsum(idf[(w.hash & _U64(DF_BINS - 1)).astype(np.int64)], dtype=np.float64)])
    to = np.minimum(at + SHINGLE, w.first[1:][owner])
    mean = (each[to] - each[at]) / (to - at)
    # equal runs of a text side by side, texts in order
    order = np.lexsort((h, owner))
    h, owner, mean = h[order], owner[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    tf = 1 + np.log(np.diff(begin, append=len(h)))
    return Sets(np.searchsorted(owner[begin], np.arange(n + 1)), h[begin], tf, mean[begin] + SMOOTH)


def signatures(s: Sets) -> np.ndarray:
    """Consistent samples: texts x ``SAMPLES``, 32 bits each; texts without runs have zeros."""
    n = len(s.first) - 1
    out = np.zeros((n, SAMPLES), np.int32)
    full = np.flatnonzero(np.diff(s.first))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(s.first[full], s.first[full[at]] + _CHUNK)))
        own = full[at:to]
        a, b = s.first[own[0]], s.first[own[-1] + 1]
        out[own] = _sample(s.run[a:b], s.tf[a:b] * s.idf[a:b], s.first[own] - a)
        at = to
    return out


def _sample(run: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Samples of the sets that begin at ``begin``.

    The sample of a set is the run with the least ``a = c exp(-r (t - b + 1))``, where ``t = floor(ln w / r + b)``, with
    ``r, c`` from Gamma(2, 1) and ``b`` uniform, all fixed by the run. As ``c e^-r / w <= a <= c / w``, only runs whose
    lower bound is not above the set's least upper bound can be it; the others' ``t`` is not computed.
    """
    size = np.diff(begin, append=len(run))
    log_w, inverse = np.log(weight), 1 / weight
    out = np.empty((len(begin), SAMPLES), np.int32)
    for k in range(SAMPLES):
        h = run * _ODD[k, 0]
        h ^= h >> _U64(32)
        h *= _ODD[k, 1]
        u = ((h >> _U64(40)).astype(np.float64) + 0.5) * (((h >> _U64(16)) & _U64(0xFFFFFF)).astype(np.float64) + 0.5)
        c = -np.log(u * 2.0**-48)
        upper = c * inverse
        r_at = ((h ^ (h >> _U64(29))) & _U64(0xFFF)).astype(np.int64)
        least = np.minimum.reduceat(upper, begin)
        some = np.flatnonzero(upper * _GAMMA_EXP[r_at] <= np.repeat(least, size))
        x = run[some]
        r = _GAMMA[r_at[some]]
        b = (mix(x * _ODD[k, 2]) >> _U64(11)).astype(np.float64) * 2.0**-53
        t = np.floor(log_w[some] / r + b)
        a = np.log(c[some]) - r * (t - b + 1)
        first = np.searchsorted(some, begin)
        best = np.minimum.reduceat(a, first)
        hit = np.flatnonzero(a == np.repeat(best, np.diff(first, append=len(some))))
        hit = hit[np.searchsorted(hit, first)]
        value = mix(x[hit] + t[hit].astype(np.int64).astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
        out[:, k] = (value & _U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def sketches(s: Sets) -> np.ndarray:
    """16 bits of the least run in each range of hashes: texts x ``BINS``; 0 for ranges without a run."""
    out = np.zeros((len(s.first) - 1, BINS), np.uint16)
    owner = np.repeat(np.arange(len(out)), np.diff(s.first))
    place = owner * BINS + (s.run >> _U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[at]] = (s.run[at] & _U64(0xFFFF)).astype(np.uint16)
    return out


def similarity(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts row by row."""
    x, y = weighted_sets(a, idf), weighted_sets(b, idf)
    out = np.zeros(len(a))
    for i in range(len(a)):
        p, q = slice(x.first[i], x.first[i + 1]), slice(y.first[i], y.first[i + 1])
        total = x.tf[p] @ x.idf[p] + y.tf[q] @ y.idf[q]
        _, u, v = np.intersect1d(x.run[p], y.run[q], assume_unique=True, return_indices=True)
        shared = np.minimum(x.tf[p][u], y.tf[q][v]) @ x.idf[p][u]
        out[i] = shared / (total - shared) if total > 0 else 0.0
    return out


def _digest(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("h")


def sign(docs: DataFrame, idf: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, h, sig, sketch, runs, weight`` of every text; ``h`` stands for equal texts, ``sig`` is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            s = weighted_sets(batch.column(2), idf)
            values = pa.array(signatures(s).ravel(), pa.int32())
            sig = pa.FixedSizeListArray.from_arrays(values, SAMPLES).cast(pa.list_(pa.int32())).to_pylist()
            none = np.diff(s.first) == 0
            sig = pa.array([None if m else v for m, v in zip(none, sig, strict=True)], pa.list_(pa.int32()))
            sketch = pa.array([row.tobytes() for row in sketches(s)], pa.binary())
            size = np.diff(s.first)
            weight = np.bincount(np.repeat(np.arange(len(size)), size), s.tf * s.idf, len(size))
            columns = [batch.column(0), batch.column(1), sig, sketch, pa.array(size, pa.int64()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "h", "sig", "sketch", "runs", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, h binary, sig array<int>, sketch binary, runs long, weight double"
    return docs.select(key, _digest(text), text).mapInArrow(run, schema)


def buckets(nodes: DataFrame) -> DataFrame:
    """``band, key, h, members`` of all buckets with two members at least."""
    keys = [F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]
    rows = nodes.select("h", F.posexplode(F.array(*keys)).alias("band", "key"))
    counts = rows.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(counts, ["band", "key"])


def central_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's most central member, as ``a, b`` with ``a < b``.

    In a bucket of two either is.
    """
    two = members.where("members = 2").groupBy("band", "key").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("a", "b")
    more = members.where("members > 2").select("band", "key", "h")
    with_sketch = more.join(nodes.select("h", "sketch"), "h")
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(F.col("sketch"), i * 2 + 1, F.lit(2)))
    values = with_sketch.select("band", "key", F.posexplode(bins).alias("k", "v")).groupBy("band", "key", "k", "v").count()
    common = values.groupBy("band", "key", "k").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    # BINS values for each bucket
    values = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"])
    common = common.groupBy("band", "key").agg(values.alias("c"))
    agree = F.aggregate(F.zip_with(bins, "c", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    best = with_sketch.join(common, ["band", "key"]).groupBy("band", "key").agg(F.max_by("h", F.struct(agree, "h")).alias("centre"))
    star = more.join(best, ["band", "key"]).where("h <> centre")
    star = star.select(F.least("h", "centre").alias("a"), F.greatest("h", "centre").alias("b"))
    return star.unionByName(two).distinct()


def class_links(column: pa.Array, root: np.ndarray, side: np.ndarray, idf: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Links between texts of different classes, by row numbers; if there are two sides, between texts of both.

    All similar pairs are found, but once a link joins two classes no second one between them is looked for. Runs are put
    in one order, rare ones first; the first run that two texts share has ``1 - least`` of either's weight before it at
    most if they are similar, so only texts that share a run up to there, and whose weights allow it, are compared.
    """
    s = weighted_sets(column, idf)
    n = len(root)
    owner = np.repeat(np.arange(n), np.diff(s.first))
    _, run, often = np.unique(s.run, return_inverse=True, return_counts=True)
    weight = s.tf * s.idf
    total = np.bincount(owner, weight, n)
    slack = 1e-6  # for sums in another order
    order = np.lexsort((run, often[run], owner))
    upto = np.concatenate([[0.0], np.cumsum(weight[order])])
    before = upto[:-1] - upto[s.first[:-1]][owner]
    head = order[before <= (1 - least + slack) * total[owner] + slack]
    head = head[often[run[head]] > 1]
    own = np.searchsorted(owner[head], np.arange(n + 1))
    post = head[np.argsort(run[head], kind="stable")]
    where = np.searchsorted(run[post], np.arange(len(often) + 1))
    post = owner[post]
    of = np.unique(root, return_inverse=True)[1]
    one = side.min() == side.max()
    mine = np.zeros(len(often))
    found = []
    for x in range(n):
        r = run[head[own[x] : own[x + 1]]]
        y = np.unique(post[_ranges(where[r], where[r + 1])])
        y = y[(y > x) & (of[y] != of[x]) & (one | (side[y] != side[x]))]
        y = y[np.minimum(total[y], total[x]) >= (least - slack) * np.maximum(total[y], total[x])]
        if not len(y):
            continue
        px = slice(s.first[x], s.first[x + 1])
        mine[run[px]] = s.tf[px]
        while len(y):
            size = np.cumsum(s.first[y + 1] - s.first[y])
            some, y = np.split(y, [max(1, int(np.searchsorted(size, _CHUNK)))])
            e = _ranges(s.first[some], s.first[some + 1])
            first = np.concatenate([[0], size[: len(some) - 1]])
            shared = np.add.reduceat(np.minimum(s.tf[e], mine[run[e]]) * s.idf[e], first)
            alike = shared / (total[x] + total[some] - shared)
            ok = np.flatnonzero(alike >= least)
            ok = ok[np.unique(of[some[ok]], return_index=True)[1]]
            for k in ok.tolist():
                found.append((x, int(some[k]), float(alike[k])))
            of[np.isin(of, of[some[ok]])] = of[x]
            y = y[of[y] != of[x]]
        mine[run[px]] = 0
    return found


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def remaining_links(members: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Links between members of one bucket but different classes, as ``a, b, similarity`` with ``a < b``.

    Pairs of two members were compared before. Of buckets with the same members one is searched. The members of the
    bucket's largest class and the others are cut into blocks of some ``BLOCK`` runs; every block of others meets itself,
    the other ones and every block of the largest class, whose members go where their weight allows no link.
    """
    bucket = ["band", "key"]
    m = members.where("members > 2").select(*bucket, "h").join(nodes.select("h", "runs", "weight"), "h")
    m = write_table(m.join(classes, "h", "left").withColumn("root", F.coalesce("root", "h")), "rooted")
    marks = [F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    each = m.groupBy(*bucket, "root").agg(
        F.count("*").alias("n"), F.sum("runs").alias("runs"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), *marks
    )
    each = write_table(each, "rooted")
    large = each.groupBy(*bucket).agg(F.max(F.struct("n", "root"))["root"].alias("large"), F.count("*").alias("c"))
    rest = F.col("root") != F.col("large")
    sized = each.join(large.where("c > 1"), bucket).groupBy(*bucket, "large").agg(
        F.ceil(F.sum(F.when(rest, F.col("runs"))) / BLOCK).alias("nr"),
        F.ceil(F.sum(F.when(~rest, F.col("runs"))) / BLOCK).alias("nl"),
        F.min(F.when(rest, F.col("lo"))).alias("lo"),
        F.max(F.when(rest, F.col("hi"))).alias("hi"),
        F.bit_xor("mark0").alias("mark0"),
        F.bit_xor("mark1").alias("mark1"),
    )
    sized = sized.groupBy("mark0", "mark1").agg(F.min(F.struct(*bucket, "large", "nr", "nl", "lo", "hi")).alias("s")).select("s.*")
    m = m.join(sized, bucket)
    m = m.where(rest | F.col("weight").between(F.col("lo") * (least - 1e-6), F.col("hi") / (least - 1e-6)))
    draw = F.xxhash64("h", F.lit(2))
    own = F.when(rest, F.pmod(draw, F.col("nr"))).otherwise(F.col("nr") + F.pmod(draw, F.col("nl")))
    others = F.sequence(F.lit(0), F.when(rest, F.col("nr") + F.col("nl")).otherwise(F.col("nr")).cast("int") - 1)
    m = m.select(*bucket, "h", "root", own.alias("own"), F.explode(others).alias("other"))
    pair = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    m = m.select(*bucket, *pair, "h", "root", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))

    def run(t: pa.Table) -> pa.Table:
        h = t.column("h").to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(t.column("root").to_pylist()))}
        root = np.array([number[r] for r in t.column("root").to_pylist()])
        side = t.column("side").to_numpy()
        found = []
        if len(number) > 1 and (t.column("i")[0] == t.column("j")[0] or side.min() < side.max()):
            found = class_links(t.column("text"), root, side, idf, least)
        a = pa.array([min(h[x], h[y]) for x, y, _ in found], pa.binary())
        b = pa.array([max(h[x], h[y]) for x, y, _ in found], pa.binary())
        return pa.table({"a": a, "b": b, "similarity": pa.array([z for _, _, z in found], pa.float64())})

    out = m.join(texts, "h").groupBy(*bucket, "i", "j").applyInArrow(run, "a binary, b binary, similarity double")
    return out.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = SIMILAR) -> DataFrame:
    """Pairs whose texts are similar enough: ``a, b, similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ta", 1 << 20):
            s = similarity(batch.column(2), batch.column(3), idf)
            ok = pa.array(s >= least)
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "similarity"])
            yield part.filter(ok)

    t = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a")
    t = t.join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return t.mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """``h, root`` of every node with a link: the least node of its component.

    Each round takes the least root among the neighbours and then the root's root, until nothing changes.
    """
    both = write_table(links.select(F.col("a").alias("h"), F.col("b").alias("to")).union(links.select("b", "a")), "links")
    roots = both.groupBy("h").agg(F.least("h", F.min("to")).alias("root"))
    while True:
        old = write_table(roots, "roots")
        seen = both.join(old.select(F.col("h").alias("to"), "root"), "to").groupBy("h").agg(F.min("root").alias("near"))
        new = old.join(seen, "h").select("h", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = old.select(F.col("h").alias("root"), F.col("root").alias("top"))
        roots = write_table(new.join(up, "root", "left").select("h", "was", F.least("root", F.coalesce("top", "root")).alias("root")), "roots")
        if roots.where("was <> root").isEmpty():
            return roots.select("h", "root")
        roots = roots.select("h", "root")


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' nodes ``doc_id, h``, classes ``h, root`` of linked nodes, and links ``a, b, similarity``."""
    idf = document_frequencies(docs)
    signed = write_table(sign(docs, idf), "signatures")
    # equal texts have equal samples
    some = [F.first(c).alias(c) for c in ("sig", "sketch", "runs", "weight")]
    nodes = write_table(signed.where("sig is not null").groupBy("h").agg(*some, F.min("doc_id").alias("doc_id")), "nodes")
    members = write_table(buckets(nodes), "members")
    # one row of each text is fetched, by its id as well: copies do not meet in one task
    wanted = members.select("h").distinct().join(nodes, "h").select(F.col("h").alias("_h"), F.col("doc_id").alias("_id"))
    same = (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = docs.select("doc_id", _digest(), "text").join(wanted, same, "left_semi")
    texts = write_table(texts.groupBy("h").agg(F.first("text").alias("text")), "texts")
    near = write_table(verify(central_pairs(members, nodes), texts, idf, least), "pairs")
    far = write_table(remaining_links(members, nodes, components(near), texts, idf, least), "pairs")
    links = near.unionByName(far)
    return signed.select("doc_id", "h"), components(links), links


def near_duplicate_classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size, links`` of every document; ``class_id`` is the least id of the class."""
    ids, classes, links = near_duplicates(docs, least)
    counts = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    texts = ids.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    t = texts.join(classes, "h", "left").withColumn("root", F.coalesce("root", "h")).join(counts, "h", "left")
    whole = t.groupBy("root").agg(F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size"))
    t = t.select("h", "root", F.coalesce("links", F.lit(0)).alias("links")).join(whole, "root")
    return ids.join(t, "h").select("doc_id", "class_id", "class_size", "links")


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One document of each class, the one with the least id; of repeated rows one."""
    ids, classes, _ = near_duplicates(docs, least)
    each = ids.groupBy("h", "doc_id").agg(F.count("*").alias("n")).join(classes, "h", "left")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("m")
    chosen = each.groupBy(F.coalesce("root", "h").alias("root")).agg(first)
    p = unused_prefix(docs)
    h, key, n = f"{p}h", f"{p}id", f"{p}n"
    chosen = write_table(chosen.select(F.col("m.h").alias(h), F.col("m.doc_id").alias(key), F.col("m.n").alias(n)), "chosen")
    chosen = chosen.withColumnRenamed(h, f"{h}2")
    d = docs.withColumn(h, _digest())
    d = d.join(chosen, (F.col(h) == F.col(f"{h}2")) & F.col("doc_id").eqNullSafe(F.col(key)))
    once = d.where(F.col(n) == 1).select(*docs.columns)
    again = d.where(F.col(n) > 1).dropDuplicates([h]).select(*docs.columns)
    return once.unionByName(again)
