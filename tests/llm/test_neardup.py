import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hitweave.llm import neardup as N
from tests.llm.conftest import by_id

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(3000)]


def text(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(t, k):
    w = t.split()
    for i in R.sample(range(len(w)), k):
        w[i] = R.choice(VOCABULARY)
    return " ".join(w)


def weighted(t, idf):
    """Runs of a text with their weights, by the definition."""
    s = N.weighted_sets(pa.array([t]), idf)
    return dict(zip(s.run.tolist(), (s.tf * s.idf).tolist(), strict=True))


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1e-12, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def classes_by_brute_force(texts, idf, least=N.SIMILAR):
    sets = [weighted(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or sets[i] and jaccard(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
                if texts[i] != texts[j]:
                    links.add((min(texts[i], texts[j]), max(texts[i], texts[j])))
    return [root(i) for i in range(len(texts))], links


@pytest.fixture(scope="module")
def family():
    """Unrelated texts, exact copies, and an original whose copies resemble it but hardly each other."""
    out = [text(R.randint(20, 200)) for _ in range(120)]
    base = text(200)
    out += [base] + [edited(base, 3) for _ in range(60)]
    out += [out[0]] * 40
    chain = text(150)
    for _ in range(6):
        out.append(chain)
        chain = edited(chain, 2)
    shared = text(60)
    out += [f"{text(60)} {shared} {text(60)}" for _ in range(40)]
    return out


def same(a, b):
    def groups(c):
        g = defaultdict(set)
        for i, x in enumerate(c):
            g[x].add(i)
        return {frozenset(x) for x in g.values()}

    return groups(a) ^ groups(b)


def test_classes_equal_brute_force(docs, family):
    d = docs([(i, t, "a") for i, t in enumerate(family)])
    idf = N.document_frequencies(d)
    want, _ = classes_by_brute_force(family, idf)
    got = by_id(N.near_duplicate_classes(d))
    assert not same([got[i].class_id for i in range(len(family))], want)
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] and r.class_id <= i for i, r in got.items())
    assert got[0].class_size == 41 and got[120].class_size == 61 and got[120].links >= 55


def test_samples_agree_as_often_as_sets_are_similar():
    idf = np.ones(N.DF_BINS, np.float32)
    base = text(400)
    close, want = [], []
    for k in (2, 5, 10, 20):
        other = [edited(base, k) for _ in range(60)]
        sig = N.signatures(N.weighted_sets(pa.array([base, *other]), idf))
        close.append((sig[1:] == sig[0]).mean())
        want.append(np.mean([jaccard(weighted(base, idf), weighted(o, idf)) for o in other]))
    assert np.abs(np.array(close) - want).max() < 0.05


def test_bounds_give_the_exact_sample():
    """The pruned search finds the run that the definition gives."""
    s = N.weighted_sets(pa.array([text(300), "one two three", text(50)]), np.linspace(0.5, 3, N.DF_BINS).astype(np.float32))
    got = N.signatures(s)
    for i in range(3):
        a, b = s.first[i], s.first[i + 1]
        alone = N._sample(s.run[a:b], (s.tf * s.idf)[a:b], np.array([0]))
        assert (alone[0] == got[i]).all()
    full, N._GAMMA_EXP = N._GAMMA_EXP, np.zeros_like(N._GAMMA_EXP)  # no run is ruled out
    try:
        assert (N.signatures(s) == got).all()
    finally:
        N._GAMMA_EXP = full


def test_similarity_by_definition():
    idf = np.linspace(0.5, 3, N.DF_BINS).astype(np.float32)
    a = [text(80), "", "a b", text(30), "x y z x y z x y z x y z"]
    b = [edited(a[0], 4), "", "a b", text(30), "x y z x y z x y z"]
    got = N.similarity(pa.array(a), pa.array(b), idf)
    for x, y, s in zip(a, b, got, strict=True):
        assert s == pytest.approx(jaccard(weighted(x, idf), weighted(y, idf)) if x else 0.0)


def test_stage_keeps_one_of_each_class(docs, family):
    d = docs([(i, t, "a") for i, t in enumerate(family)])
    want = {r.class_id for r in N.near_duplicate_classes(d).collect()}
    out = N.keep_one(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_odd_rows(odd, empty):
    got = N.near_duplicate_classes(odd).collect()
    assert len(got) == 11
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.class_id)
    assert of[1] == of[2] == {1} and of[4] == {4} and 5 in of[5] and of[6] == {5} and of[None] == {None}
    kept = N.keep_one(odd).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 3, 4, 5, 5, None, 8, 9], key=str)
    assert N.near_duplicate_classes(empty).count() == 0 and N.keep_one(empty).count() == 0


def test_large_bucket_is_searched_whole(spark):
    """Thousands of texts around one long passage share a bucket: links between any of them are found, and no others."""
    common = text(200)
    rest = [f"{common} {text(90)}" for _ in range(2500)]
    pairs = [(f"{common} {t}", f"{common} {edited(t, 3)}") for t in (text(90) for _ in range(60))]
    texts = rest + [t for p in pairs for t in p]
    idf = np.ones(N.DF_BINS, np.float32)
    sets = N.weighted_sets(pa.array(texts), idf)
    weight = np.add.reduceat(sets.tf * sets.idf, sets.first[:-1])
    h = [i.to_bytes(8) for i in range(len(texts))]
    nodes = [(k, int(n), float(w)) for k, n, w in zip(h, np.diff(sets.first), weight, strict=True)]
    got = N.remaining_links(
        spark.createDataFrame([(0, 1, k, len(h)) for k in h], "band int, key long, h binary, members long").repartition(3),
        spark.createDataFrame(nodes, "h binary, runs long, weight double"),
        spark.createDataFrame([(k, h[0]) for k in h[:1500]], "h binary, root binary"),  # some in one class
        spark.createDataFrame(list(zip(h, texts, strict=True)), "h binary, text string").repartition(3),
        idf,
        0.8,
    )
    got = {(int.from_bytes(r.a), int.from_bytes(r.b)): r.similarity for r in got.collect()}
    want = [(len(rest) + 2 * i, len(rest) + 2 * i + 1) for i in range(len(pairs))]
    assert sorted(got) == want
    exact = N.similarity(pa.array([texts[a] for a, _ in want]), pa.array([texts[b] for _, b in want]), idf)
    assert [got[p] for p in want] == pytest.approx(exact.tolist())


def test_many_near_misses_do_not_hide_a_link(docs):
    """Each text has more than four neighbours just below the threshold in other classes, and some a true link."""
    common = text(170)
    out = [f"{common} {text(14)}" for _ in range(300)]
    for _ in range(30):
        t = text(14)
        out += [f"{common} {t}", f"{common} {edited(t, 2)}"]
    d = docs([(i, t, "a") for i, t in enumerate(out)])
    idf = N.document_frequencies(d)
    want, _ = classes_by_brute_force(out, idf)
    assert 200 < len(set(want)) < len(out)
    got = by_id(N.near_duplicate_classes(d))
    assert not same([got[i].class_id for i in range(len(out))], want)
