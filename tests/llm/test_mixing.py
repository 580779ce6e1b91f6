import re
from collections import defaultdict

from hitweave.llm import mixing as M
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    """Deal by weight, cut at the caps, deal the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > cap[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ -= full
    return out


def test_targets_equal_dealing_again(spark):
    for sizes in ({"a": 100, "b": 1000, "c": 5000, None: 40}, {"x": 10}, {"a": 0, "b": 7, "c": 0}, {f"s{i:02}": 10 + i * i for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.allot(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def corpus(docs, n=6000):
    """One source holds half of all rows; sizes vary by a factor of a thousand."""
    text = lambda i: "w " * (1 + (i * 7919) % 40) * (30 if i % 97 == 0 else 1)
    return docs([(i, text(i), None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 8}") for i in range(n)], 8)


def test_sources_come_near_their_targets(docs):
    d = corpus(docs)
    got = M.mix_counts(d).collect()
    text = {r.doc_id: (r.text, r.source) for r in d.collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        t, s = text[r.doc_id]
        assert r.size == len(WORD.findall(t)) and r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.copies
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    assert len(got) == 6000


def test_every_document_has_its_chance(docs):
    """With equal sizes and half the words wanted, each half of the order is drawn alike over seeds."""
    d = docs([(i, "a b c", "x" if i < 1000 else "y") for i in range(2000)])
    hits = defaultdict(int)
    for seed in range(6):
        for r in M.mix_counts(d, seed=seed, share=0.5).collect():
            hits[r.doc_id] += r.copies
    drawn = [sum(hits[i] for i in range(a, a + 250)) for a in range(0, 1000, 250)]
    assert max(drawn) < 1.25 * min(drawn)


def test_documents_follow_the_counts_and_reruns_agree(docs):
    d = corpus(docs, 1500)
    counts = {r.doc_id: r.copies for r in M.mix_counts(d).collect()}
    again = {r.doc_id: r.copies for r in M.mix_counts(d.repartition(5)).collect()}
    assert counts == again
    out = M.mix_documents(d)
    assert out.columns == d.columns
    seen = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert seen == {i: n for i, n in counts.items() if n}


def test_odd_rows(odd, empty):
    got = M.mix_counts(odd).collect()
    assert len(got) == 11 and all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    M.mix_documents(odd).collect()
    assert M.mix_counts(empty).count() == 0 and M.mix_documents(empty).count() == 0
    assert rows(M.allot(odd.sparkSession.createDataFrame([], "source string, source_size long")), "source") == []


def test_repeated_rows_are_taken_as_far_as_the_target(docs):
    """Equal rows hold a third to nearly all of a source; each source still comes near its target, in both forms."""
    for parts in (2, 7):
        rows_ = [(i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(2000)] + [(5, "same words here " * 8, "s0")] * 1000 + [(None, "x y", None)] * 3000
        d = docs(rows_, parts)
        got = M.mix_counts(d).collect()
        assert len(got) == 6000
        taken, target = defaultdict(int), {}
        for r in got:
            taken[r.source_size] += r.taken
            target[r.source_size] = r.target
        assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
        out = M.mix_documents(d)
        assert out.columns == d.columns
        a = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        b = defaultdict(int)
        for r in got:
            b[r.doc_id] += r.copies
        assert a == {k: v for k, v in b.items() if v}
        if parts == 2:
            first = dict(b)
    assert first == dict(b)  # however the rows are dealt
