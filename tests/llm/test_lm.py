import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave.llm import lm
from hitweave.llm.quality import fold
from hitweave.llm.words import tokens

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sentence(i, n=30):
    """Nouns follow articles, verbs follow nouns: classes that bigrams of words cannot show on little text."""
    rng = np.random.default_rng(i)
    out = []
    while len(out) < n:
        out += [f"the{rng.integers(5)}", f"noun{rng.integers(60)}", f"verb{rng.integers(40)}", f"rare{rng.integers(10**6)}"]
    return " ".join(out[:n])


@pytest.fixture
def corpus(docs):
    return docs([(i, sentence(i, 10 + i % 50), "a") for i in range(300)])


def base_of(rows, held_out):
    """``doc_id: (n_tokens, n_known, train_tokens, base_score)`` from the definition."""
    count = Counter(x for i, t in rows if not held_out(i) for x in [*split(t), None])
    n, v = sum(count.values()), len(count)
    one = lambda x: math.log10((count[x] + 1) / (n + v + 1))
    return [(i, len(split(t)) + 1, sum(count[x] > 0 for x in [*split(t), None]), n, sum(map(one, [*split(t), None]))) for i, t in rows]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def check_base(out, rows):
    got = sorted(([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in out.collect()), key=str)
    want = sorted((list(r) for r in base_of(rows, held)), key=str)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], rel=1e-9)


def test_base_scores_and_held_out_likelihood(corpus):
    out = lm.lm_scores(corpus, fold("doc_id", 7) != 2, head=200, classes=12).cache()
    check_base(out, [(r.doc_id, r.text) for r in corpus.collect()])
    b, s, n = out.where(fold("doc_id", 7) == 2).agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert s > b + 0.3 * n  # classes know more than single words
    r = out.first()
    assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_few_counts_sent_give_the_same_scores(corpus):
    """Counts that the tasks have not are joined: same results."""
    a = lm.lm_scores(corpus, fold("doc_id", 7) != 2, head=100, classes=8, rounds=8)
    b = lm.lm_scores(corpus, fold("doc_id", 7) != 2, head=100, known=120, classes=8, rounds=8)
    a, b = ([tuple(r) for r in x.orderBy("doc_id").collect()] for x in (a, b))
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert np.allclose([r[4:] for r in a], [r[4:] for r in b], rtol=1e-9)


def test_chances_add_up_to_one(spark, corpus):
    model, counts = lm.fit(corpus, head=50, classes=6, rounds=4)
    v = model.vocab
    seen = {r.token & (2**64 - 1): (r.spelling, r.n) for r in counts.collect()}
    unseen = {s: 1 for s in range(lm.SPELLINGS)}
    for before in (0, 20, v.units - 1):
        c = model.cls[before]
        step = model.step[c, model.cls]
        by_unit = 10 ** (step + model.emit)
        total = by_unit[: len(v.head_n)].sum() + by_unit[-1]
        head = set(v.token[v.unit >= 0].tolist())
        for token, (s, n) in seen.items():
            if s >= 0 and token not in head:
                total += by_unit[len(v.head_n) + s] * (n + 1)
        total += sum(by_unit[len(v.head_n) + s] * n for s, n in unseen.items())
        assert total == pytest.approx(1)


def test_score_equals_a_plain_walk(corpus):
    model, counts = lm.fit(corpus, head=50, classes=6, rounds=4)
    n_of = {r.token & (2**64 - 1): r.n for r in counts.collect()}
    v = model.vocab
    unit_of = {int(t): int(u) for t, u in zip(v.token, v.unit, strict=True) if u >= 0}
    out = {r.doc_id: r.score for r in lm.score_texts(corpus, model, counts).collect()}
    for r in corpus.limit(20).collect():
        w = tokens(pa.array([r.text]))
        before, total = v.units - 1, 0.0
        for h, s in zip(w.hash.tolist(), lm.spelling(w).tolist(), strict=True):
            u = unit_of.get(h, len(v.head_n) + s)
            total += model.step[model.cls[before], model.cls[u]] + model.emit[u]
            total += 0 if h in unit_of else math.log10(n_of.get(h, 0) + 1)
            before = u
        total += model.step[model.cls[before], model.cls[-1]] + model.emit[-1]
        assert out[r.doc_id] == pytest.approx(total)


def test_gain_of_a_move_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(5)
    n = rng.integers(0, 6, (30, 30)).astype(float)
    cls = rng.integers(0, 4, 30)

    def matrix(c):
        m = np.zeros((4, 4))
        np.add.at(m, (c[:, None], c[None]), n)
        return m

    m = matrix(cls)
    for u in range(30):
        before, after = np.bincount(cls, n[:, u], 4), np.bincount(cls, n[u], 4)
        before[cls[u]] -= n[u, u]
        after[cls[u]] -= n[u, u]
        gain = lm.gains(m, cls[u], before, after, n[u, u])
        for c in range(4):
            to = cls.copy()
            to[u] = c
            assert gain[c] - gain[cls[u]] == pytest.approx(lm.likelihood(matrix(to)) - lm.likelihood(m))


def test_exchange_finds_the_parts_of_speech(spark, corpus):
    counts = lm.token_counts(corpus).cache()
    v = lm.vocabulary(counts, head=110)
    units = lm.neighbours(lm.unit_bigrams(corpus, spark.sparkContext.broadcast(v))).cache()
    start = (np.arange(v.units) % 5).astype(np.int64)
    start[-1] = 5
    cls, m = lm.exchange(units, v.units, 6)
    assert lm.likelihood(m) > lm.likelihood(lm.class_matrix(units, start, 6))
    assert np.array_equal(m, lm.class_matrix(units, cls, 6))
    assert np.flatnonzero(cls == 5).tolist() == [v.units - 1]
    kinds = {}
    for name, k in (("the", 5), ("noun", 60), ("verb", 40)):
        at = v.find(tokens(pa.array([f"{name}{j}" for j in range(k)])).hash)
        u = v.unit[at[at >= 0]]
        kinds[name] = Counter(cls[u[u >= 0]].tolist())
    # a class holds words of one kind
    pure = sum(max(c[k] for c in kinds.values()) for k in range(5))
    assert pure >= 0.95 * sum(sum(c.values()) for c in kinds.values())


def test_odd_rows(odd):
    out = lm.lm_scores(odd, fold("doc_id", 7) != 2)
    check_base(out, [(r.doc_id, r.text) for r in odd.collect()])
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out.collect())


def test_no_documents_and_no_training(docs, empty):
    assert lm.lm_scores(empty, F.lit(True)).collect() == []
    out = lm.lm_scores(docs([(1, "a b", "x"), (2, None, "x")]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in out)


def test_tokens_hash_alike_wherever_they_stand():
    texts = ["The the,\tthe, a", None, "", "a THE \x00 \x00 é é"]
    w = tokens(pa.array(texts))
    names = [x for t in texts for x in split(t)]
    assert len(names) == len(w.hash)
    assert len(set(zip(names, w.hash.tolist(), strict=True))) == len(set(names))
