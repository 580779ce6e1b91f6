import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave.llm import quality as Q

GOOD = "The committee met on {0} and agreed, after a long debate, that plan {1} was worth another look. Nobody objected. "
BAD = "buy{0}*** now!!! {1}$$$ CLICK | HERE | {0} ###\nbuy{0}*** now!!! "


def corpus(docs, n=600):
    text = lambda i: (BAD if i % 4 == 0 else GOOD).format(f"w{i % 37}", f"v{i % 53}") * (1 + i % 5)
    return docs([(i, text(i), "a") for i in range(n)])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(3, None), (99999, 1)], "doc_id long, quality int")


def test_held_out_accuracy(docs, labels):
    d = corpus(docs)
    got = Q.quality_scores(d, labels).withColumn("fold", Q.fold("doc_id", 5)).collect()
    assert len(got) == 600
    held = [r for r in got if r.fold == 0]
    right = sum((r.score >= Q.REJECT) == (r.doc_id % 4 != 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_never_read(docs, labels):
    d = corpus(docs)
    turned = labels.withColumn("quality", F.when(Q.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in Q.quality_scores(d, labels).collect()}
    b = {r.doc_id: r.score for r in Q.quality_scores(d, turned).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-4


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 30)
    k = np.array([rng.binomial(m, min(1, i / 25)) for i, m in enumerate(n)])
    # the value at i is the largest over starts of the least mean over ends
    want = [max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(Q.isotonic(n, k), want)


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    m = Q.Model(np.zeros(18), np.ones(18))
    x = rng.normal(size=(40, 18)) * 0.5
    z = m.lift(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.WIDTH**2))
    assert np.abs(z @ z.T - want).mean() < 0.06


def test_statistics_of_known_texts():
    x = Q.statistics(pa.array(["Ab cd. 12\nab", None, ""]))
    at = {n: i for i, n in enumerate(Q.FEATURES)}
    assert x.shape == (3, len(Q.FEATURES)) and np.isfinite(x).all()
    assert x[0, at["words"]] == pytest.approx(np.log1p(4)) and x[0, at["word_length"]] == 2
    assert x[0, at["distinct"]] == 0.75 and x[0, at["upper"]] == pytest.approx(1 / 12)
    assert (x[1] == x[2]).all()


def test_one_kind_of_label_rejects_nothing(docs, spark):
    d = corpus(docs, 60)
    ones = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert {r.score for r in Q.quality_scores(d, ones).collect()} == {0.5}
    out = Q.keep_good(d, ones)
    assert out.columns == d.columns and out.count() == 60


def test_stage_keeps_what_the_scores_keep(docs, labels):
    d = corpus(docs)
    want = {r.doc_id for r in Q.quality_scores(d, labels).where(F.col("score") >= Q.REJECT).collect()}
    assert {r.doc_id for r in Q.keep_good(d, labels).collect()} == want


def test_odd_rows(odd, empty, labels):
    got = Q.quality_scores(odd, labels).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert Q.keep_good(odd, labels).columns == odd.columns
    assert Q.quality_scores(empty, labels).count() == 0 and Q.keep_good(empty, labels).count() == 0
