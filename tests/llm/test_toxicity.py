import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave.llm import quality as Q
from hitweave.llm import toxicity as T

R = random.Random(3)
SYLLABLES = "th an er on in re ed or ti en st nd ha es ea".split()
INSULTS = ["idiot", "moron", "worthless", "pathetic", "scum"]


def prose(n):
    return ["".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 4))) for _ in range(n)]


def corpus(n):
    out = []
    for i in range(n):
        w = prose(R.randint(20, 120))
        if i % 8 == 0:
            for _ in range(R.randint(1, 4)):
                w.insert(R.randrange(len(w)), R.choice(INSULTS))
        out.append((i, " ".join(w), "a"))
    return out


@pytest.fixture(scope="module")
def model(spark):
    d = spark.createDataFrame(corpus(1600), "doc_id long, text string, source string")
    y = spark.range(1600).select(F.col("id").alias("doc_id"), (F.col("id") % 8 == 0).cast("int").alias("y"))
    return T.fit(d, y)


def kernel(a, b):
    """Common gapped subsequences by trying all position triples."""

    def weights(s):
        s = "^" + s
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + T.SPAN + 1)):
                    key = s[i] + s[j] + s[k]
                    out[key] = out.get(key, 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (T._NORM[len(a) + 1] * T._NORM[len(b) + 1])


def test_kernel_equals_all_triples():
    words = ["idiot", "idxiot", "thandon", "ab", "moron", "abcdefghijklm"]
    number, weight = T._vectors(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x = dict()
            for n, w in zip(number[i].tolist(), weight[i].tolist(), strict=True):
                x[n] = x.get(n, 0) + w
            got = sum(x.get(n, 0) * w for n, w in zip(number[j].tolist(), weight[j].tolist(), strict=True))
            assert got == pytest.approx(kernel(a, b))


def test_folded_machine_equals_landmark_machine():
    words, marks = ["idiot", "scum", *prose(30)], ["idiot", "scum", *prose(6)]
    words = [w for w in dict.fromkeys(words) if len(w) > 1]
    marks = [w for w in dict.fromkeys(marks) if len(w) > 1]
    toxic = np.array([5.0 if w in INSULTS else 0.1 for w in words])
    clean = np.array([0.0 if w in INSULTS else 1.0 for w in words])
    weights, bias = T.train_machine(words, toxic, clean, marks)
    v = T.values(T.segments(pa.array(words)), weights, bias)
    # its values lie in the span of the landmarks' kernels, and tell the labels apart
    k = np.array([[kernel(w, m) for m in marks] for w in words])
    coef = np.linalg.lstsq(k, v - bias, rcond=None)[0]
    assert np.abs(k @ coef - (v - bias)).max() < 1e-3
    assert min(v[:2]) > max(v[2:])


def test_segments_join_marks_and_single_letters():
    of = lambda t: T.segments(pa.array([t]))
    want = of("idiot").symbols.tolist()
    for t in ("i.d-i.o.t", "i d i o t", "IDIOT!!", "1d10t", " idiot "):
        assert of(t).symbols.tolist() == want, t
    s = T.segments(pa.array(["a b", "", "c dd e f", None]))
    assert s.text.tolist() == [0, 2, 2, 2]


def test_held_out_accuracy_and_obfuscation(model):
    test = corpus(800)
    score = model.score(pa.array([t for _, t, _ in test]))
    toxic = np.array([i % 8 == 0 for i, _, _ in test])
    assert (score[toxic] >= T.TOXIC).mean() > 0.9 and (score[~toxic] >= T.TOXIC).mean() < 0.02
    clean = " ".join(prose(60))
    for form in ("i d i o t", "w.o.r.t.h.l.e.s.s", "mo-ron", "pathettic", "idxiot"):
        a = model.score(pa.array([f"{clean} {form} {clean}"]))[0]
        assert a > 10 * model.score(pa.array([f"{clean} {clean}"]))[0], form


def test_held_out_labels_are_never_read(spark, docs):
    d = docs([(i, t, s) for i, t, s in corpus(400)])
    held = Q.fold("doc_id", 3) == 1
    y = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 8 == 0).cast("int").alias("toxic"))
    turned = y.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in T.toxicity_scores(d, y, held).collect()}
    b = {r.doc_id: r.score for r in T.toxicity_scores(d, turned, held).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_odd_rows(odd, empty, model, spark):
    got = T.score_texts(odd, model).collect()
    assert len(got) == 11 and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert T.score_texts(empty, model).count() == 0
    none = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in T.toxicity_scores(odd, none, F.lit(False)).collect()} == {0.0}
