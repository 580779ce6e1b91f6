import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave.llm import importance
from hitweave.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def brute(rows, target, longest=1, buckets=10000, least=20, percent=10, seed=2024):
    """Rows ``(id, n_words, n_features, weight, score, rank)``, from the definition."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + float(buckets)) / ((s[b] + 1.0) * (all_t + float(buckets))))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found, own = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(found), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k in range(len(able) * percent // 100):
        able[k][5] = k + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert dict(df.dtypes) == dict.fromkeys(names, "bigint")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def text_of(i, n):
    return " ".join(f"w{(i * 31 + j * j * 7) % 211}" for j in range(n))


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35), (3, 100)])
def test_equals_the_definition(spark, docs, longest, percent):
    rows = [(i, text_of(i, 5 + i % 60) + ". Ünïq" * (i % 3), "a") for i in range(300)]
    target = [text_of(i, 40) for i in range(0, 40, 4)]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.resample(docs(rows), t, longest=longest, buckets=997, percent=percent)
    assert got(out) == brute([r[:2] for r in rows], target, longest, 997, percent=percent)


def test_crc_of_runs_of_any_length():
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "É ñ 漢字 🙂 x", "Z" * 200_000 + " q " + "y" * 64 + " " + "y" * 65 + " " + "y" * 63]
    texts += [" ".join("ab9é"[k] * int(n) for k, n in zip(rng.integers(0, 4, 30), rng.integers(1, 80, 30), strict=True)) for _ in range(20)]
    w = words(pa.array(texts))
    for n, (crc, first) in enumerate(importance.run_crcs(w, 3), 1):
        want = [zlib.crc32(" ".join(f[i : i + n]).encode()) for f in (features(t, 1)[0] for t in texts) for i in range(len(f) - n + 1)]
        assert crc.tolist() == want
        assert len(first) == len(want)


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = ["word1 word2 plain", None, ""]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    out = importance.resample(odd, t, least_words=1, percent=50)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got(out) == brute(rows, target, least=1, percent=50)


def test_ties_at_the_cutoff_and_repeated_rows(spark, docs):
    # one id and text in a third of all rows, with the highest score, then in the middle of the order
    for share in (10, 40, 70):
        rows = [(7, text_of(7, 30), "a")] * 60 + [(i, text_of(i, 30), "a") for i in range(100, 220)]
        t = spark.createDataFrame([(text_of(i, 30),) for i in range(100, 100 + share)], "text string")
        out = importance.resample(docs(rows), t, percent=share)
        assert got(out) == brute([r[:2] for r in rows], [text_of(i, 30) for i in range(100, 100 + share)], percent=share)
        ranks = sorted(r.rank for r in out.where("rank is not null").collect())
        assert ranks == list(range(1, 180 * share // 100 + 1))


def test_ids_decide_equal_scores(spark):
    d = spark.range(-500, 500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    for want in (1, 5, 333, 334, 400, 999, 1000):
        assert importance.highest_reached(d, F.col("v"), want) == sorted((r.v for r in d.collect()), reverse=True)[want - 1]
        assert ~importance.highest_reached(d, F.bitwise_not("k"), want) == -500 + want - 1


def test_ranks_follow_the_order_over_many_partitions(spark):
    d = spark.range(5000).select(F.col("id").alias("row"), (F.col("id") * 7919 % 50).alias("v"))
    out = importance.ranked(d, [F.desc("v"), F.col("row").asc()])
    want = sorted(((r.v, r.row) for r in d.collect()), key=lambda x: (-x[0], x[1]))
    assert [r.row for r in out.orderBy("rank").collect()] == [x[1] for x in want]
    assert [r.rank for r in out.orderBy("rank").collect()] == list(range(1, 5001))


def test_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert got(importance.resample(empty, none)) == []
    rows = [(i, text_of(i, 25), "a") for i in range(30)]
    assert got(importance.resample(docs(rows), none)) == brute([r[:2] for r in rows], [])
    assert all(r[5] is None for r in got(importance.resample(docs([(1, "few words", "a")]), none)))
