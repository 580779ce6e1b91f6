import os

import pytest

import corpus_pipeline as C
from hitweave.llm import decontam, mixing, neardup, quality
from hitweave.session import write_table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_does_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    d, step = docs, dict(C.STAGES)
    for name in ("quality", "near_duplicates", "decontamination"):
        before, d = d, write_table(step[name](spark, d, SF), "test")
        assert d.columns == docs.columns
        if name == "quality":
            want = ids(quality.quality_scores(before, labels).where(f"score >= {quality.REJECT}"))
        elif name == "near_duplicates":
            want = sorted({r.class_id for r in neardup.near_duplicate_classes(before).collect()})
        else:
            bad = {r.doc_id for r in decontam.contaminated_pairs(before, items).collect()}
            want = [i for i in ids(before) if i not in bad]
        assert ids(d) == want
    before, d = d, write_table(step["mixing"](spark, d, SF), "test")
    counts = {r.doc_id: r.copies for r in mixing.mix_counts(before).collect()}
    assert ids(d) == sorted(i for i, n in counts.items() for _ in range(n))
    out = step["sharding"](spark, d, SF)
    assert out.columns == [*docs.columns, "shard"] and out.count() == d.count()
    assert {r.shard for r in out.collect()} <= set(range(C.SHARDS))
    assert sorted(map(str, C.run(spark, SF).collect())) == sorted(map(str, out.collect()))


def test_odd_and_empty_documents(spark, odd, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for d in (odd, empty):
        for _, stage in C.STAGES:
            d = write_table(stage(spark, d, sf), "odd")
        assert "shard" in d.columns
