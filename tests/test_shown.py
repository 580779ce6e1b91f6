"""Lists are packed by the lengths of their texts; texts come to the sections taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import context as K
from hitweave.plans import load
from hitweave.plans.tables import hits
from tests.test_slim import dealt

QUERIES = load().QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts around the lengths where they are cut, in sources of many and of few chunks; some ids come twice, some texts are null."""
    rng = np.random.default_rng(7)
    sizes = [0, 1, 149, 150, 151, 152, 999, 1000, 1001, 1149, 1150, 1151, 1300, 4000]
    text = lambda i, n: None if i % 29 == 28 else (f"wörd{i} und \U0001f600 {i * 7} mehr. " * 300)[:n]
    d = [(i, text(i, sizes[i % len(sizes)] if i % 3 else int(rng.integers(20, 600))), f"site{i % 2}") for i in range(90)]
    d += [(5, text(5, 80), "site7"), d[40], d[41]]
    e = [(i, i % 4 if i % 5 else 9, [float(x) for x in rng.normal(size=4)]) for i in range(85)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(d, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(e + e[50:52], "vec_id long, label int, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def sections(df):
    return {r.query_id: tuple(r) for r in df.orderBy("query_id").collect()}


def test_lists_packed_by_lengths_give_the_contexts_of_whole_texts(spark, tables):
    got = sections(QUERIES["build_context"](spark, tables))
    whole = K.build_context(hits(spark, tables))
    want = sections(whole.select("query_id", "context", "used_chunks", "total_chunks", "total_chars", F.array_join("sources", ",")))
    assert len(want) == 85 and got == want
    assert any(r[2] == 8 for r in want.values()) and any(r[4] > 4500 for r in want.values())
    pages = lambda df: sorted(map(tuple, df.collect()))
    assert pages(QUERIES["context_pages"](spark, tables)) == pages(K.context_pages(whole))


def test_lists_are_dealt_without_texts(spark, tables):
    found = [{x.split("#")[0] for x in out.split(",")} for out in dealt(QUERIES["context_pages"](spark, tables))]
    assert any("ord" in names for names in found)
    assert not any("ord" in names and names & {"text", "content_without_overlap"} for names in found)


def test_lists_without_sections_and_unknown_chunks_stay(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", 1, 10, 5, None), (1, 2, "a", 2, 11, 5, 3), (2, 1, "a", 3, 12, None, None), (3, 1, "b", 1, 99, 6000, None)],
        "query_id long, ord int, source_name string, chunk_index int, chunk_id long, text_size int, bare_size int",
    )
    chunks = spark.createDataFrame([(10, "abcde", None), (11, "vwxyz", "xyz"), (12, None, None)], "chunk_id long, text string, content_without_overlap string")
    out = {r.query_id: r for r in K.build_context(rows, chunks=chunks).collect()}
    assert [(s.llm_text, s.page_key, s.ord) for s in out[1].packed] == [("abcde", "Página 1", 1), ("xyz", "Página 2", 2)]
    assert out[2].context == "SOURCE Página 3" and out[2].used_chunks == 1
    few = {r.query_id: (r.used_chunks, r.context, r.total_chunks) for r in K.build_context(rows, K.CONTEXT.__class__(max_chars=20), chunks).collect()}
    assert few == {1: (0, "", 2), 2: (1, "SOURCE Página 3", 1), 3: (0, "", 1)}
