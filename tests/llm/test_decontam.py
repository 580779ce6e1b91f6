import random

import pyarrow as pa
import pytest

from hitweave.llm import decontam as D
from tests.llm.conftest import rows

R = random.Random(8)
WORDS = ["the", "of", "and", "to", "in"] * 40 + ["".join(R.choice("abcdefghijklmnopqr") for _ in range(R.randint(2, 9))) for _ in range(1500)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def item(n):
    k = max(3, n // 2)
    return f"{prose(k).capitalize()}. {prose(n - k).capitalize()}."


ITEMS = [item(n) for n in (8, 12, 20, 30, 45, 70, 150, 300)] + [item(R.randint(10, 60)) for _ in range(120)]


@pytest.fixture(scope="module")
def planted():
    texts, want = [], set()
    for i in range(150):
        t = prose(R.randint(0, 400))
        if i % 3 == 0:
            k = R.randrange(len(ITEMS)) if i > 24 else i // 3
            form = ITEMS[k].upper() if i % 2 else ITEMS[k].replace(" ", "  ")
            t = f"{t} {form} {prose(R.randint(0, 200))}"
            want.add((i, k))
        texts.append(t)
    return texts, want


def tables(docs, spark, texts, items=ITEMS):
    d = docs([(i, t, "a") for i, t in enumerate(texts)])
    return d, spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")


def test_planted_items_are_found_and_nothing_else(docs, spark, planted):
    d, items = tables(docs, spark, planted[0])
    assert {(r.doc_id, r.item_id) for r in D.contaminated_pairs(d, items).collect()} == planted[1]
    out = D.drop_contaminated(d, items)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} == set(range(150)) - {i for i, _ in planted[1]}


def test_several_indexes_give_the_same(docs, spark, planted):
    d, items = tables(docs, spark, planted[0])
    few = D.contaminated_pairs(d, items, most=4000)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == planted[1]
    assert D.drop_contaminated(d, items, most=4000).count() == D.drop_contaminated(d, items).count()


def test_search_equals_scoring_every_item():
    index = D.Index(list(range(len(ITEMS))), ITEMS)
    for _ in range(200):
        w = D.lower_words(pa.array([prose(40) + " " + R.choice(ITEMS)[: R.randint(5, 200)]]))
        terms = sorted({i for i, t in enumerate(index.terms.tolist()) if t in set(w.hash.tolist())})
        full = {}
        for t in terms:
            for i, s in zip(*(v.tolist() for v in index.postings.of(t)), strict=True):
                full[i] = full.get(i, 0.0) + s
        for least in (0.2, 0.5, 0.8):
            got = dict(index.find(terms, least))
            want = {i: s for i, s in full.items() if s >= least}
            assert {i for i in got} == {i for i in want if want[i] > least + 1e-9} | {i for i in got if abs(got[i] - least) < 1e-9}
            assert all(abs(got[i] - full[i]) < 1e-9 for i in got)


def test_batch_tests_lose_no_passage():
    """Passages that the batch bounds leave out hold no item above the threshold."""
    index = D.Index(list(range(len(ITEMS))), ITEMS)
    texts = [prose(300) + " " + ITEMS[i] + " " + prose(50) for i in range(40)]
    w = D.lower_words(pa.array(texts))
    left = {(t, s) for t, s, _ in D._passages(w, index, 0.5)}
    number = {h: i for i, h in enumerate(index.terms.tolist())}
    for t in range(40):
        h = w.hash[w.first[t] : w.first[t + 1]].tolist()
        for s in range(0, len(h), D.STEP):
            terms = sorted({number[x] for x in h[s : s + D.PASSAGE] if x in number})
            if index.find(terms, 0.5):
                assert (t, s) in left


def test_question_and_answer():
    assert D.question_and_answer("What is it now? It is a thing here.") == ("What is it now?", " It is a thing here.")
    assert D.question_and_answer("Re. One two three. Four five six.") == ("Re. One two three.", " Four five six.")
    assert D.question_and_answer("no end of it") == ("no end of it", "")
    assert D.question_and_answer("A b c. D.") == ("A b c. D.", "")


def test_half_an_item_is_no_leak(docs, spark):
    q, a = D.question_and_answer(ITEMS[4])
    d, items = tables(docs, spark, [f"{prose(50)} {q} {prose(50)}", f"{prose(50)} {q} {a} {prose(50)}", prose(20)])
    assert rows(D.contaminated_pairs(d, items), "doc_id", "item_id") == [(1, 4)]


def test_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no id here at all"), (3, "no id here at all"), (4, "one")], "item_id long, text string")
    got = rows(D.contaminated_pairs(odd, items), "doc_id", "item_id")
    assert got == sorted([(None, 3), (None, 3), (4, 4), (4, 4)], key=str)
    assert D.drop_contaminated(odd, items).columns == odd.columns
    none = items.where("false")
    assert D.contaminated_pairs(odd, none).count() == 0 and D.drop_contaminated(odd, none).count() == 11
    assert D.contaminated_pairs(empty, items).count() == 0 and D.drop_contaminated(empty, items).count() == 0


def test_short_items(docs, spark):
    texts = ["a zebra quokka here", "quokka zebra", "zebra and quokka, long " + prose(90), prose(200) + " Zebra  QUOKKA.", "only platypus", prose(30)]
    d, items = tables(docs, spark, texts, ["zebra quokka", "platypus", ITEMS[3]])
    assert rows(D.contaminated_pairs(d, items), "doc_id", "item_id") == [(0, 0), (3, 0), (4, 1)]


def test_item_ids_of_any_type(docs, spark):
    d = docs([(0, f"x {ITEMS[3]} y", "a")])
    items = spark.createDataFrame([("q-3", ITEMS[3]), (None, ITEMS[5])], "item_id string, text string")
    out = D.contaminated_pairs(d, items)
    assert dict(out.dtypes)["item_id"] == "string" and rows(out, "doc_id", "item_id") == [(0, "q-3")]


def test_index_is_flat_and_bounded(spark):
    import pickle

    texts = [item(R.randint(10, 60)) for _ in range(3000)]
    index = D.Index(list(range(3000)), texts)
    assert len(pickle.dumps(index)) < 1.1 * index.nbytes() + 10000
    assert index.nbytes() < 12 * sum(map(len, texts))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    parts = list(D.indexes(items, most=index.nbytes() // 5))
    assert all(x.nbytes() <= index.nbytes() // 5 for x in parts)
    assert sorted(i for x in parts for i in x.ids.to_pylist()) == list(range(3000))
