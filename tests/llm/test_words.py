import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hitweave.llm.words import hashes, shingles, slices, words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é漢 ._-\n🙂`{", max_size=30)), max_size=6))
def test_words_equal_the_pattern(texts):
    w = words(pa.array(texts, pa.string()))
    want = [PATTERN.findall((t or "").translate(LOWER)) for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    if flat:
        assert (w.hash == hashes(flat)).all()


def test_hash_tells_words_apart():
    many = [f"{a}{b}" for a in "abcdefghij" for b in range(3000)]
    assert len(set(hashes(many).tolist())) == len(many)
    assert len(set(hashes(["ab", "ba", "aab", "aba", "a" * 5000, "a" * 5001]).tolist())) == 6


def test_shingles_by_text():
    w = words(pa.array(["a b c d e f", "a b", "", "c d e f a b c d e"]))
    h, text, at = shingles(w, 5)
    assert text.tolist() == [0, 0, 1, 3, 3, 3, 3, 3] and at.tolist() == [0, 1, 6, 8, 9, 10, 11, 12]
    assert len(set(h.tolist())) == 7 and h[7] == h[0]
    again = shingles(words(pa.array(["x a b c d e"])), 5)[0]
    assert again[1] == h[0]


def test_slices_keep_all_rows():
    t = ["x" * n for n in (0, 5, 100, 3, 3, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([*t[:5], None])], ["i", "text"])
    parts = list(slices(iter([batch]), "text", 10))
    assert np.concatenate([p.column(0).to_numpy() for p in parts]).tolist() == list(range(6))
    assert [p.num_rows for p in parts] == [2, 1, 3]
