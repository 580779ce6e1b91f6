import re

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from hitweave.llm import licences as L
from hitweave.llm.words import words
from tests.llm.conftest import by_id

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def base(text):
    """Places and labels of base phrases by trying every word."""
    w = PATTERN.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "x Licensed under CC BY-NC 4.0. y", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.\nmit LICENSE mit mit license", "mit " * 500 + "license", "Apache_License apache-license", "cc by cc by cc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gnu general public gnu general public license", "", None, "Die Katze kam mit der Lizenz", "the apache license version 2",
]


def test_base_equals_brute_force(docs):
    got = by_id(L.scan_licences(docs([(i, t, "a") for i, t in enumerate(TEXTS)])))
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[0].labels == "cc-by,cc-by-nc-4.0" and got[1].labels == "gpl,gpl-3.0"
    assert got[6].labels == "mit" and got[6].n_base == 0 and got[6].score > 0.9
    assert got[11].labels == "apache" and got[10].labels == "" and got[10].score == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit the version 3 under lizenz x".split()), max_size=40))
def test_scan_equals_brute_force(ws):
    index = L.Index(L.templates())
    index.weigh(np.arange(len(index.hash)) % 7 + 1.0, 50)
    places, base_labels, labels, _ = L._scan(index.terms(words(pa.array([" ".join(ws)])).hash), index)
    want = base(" ".join(ws))
    assert (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels))) == want[1:]
    assert base_labels <= labels


def test_drift_and_missing_key_phrase(docs):
    t = ["licensed under the very apache license version 2 0", "licensed under the apache license edition version two", "under licence of apache"]
    got = by_id(L.scan_licences(docs([(i, x, "a") for i, x in enumerate(t)])))
    assert got[0].labels == "apache,apache-2.0" and got[1].labels == "apache" and got[2].labels == ""


def test_frequencies_over_all_texts(docs):
    d = docs([(i, "apache " * 3 + ("license" if i % 2 else ""), "a") for i in range(20)])
    index = L.Index(L.templates())
    df, n = L.document_frequencies(d, index)
    at = {t: int(index.terms(L.hashes([t]))[0]) for t in ("apache", "license", "gnu")}
    assert n == 20 and df[at["apache"]] == 20 and df[at["license"]] == 10 and df[at["gnu"]] == 0


def test_odd_rows(odd, empty):
    got = L.scan_licences(odd).collect()
    assert len(got) == 11
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert L.scan_licences(empty).count() == 0
