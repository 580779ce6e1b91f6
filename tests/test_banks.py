"""Cheap tests before patterns change no result, and marks between words no branch."""

import itertools

from pyspark.sql import functions as F

from hitweave.functions import patterns as P
from hitweave.functions import unicode as U
from hitweave.functions.text import BETWEEN, norm_loose_decimal

SAMPLES = [
    "", "ſteps", "MENCIONA algo", "Tras-", "İn  ORDER", "PRİOR to", "lıst the", "Know ſuma", "how\nmany", "Cuántos", "CUÁNTOS",
    "costo", "cost", "listar", "anterior a", "anteriore a", "primero y segundo", "primero\nsegundo", "sin  embargo 1 2", "al sumar",
    "3 - 4 =", "20 %", "adding", "the sum of", "no coincide", "NÚMERO", "que siguen", "que sigue ", "On the other hand", "x\n- a\n1) b",
]


def test_stems():
    cases = {"costo?": "cost", r"cu[aá]ntos?\b": "nto", "a|b": "", r"\d+\s*%": "%", r"lista(r)?\b": "lista", r"x{2}yz+w": "yz", r"in\s+order": "order"}
    assert {p: P._stem(p) for p in cases} == cases


def test_banks_equal_their_patterns(spark):
    texts = SAMPLES + [f"{a} {b}" for a, b in itertools.pairwise(SAMPLES)] + ["total 5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, bank in P.BANKS.items():
        plain = F.lit(False)
        for p in bank:
            plain = plain | F.col("t").rlike(f"(?iu){p}")
        df = df.withColumn(f"want_{name}", plain)
    out = P.pattern_tags(df, "t")
    assert out.columns == [*df.columns, *P.BANKS, *P.KEYWORDS, "digits"]
    for r in out.collect():
        assert {n: r[n] for n in P.BANKS} == {n: r[f"want_{n}"] for n in P.BANKS}, r.t
    # a literal is looked for before its pattern
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_folded" in plan and "AS _folded" in plan


def test_number_words(spark):
    texts = ["One two-three TWENTYone ſeven", "once", "", "uno,dos tres4 cien_ ocho", "nothing", " nine", "ten é ELEVEN.", "éone one", None]
    table = P.NUMBERS_EN | P.NUMBERS_ES
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.number_words_to_digits(F.col("t")).alias("d")).collect()]
    import re

    assert got == [None if t is None else re.sub(r"\w+", lambda m: table.get(m[0].lower(), m[0]), t) for t in texts]


def test_marks_do_not_lead_to_the_large_tables(spark, monkeypatch):
    monkeypatch.setattr(U, "_diacritics", lambda: "a")  # only their branch uses it
    df = spark.createDataFrame([(f"banana{BETWEEN}é",), ("banana 中",)], "t string")
    assert [r[0] for r in df.select(U.fold_accents(F.col("t"))).collect()] == [f"banana{BETWEEN}e", "bnn 中"]


def test_separators_come_back(spark):
    df = spark.createDataFrame([("A 3.14, 1,000 ÉL",)], "t string")
    assert df.select(norm_loose_decimal("t")).first()[0] == "a 3.14 1,000 el"


def test_beyond_equals_a_search(spark):
    texts = ["", "plain", "é ñ", "中", "a\n中", "a\n\u0530", "\ud7ff", "\U0001f600", "é" * 50000 + "中", "é" * 50000, "\ue012", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for known in (U._NEAR, U._NEAR + U._PRIVATE, r"\x00-\x7F" + U._PRIVATE):
        rows = df.select(U._beyond(F.col("t"), known), F.col("t").rlike(f"[^{known}]")).collect()
        assert all(a == b for a, b in rows)
