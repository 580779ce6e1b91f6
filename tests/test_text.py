from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hitweave.functions import lists as L
from hitweave.functions import patterns as P
from hitweave.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


CASES = [
    (X.norm_accent_insensitive, "¿Qué pasó?", "que paso"),
    (X.norm_accent_insensitive, "camión-\n  es “rojo”", "camiones rojo"),
    (X.norm_accent_insensitive, "a^b café ﬁn", "ab cafe fin"),
    (X.norm_strict, "ｶﾞｷﾞ ㎏ ㈱ ﻻ 𝐀𝐁 ﬁ", "ガギ kg (株) لا AB fi"),
    (X.norm_strict, "e\u0301 か\u3099 ἀ\u0301", "é が ἄ"),
    (X.norm_accent_insensitive, "ｶﾞ ㎏ 𝐀𝐁ς é", "カ kg abς e"),
    (X.norm_accent_insensitive, "हिन्दी ज़", "ह नद ज"),
    (X.norm_accent_insensitive, "Đặng ﻻ ½", "đang لا 1 2"),
    (X.norm_accent_insensitive, None, ""),
    (X.norm_strict, "“Según  el artículo” — x​", '"Según el artículo" - x'),
    (X.norm_strict, "café ﬁn", "café fin"),
    (X.norm_loose_decimal, "Artículo 3.2, inciso a) 1,000", "articulo 3.2 inciso a 1,000"),
    (X.norm_loose_decimal, "fin. 3 . 4", "fin 3 4"),
    (X.sanitize_text, "Hello\x00World\n\n\n\nTest\t  x ", "HelloWorld\n\nTest x"),
    (X.norm_newlines, "a\r\nb\rc\n\n\n\nd", "a\nb\nc\n\nd"),
    (X.repair_mojibake, "Ã©l dÃ­a", "él día"),
    (X.repair_mojibake, "┬┐Qu├® pas├│?", "¿Qué pasó?"),
    (X.repair_mojibake, "niño", "niño"),
    (X.repair_mojibake, "plain", "plain"),
    (X.clean_query, "What is the refund policy?", "is refund policy?"),
    (X.clean_query, "¿qué es la cuota", "qué es cuota"),
    (X.clean_query, "qué cuota", "cuota"),
    (X.clean_query, "the a", "the a"),
    (X.clean_query, "cuáles son éla", "son é"),
    (X.strip_reasoning, "<think>a\nb</think>Thought: no\nyes ", "yes"),
    (X.classify_response, "No especificado en los documentos proporcionados.", "ABSENT"),
    (X.classify_response, "uno dos tres cuatro cinco seis siete ocho nueve diez once. No especificado en los documentos proporcionados", "PARTIAL"),
    (X.classify_response, "El precio no se menciona", "PARTIAL"),
    (X.classify_response, "Son 3", "FULL"),
    (X.is_refusal, "Lo siento, no", True),
    (X.is_total_query, "¿CUÁNTOS hay?", True),
    (X.direct_answer_boost, "Los datos se utilizarán para", 1),
    (X.direct_answer_boost, "nada", 0),
    (X.word_count, "a  b\nc", 3),
    (X.estimate_tokens, "12345", 2),
]


@pytest.mark.parametrize("fn,text,want", CASES)
def test_scalar(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_jaccard(spark):
    assert one(spark, X.jaccard_words, "uno dos tres", "DOS tres cuatro") == pytest.approx(0.5)
    assert one(spark, X.jaccard_words, "a b", "uno dos") == 0.0


def test_excerpt(spark):
    text = "x" * 700 + " Certificación " + "y" * 900
    got = one(spark, lambda t: X.excerpt_window(t, F.lit("¿certificacion?"), 600), text)
    assert len(got) == 600 and "Certificación" in got
    assert got == text[701 - 120 : 701 - 120 + 600]
    assert one(spark, lambda t: X.excerpt_window(t, F.lit("zzzz"), 600), text) == text[:600]
    assert one(spark, lambda t: X.excerpt_window(t, F.lit("zzzz"), 6000), text) == text


def test_distance_to_score(spark):
    df = spark.sql("select * from values (0.5D, 0.1D), (double('NaN'), 0.25D), (null, 1.5D), (null, null) t(s, d)")
    got = [r[0] for r in df.select(X.distance_to_score("s", "d")).collect()]
    assert got == [0.5, 0.75, 0.0, None]


def test_time_ago(spark):
    now = datetime(2026, 1, 1)
    rows = ["2025-12-31 23:59:01", "2025-12-31 23:00:01", "2025-12-31 00:00:01", "2025-12-02 00:00:01", "2025-01-06 00:00:00", "2023-01-01 00:00:00"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(X.time_ago(F.col("t").cast("timestamp"), F.lit(now).cast("timestamp"))).collect()]
    assert got == ["59 seg", "59 min", "23 h", "29 d", "1 años", "3 años"]


def test_lists(spark):
    got = one(spark, L.detect_list, "hay 13:\n- a\n- b\n1) c\n2) d\n3) e\nEC0110 EC0217.01")
    assert got["is_list"] and got["item_count"] == 3 and got["patterns"] == ["bullets", "numbered", "codes"]
    assert got["list_start"] == 8
    assert not one(spark, L.detect_list, "nada")["is_list"]


@pytest.mark.parametrize(
    "head,total,hit",
    [("hay 13 cosas", 13, True), ("hay 55 cosas", 55, False), ("66% de 3.14 y $12", None, False), ("hay 5 cosas", 5, False), ("13 o 6", 6, True), ("tel 2", None, False)],
)
def test_count_mismatch(spark, head, total, hit):
    got = one(spark, L.detect_count_mismatch, head + "\n- a\n- b\n- c")
    assert (got["declared_total"], got["has_mismatch"]) == (total, hit)


def test_patterns(spark):
    df = spark.createDataFrame([("¿Cuántos pasos? tres de cada Diez",)], "t string")
    r = P.pattern_tags(df, "t").first()
    assert r["numeric_question"] and r["ordered_question"] and not r["contradiction"]
    assert r["digits"] == "¿Cuántos pasos? 3 de cada 10"


def test_tables_cover_all_of_unicode():
    import unicodedata

    from hitweave.functions import unicode as U

    covered = {cp for lo, hi in U._ALL for cp in range(lo, hi)} | set(range(0xAC00, 0xD7A4)) | set(range(0xD800, 0xE000))
    for cp in range(0xA0, 0x110000):
        if cp not in covered:
            c = chr(cp)
            assert unicodedata.normalize("NFKD", c) == c and (cp < 0x20000 or not unicodedata.combining(c)), hex(cp)
