"""What a question asks for, and the search settings that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.text import (
    cap_alpha,
    clean_query,
    hybrid_signals,
    is_total_query,
    norm_accent_insensitive,
    trim_ws,
    word_total,
)
from hitweave.params import SEARCH


# fixed values: weighted signs per question class, matched on the normalised question.
# (Signs that need a % or a decimal point cannot survive normalisation and are left out.)
ORDERED = [
    (r"\ben\s+que\s+orden\b", 1), (r"\bin\s+what\s+order\b", 1), (r"\bsequence\s+of\b", 1),
    (r"\bsteps\s+to\b", 1), (r"\bsteps\s+for\b", 1), (r"\bpasos\s+para\b", 1),
    (r"\bprocedimiento\s+para\b", 1),
    (r"\b(primero|first)\b.*\b(segundo|second)\b.*\b(tercero|third)\b", 3),
    (r"\b(step|paso|fase|phase|etapa)\s+\d+\b", 2),
    (r"\b(chronological|cronologic)\w*\b", 1),
    (r"\b(after|before|despues|antes)\b", 1),
]
NUMERIC = [
    (r"\bhow\s+many\b", 1), (r"\bhow\s+much\b", 1), (r"\bcual\s+es\s+el\s+monto\b", 2),
    (r"\bcuanto(s)?\b", 2),
    (r"\b(total|numero|porcentaje|percent|percentage)\b", 2),
    (r"\b(precio|monto|valor|tasa|plazo|rendimiento|promedio)\b", 2),
    (r"\b\d+\s*(percent|porcentaje|porcentagem)\b", 3),
    (r"\b\d+\b", 1),
]
LIST = [
    (r"\bcuales\s+son\b", 2), (r"\bwhat\s+are\s+the\b", 2), (r"\blist\s+the\b", 2),
    (r"\b(lista(r)?|menciona|enumera|nombra)\b", 2),
]
# fixed values: class -> vector share, fusion; classes in falling priority
CLASSES = {"ordered": ORDERED, "numeric": NUMERIC, "list": LIST}
GENERAL = "regla_general"
ALPHA = {"ordered": 0.4, "numeric": 0.35, "list": 0.5, GENERAL: 0.75}
FUSION = {"ordered": "relative", "numeric": "ranked", "list": "relative", GENERAL: "relative"}


def classify_query(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``question_type`` and the three class scores."""
    df = df.withColumn("_q", norm_accent_insensitive(query))
    scores = {}
    for name, signs in CLASSES.items():
        total = F.lit(0)
        for regex, weight in signs:
            total = total + F.when(F.col("_q").rlike(regex), weight).otherwise(0)
        scores[f"score_{name}"] = total
    df = df.withColumns(scores).drop("_q")
    best = F.greatest(*[F.col(f"score_{n}") for n in CLASSES])
    kind = F.when(best == 0, GENERAL)
    for name in CLASSES:
        kind = kind.when(F.col(f"score_{name}") == best, name)
    return df.withColumn("question_type", kind)


def hybrid_alpha(df: DataFrame, query: str = "query", kind: str = "question_type") -> DataFrame:
    """Adds ``alpha`` (share of the vector score) and the ``fusion`` named for the class."""
    base, fusion = F.lit(ALPHA[GENERAL]), F.lit(FUSION[GENERAL])
    for name in CLASSES:
        base = F.when(F.col(kind) == name, ALPHA[name]).otherwise(base)
        fusion = F.when(F.col(kind) == name, F.lit(FUSION[name])).otherwise(fusion)
    return df.withColumn("alpha", cap_alpha(base, hybrid_signals(query))).withColumn("fusion", fusion)


def prepare_query(df: DataFrame, query: str = "query", previous: str = "previous_question") -> DataFrame:
    """Adds ``embed_query``, ``bm25_query`` and ``do_search``.

    A very short query borrows the previous question; without one there is no search.
    """
    short = word_total(query) <= SEARCH.ambiguous_words
    has_prev = F.coalesce(F.col(previous), F.lit("")) != ""
    df = df.withColumn("embed_query", F.when(short & has_prev, F.col(previous)).otherwise(F.col(query)))
    e = F.col("embed_query")
    literal = F.endswith(trim_ws(e), F.lit("?")) & (word_total(e) >= SEARCH.literal_words)
    return df.withColumn("bm25_query", F.when(literal, e).otherwise(clean_query(e))).withColumn(
        "do_search", ~(short & ~has_prev)
    )


def fetch_budget(df: DataFrame, query: str = "embed_query", alpha: str = "alpha") -> DataFrame:
    target = F.when(is_total_query(query), SEARCH.target_total).otherwise(SEARCH.target)
    factor = F.when(F.col(alpha) <= SEARCH.low_alpha, SEARCH.overfetch_low).otherwise(SEARCH.overfetch_high)
    return df.withColumn("target_chunks", target).withColumn("fetch_n", target * factor)
