"""Citations of an answer: parsing, checking against the shown text, repairing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hitweave.functions.ranking import explode_rows
from hitweave.functions.text import (
    BETWEEN,
    WS,
    classify_response,
    let,
    norm_loose_decimal,
    norm_strict,
    text_or_empty,
    trim_ws,
    word_count,
    words,
)
from hitweave.operators.context import PAGE
from hitweave.params import CITE

# fixed values: the citation section and one citation line
SECTION = r"(?:^|\n)Fuente:\s*"
LINE = r'(?iu)^-+\s*P[aá]gina\s+(\d+)\s*[—–-]\s*"([^"]+)"\s*$'


def _tail_start(answer: Column) -> Column:
    """0-based offset of the last section header (its line break included), null if there is none."""
    heads = F.regexp_extract_all(answer, F.lit(f"(?i){SECTION}"), F.lit(0))
    rest = F.element_at(F.split(answer, f"(?i){SECTION}", -1), -1)
    return F.when(F.size(heads) > 0, F.length(answer) - F.length(rest) - F.length(F.try_element_at(heads, F.lit(-1))))


def _tail(answer: Column) -> Column:
    at = _tail_start(answer)
    return F.when(at.isNotNull(), F.substring(answer, at + 1, F.length(answer)))


def one_bullet_per_page(answer: Column | str) -> Column:
    """Keep the first citation line per page in the last source section."""
    a = F.col(answer) if isinstance(answer, str) else answer

    def keep(lines: Column) -> Column:
        pages = F.transform(lines, lambda l: F.regexp_extract(trim_ws(l), LINE, 1))

        def first(p: Column) -> Column:
            kept = F.filter(
                F.sequence(F.lit(0), F.size(lines) - 1),
                lambda i: (F.get(p, i) == "") | (F.array_position(p, F.get(p, i)) == i + 1),
            )
            return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

        return let(pages, first)

    at = _tail_start(a)
    fixed = F.concat(F.substring(a, 1, at), let(F.split(_tail(a), "\n", -1), keep))
    return F.when(at.isNull(), a).otherwise(fixed)


def parse_citations(answers: DataFrame, keep: list[str], answer: str = "answer") -> DataFrame:
    """(keep.., pos, source_key, quote) for the well-formed lines after the last section header."""
    body = F.regexp_replace(_tail(F.col(answer)), r"(?i)^\n?Fuente:\s*", "")
    rows = explode_rows(answers, keep, F.split(body, r"\r?\n", -1), "pos", "_l").withColumn("_l", trim_ws(F.col("_l")))
    rows = rows.where(F.col("_l").rlike(LINE))
    return rows.select(
        *keep,
        "pos",
        F.concat(F.lit(PAGE), F.regexp_extract("_l", LINE, 1)).alias("source_key"),
        trim_ws(F.regexp_extract("_l", LINE, 2)).alias("quote"),
    )


ELLIPSIS = r"(?:\.\.\.+|…)+"


def _matches(quote: Column, text: Column, norm) -> Column:
    c = F.lower(norm(text))
    q = F.lower(norm(quote))
    parts = F.filter(F.transform(F.split(quote, ELLIPSIS, -1), trim_ws), lambda p: p != "")
    normed = F.filter(F.transform(parts, lambda p: F.lower(norm(p))), lambda p: p != "")

    def in_order(body: Column) -> Column:
        def step(at: Column, p: Column) -> Column:
            found = F.call_function("locate", p, body, at + 1)
            return F.when((at < 0) | (found == 0), -1).otherwise(found - 1 + F.length(p))

        gaps = (F.size(parts) > 1) & (F.aggregate(normed, F.lit(0), step) >= 0)
        return (body != "") & (((q != "") & F.contains(body, q)) | gaps)

    return let(c, in_order)


def quote_exists(quote: Column | str, text: Column | str) -> Column:
    """Strict containment, else loose; parts around an ellipsis must occur in order."""
    q = trim_ws(text_or_empty(quote))
    t = trim_ws(text_or_empty(text))
    hit = _matches(q, t, norm_strict) | _matches(q, t, norm_loose_decimal)
    return F.when((q == "") | (t == ""), F.lit(False)).otherwise(hit)


def fix_quote_length(quote: Column | str, text: Column | str) -> Column:
    """Widen a quote of fewer than 4 words, cut one of more than 15; null if it cannot be placed."""
    q, t = text_or_empty(quote), text_or_empty(text)
    at = F.instr(F.lower(norm_strict(t)), F.lower(norm_strict(q))) - 1
    n = F.size(words(q))
    least, most = CITE.min_words, CITE.max_words

    def fix(w: Column) -> Column:
        def placed(match: Column) -> Column:
            # first word whose end lies behind the match position
            def step(acc: Column, x: Column) -> Column:
                end = acc["len"] + F.length(x) + 1
                hit = acc["found"] | (end > match)
                return F.struct(
                    F.when(hit, acc["len"]).otherwise(end).alias("len"),
                    F.when(hit, acc["at"]).otherwise(acc["at"] + 1).alias("at"),
                    hit.alias("found"),
                )

            zero = F.expr("named_struct('len', 0, 'at', 0, 'found', false)")
            spot = F.aggregate(w, zero, step, lambda a: F.when(a["found"], a["at"]).otherwise(0))

            def cut(i: Column) -> Column:
                ahead = F.slice(w, i + 1, F.lit(least))
                back = F.slice(w, F.greatest(F.lit(0), i - (least - F.size(ahead))) + 1, F.lit(least))
                return (
                    F.when((n < least) & (F.size(ahead) >= least), F.array_join(ahead, " "))
                    .when((n < least) & (F.size(back) >= least), F.array_join(back, " "))
                    .when(n < least, None)
                    .when(n > most, F.array_join(F.slice(w, i + 1, F.lit(most)), " "))
                    .otherwise(q)
                )

            return let(spot, cut)

        return let(at, lambda m: F.when(m >= 0, placed(m)))

    return let(words(t), fix)


def _best_window(marks: np.ndarray) -> int:
    """Start and size (``start * 16 + size``) of the window with most marks; then the earliest, then the shortest."""
    lo, hi = CITE.span_min, min(CITE.span_max, len(marks))
    upto = np.concatenate([[0], np.cumsum(marks)])
    found = []
    for size in range(lo, hi + 1):
        sums = upto[size:] - upto[:-size]
        start = int(np.argmax(sums))  # the first of the largest
        found.append((-int(sums[start]), start, size))
    _, start, size = min(found)
    return start * 16 + size


@F.pandas_udf(LongType())
def _best_windows(normed: pd.Series, hints: pd.Series) -> pd.Series:
    """Best window of each text by prefix sums. ``normed`` has its normalised words with ``BETWEEN`` in between."""
    out = []
    for text, wanted in zip(normed, hints, strict=True):
        wanted = set() if wanted is None else set(wanted)
        w = text.split(BETWEEN) if text is not None and wanted else []
        out.append(_best_window(np.array([x.strip(" ") in wanted for x in w], np.int64)) if len(w) >= CITE.span_min else None)
    return pd.Series(out, dtype="Int64")


def best_span(hint: Column | str, text: Column | str) -> Column:
    """The first window of 6 to 12 words sharing most words with the hint.

    Words are normalised in one go, and windows compared by prefix sums over Arrow batches.
    """
    w = words(text_or_empty(text))
    wanted = F.filter(F.split(norm_loose_decimal(hint), WS + "+"), lambda x: x != "")
    best = _best_windows(norm_loose_decimal(F.array_join(w, BETWEEN), BETWEEN), wanted)

    def cut(b: Column) -> Column:
        return F.when(b.isNotNull(), F.array_join(F.slice(w, F.shiftright(b, 4).cast("int") + 1, (b % 16).cast("int")), " "))

    return let(best, cut)


def validate_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Check every citation against the text shown under its page, repairing the quote where needed.

    ``status``: exact, length_fixed, best_span, head_span, unknown_page or too_short; the last two are invalid.
    """
    df = citations.join(pages.withColumnRenamed("page_key", "source_key"), ["query_id", "source_key"], "left")
    df = df.withColumn("_q", F.regexp_replace(trim_ws(F.col("quote")), rf"(?:[.…]|{WS})+\z", ""))
    n = word_count("_q")
    df = df.withColumn("_ok_len", n.between(CITE.min_words, CITE.max_words))
    df = df.withColumn("_exact", F.col("_ok_len") & quote_exists("_q", "llm_text"))
    known = F.coalesce(F.col("llm_text"), F.lit("")) != ""
    todo = known & ~F.col("_exact")
    df = df.withColumn("_fix", F.when(todo & ~F.col("_ok_len"), fix_quote_length("_q", "llm_text")))
    fixed_ok = (
        F.col("_fix").isNotNull()
        & (F.col("_fix") != "")
        & (F.col("_fix") != F.col("_q"))
        & word_count("_fix").between(CITE.min_words, CITE.max_words)
        & quote_exists("_fix", "llm_text")
    )
    df = df.withColumn("_fix", F.when(fixed_ok, F.col("_fix")))
    df = df.withColumn("_span", best_span("_q", F.when(todo & F.col("_fix").isNull(), F.col("llm_text"))))
    span_ok = word_count("_span").between(CITE.min_words, CITE.max_words) & (F.col("_span") != "")
    df = df.withColumn("_span", F.when(span_ok, F.col("_span")))
    head = words("llm_text")
    df = df.withColumn(
        "_head",
        F.when(todo & F.col("_fix").isNull() & F.col("_span").isNull() & (F.size(head) >= CITE.span_min), F.array_join(F.slice(head, 1, 15), " ")),
    )
    status = (
        F.when(~known, "unknown_page")
        .when(F.col("_exact"), "exact")
        .when(F.col("_fix").isNotNull(), "length_fixed")
        .when(F.col("_span").isNotNull(), "best_span")
        .when(F.col("_head").isNotNull(), "head_span")
        .otherwise("too_short")
    )
    out = df.withColumn("status", status).withColumn("fixed_quote", F.coalesce("_fix", "_span", "_head", "quote"))
    out = out.withColumn("valid", ~F.col("status").isin("unknown_page", "too_short"))
    return out.select(*citations.columns, "status", "valid", "fixed_quote")


def repair_flag(answers: DataFrame, validated: DataFrame, answer: str = "answer") -> DataFrame:
    """Per query: response type, citation counts, and whether the answer must be repaired."""
    counts = validated.groupBy("query_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("valid_citations"))
    df = answers.select("query_id", classify_response(answer).alias("response_type")).join(counts, "query_id", "left")
    df = df.fillna(0, ["citations", "valid_citations"])
    needs = F.when(F.col("citations") == 0, F.col("response_type") != "ABSENT").otherwise(F.col("valid_citations") == 0)
    return df.withColumn("needs_repair", needs)
