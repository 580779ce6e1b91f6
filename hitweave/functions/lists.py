"""Structural detection of lists and of a declared total that the list does not reach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitweave.functions.text import WS, text_or_empty

# fixed values: what a list line looks like
BULLET = rf"^{WS}*[-•*◦▪►]{WS}+.+"
NUMBERED = rf"^{WS}*(?:\d+|[a-z]|[ivxlcdm]+)[.)\-:]{WS}+.+"
CODE = r"\bEC\d{3,4}(?:\.\d{1,3})?\b"
CODE_LINE = rf"^{WS}*EC\d{{3,4}}(?:\.\d{{1,3}})?\b"
LIST_LINE = f"({BULLET})|({NUMBERED})|({CODE_LINE})"
LIST_LOOKBACK = 220
# fixed values: an integer of 1 to 3 digits, not next to % . $
STANDALONE_INT = r"(?<![%.$])\b\d{1,3}\b(?![%.$])"


def _all(c: Column, regex: str) -> Column:
    return F.regexp_extract_all(c, F.lit(regex), F.lit(0))


def detect_list(text: Column | str) -> Column:
    """struct<is_list, item_count, patterns, list_start>; ``list_start`` is 0-based or null."""
    t = text_or_empty(text)
    bullets = F.size(_all(t, f"(?m){BULLET}"))
    numbered = F.size(_all(t, f"(?mi){NUMBERED}"))
    codes = F.size(F.array_distinct(_all(t, CODE)))
    kinds = F.array(
        F.when(bullets >= 2, F.lit("bullets")),
        F.when(numbered >= 2, F.lit("numbered")),
        F.when(codes >= 2, F.lit("codes")),
    )
    items = F.greatest(*[F.when(n >= 2, n).otherwise(0) for n in (bullets, numbered, codes)])
    at = F.regexp_instr(t, F.lit(f"(?mi){LIST_LINE}"))
    return F.struct(
        (items > 0).alias("is_list"),
        items.alias("item_count"),
        F.array_compact(kinds).alias("patterns"),
        F.when(at > 0, at - 1).alias("list_start"),
    )


def detect_count_mismatch(text: Column | str, info: Column | None = None) -> Column:
    """struct<has_mismatch, declared_total, visible_items>."""
    t = text_or_empty(text)
    info = detect_list(t) if info is None else info
    start, seen = info["list_start"], info["item_count"]
    from_ = F.greatest(F.lit(0), start - LIST_LOOKBACK)
    window = F.substring(t, from_ + 1, start - from_)
    numbers = F.filter(F.transform(_all(window, STANDALONE_INT), lambda x: x.cast("int")), lambda n: n.between(3, 100))
    told = F.when(info["is_list"] & start.isNotNull() & (seen >= 3), F.try_element_at(numbers, F.lit(-1)))
    hit = (told <= F.greatest(seen * 3, F.lit(25))) & (told >= seen + 3)
    return F.struct(
        F.coalesce(hit, F.lit(False)).alias("has_mismatch"),
        told.alias("declared_total"),
        seen.alias("visible_items"),
    )
