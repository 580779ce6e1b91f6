"""Unicode normal forms as native column expressions.

Spark SQL has no NFKC/NFKD function. The code-point tables below are derived
at import time from Python's Unicode data; at run time everything is
``translate`` plus, for the few texts that need it, a constant-map lookup.
Texts take the cheapest of three branches: ASCII only; Latin, Greek, Cyrillic
and common forms; any other code point, with tables of all of Unicode. The
branches test the raw column, so no expression is evaluated twice.

Hangul syllables stay composed in all forms.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin, Greek and Cyrillic letters; punctuation and number forms; ligatures; width forms
_RANGES = ((0xA0, 0x530), (0x1E00, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
# the blocks that hold all code points with a mapping, without Hangul syllables
_ALL = ((0xA0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x12000), (0x16000, 0x17000), (0x1CC00, 0x20000), (0x2F800, 0x2FA20))
# characters that the tables of _RANGES cover
_NEAR = r"\x00-\u052F\u1E00-\u24FF\uFB00-\uFB06\uFF01-\uFF5E"
# private-use characters have no mapping in any table
_PRIVATE = r"\uE000-\uF8FF"
# marks without a combining class inside the ranges
_ENCLOSING = r"[\u0488\u0489\u20DD-\u20E0\u20E2-\u20E4]"
_PLAIN = r"[^\x00-\x7F]"
# holds every one-to-many character of the ranges; plain text seldom meets it
_RARE = r"[\u00BC-\u00BE\u0132\u0133\u013F\u0140\u0149\u01C4-\u200F\u2024-\uFFFF]"
_RARE_MAPPED = _RARE.replace(r"\u2024-\uFFFF", r"\u2024-\uD7FF\uF900-\uFFFF")
_ENTRY, _VALUE = "\ue001", "\ue002"


def _beyond(c: Column, known: str) -> Column:
    """Whether a text has a character outside of a class; running over the known ones takes a tenth of a search for others."""
    return c.rlike(rf"(?s)\A[{known}]*+.")


def _is_diacritic(c: str) -> bool:
    """Marks with a combining class; vowel signs, which have none, are no diacritics."""
    return unicodedata.combining(c) != 0


def _drop_marks(s: str) -> str:
    return "".join(c for c in s if not _is_diacritic(c))


@lru_cache(maxsize=None)
def _mapping(form: str, strip: bool, ranges=_RANGES) -> tuple[str, str, dict[str, str]]:
    """One-to-one pairs (as two strings), and expansions to several characters or none."""
    src, dst, many = [], [], {}
    for lo, hi in ranges:
        for ch in map(chr, range(lo, hi)):
            out = unicodedata.normalize(form, ch)
            out = _drop_marks(out) if strip else out
            if out == ch or unicodedata.combining(ch) and strip:
                continue
            if len(out) == 1:
                src.append(ch)
                dst.append(out)
            else:
                many[ch] = out
    return "".join(src), "".join(dst), many


def _constant_map(pairs: dict[str, str]) -> Column:
    body = _ENTRY.join(k + _VALUE + v for k, v in pairs.items())
    return F.str_to_map(F.lit(body), F.lit(_ENTRY), F.lit(_VALUE))


def _char_class(chars: dict[str, str]) -> str:
    """The body of a character class with neighbouring code points as ranges."""
    out, run = [], []
    for cp in sorted(map(ord, chars)) + [0x110000]:
        if run and cp != run[-1] + 1:
            out.append(f"\\x{{{run[0]:X}}}-\\x{{{run[-1]:X}}}")
            run = []
        run.append(cp)
    return "".join(out)


def _lookup(c: Column, pieces: str, table: dict[str, str]) -> Column:
    """Cut a text into ``pieces`` and replace those found in the table."""
    keys = _constant_map(table)
    parts = F.regexp_extract_all(c, F.lit(pieces), F.lit(0))
    longest = max(map(len, table))
    return F.array_join(
        F.transform(parts, lambda p: F.when(F.length(p) > longest, p).otherwise(F.coalesce(F.element_at(keys, p), p))),
        "",
    )


def _expand(c: Column, many: dict[str, str]) -> Column:
    cls = _char_class(many)
    return _lookup(c, f"(?s)[{cls}]|[^{cls}]+", many)


@lru_cache(maxsize=None)
def _compositions(ranges=_RANGES) -> dict[str, str]:
    pairs = {}
    for lo, hi in ranges:
        for ch in map(chr, range(lo, hi)):
            d = unicodedata.normalize("NFD", ch)
            if d != ch and unicodedata.normalize("NFC", d) == ch:
                pairs[d] = ch
                # the base may have been composed in part
                pairs["".join(chr(int(x, 16)) for x in unicodedata.decomposition(ch).split())] = ch
    return pairs


def _compose(c: Column, ranges=_RANGES) -> Column:
    return _lookup(c, r"(?s)\P{M}\p{M}+|\P{M}+(?!\p{M})|\p{M}+", _compositions(ranges))


def nfc(c: Column) -> Column:
    """Canonical composition (base letter + combining marks -> one code point)."""
    return F.when(c.rlike(r"\p{M}"), F.when(_beyond(c, _NEAR), _compose(c, _ALL)).otherwise(_compose(c))).otherwise(c)


def nfkc(c: Column) -> Column:
    """Compatibility composition."""
    src, dst, many = _mapping("NFKC", False)
    rare = F.when(c.rlike(_RARE + r"|\p{M}"), _compose(_expand(c, many))).otherwise(c)
    all_src, all_dst, all_many = _mapping("NFKC", False, _ALL)
    other = _compose(F.translate(_expand(c, all_many), all_src, all_dst), _ALL)
    return F.when(~c.rlike(_PLAIN), c).when(_beyond(c, _NEAR), other).otherwise(F.translate(rare, src, dst))


@lru_cache(maxsize=None)
def _diacritics() -> str:
    return _char_class({c: "" for c in map(chr, range(0x300, 0x20000)) if _is_diacritic(c)})


def fold_accents(c: Column) -> Column:
    """NFKD with diacritics removed (also the spacing ones of ASCII and Latin-1); other marks stay."""
    src, dst, many = _mapping("NFKD", True)
    rare = F.when(c.rlike(_RARE_MAPPED), _expand(c, many)).otherwise(c)
    all_src, all_dst, all_many = _mapping("NFKD", True, _ALL)
    other = F.translate(_expand(c, all_many), all_src, all_dst)
    # marks put between words must not send every text to the large tables
    far = _beyond(c, _NEAR + _PRIVATE) | (c.rlike(_ENCLOSING) & c.rlike(f"[{_PRIVATE}]"))
    wide = F.when(far, F.regexp_replace(other, f"[{_diacritics()}]+", "")).otherwise(
        F.regexp_replace(F.translate(rare, src, dst), r"\p{M}+", "")
    )
    return F.regexp_replace(F.when(_beyond(c, r"\x00-\x7F" + _PRIVATE), wide).otherwise(c), r"[\^`·]+", "")
