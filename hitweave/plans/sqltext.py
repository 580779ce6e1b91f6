"""DuckDB spellings of the text rules, shared by the reference SQL strings."""

from __future__ import annotations


def hyphen(x: str) -> str:
    return rf"regexp_replace({x}, '(\p{{L}})-\s*\r?\n\s*(\p{{L}})', '\1\2', 'g')"


def nai(x: str) -> str:
    """Accent-insensitive form."""
    return rf"trim(regexp_replace(lower(strip_accents({hyphen(x)})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def strict(x: str) -> str:
    q = rf"regexp_replace({hyphen(x)}, '[\p{{Pi}}\p{{Pf}}]', chr(34), 'g')"
    d = rf"regexp_replace({q}, '\p{{Pd}}', '-', 'g')"
    return rf"trim(regexp_replace({d}, '[\p{{Z}}\s]+', ' ', 'g'))"


def ws_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


WS_TRIM = r"E' \t\n\r\f\v'"


def jtrim(x: str) -> str:
    return f"trim({x}, {WS_TRIM})"


def clean(x: str) -> str:
    from hitweave.functions.text import ARTICLES, EN_STARTERS, ES_STARTERS

    q = rf"regexp_replace({x}, '(?i)^({EN_STARTERS})\s+', '')"
    q = rf"regexp_replace({q}, '(?i)^({ES_STARTERS})\s+', '')"
    q = rf"regexp_replace({q}, '^[¿?¡!]+', '')"
    q = rf"regexp_replace({q}, '(?i)\b({ARTICLES})\b', ' ', 'g')"
    q = rf"trim(regexp_replace({q}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({q}) < 3 THEN {x} ELSE {q} END"


# the list rules again, in the reference engine's spelling
BULLET = r"^[\s]*[-•*◦▪►]\s+.+"
NUMBERED = r"^[\s]*(?:\d+|[a-z]|[ivxlcdm]+)[.)\-:]\s+.+"
CODE = r"\bEC\d{3,4}(?:\.\d{1,3})?\b"
LIST_LINE = rf"({BULLET})|({NUMBERED})|(^[\s]*EC\d{{3,4}}(?:\.\d{{1,3}})?\b)"
