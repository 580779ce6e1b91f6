"""Text cleaning and scalar text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitweave.functions.unicode import fold_accents, nfc, nfkc
from hitweave.params import CITE, SEARCH

# fixed values: characters that count as white space
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_NOT_NEWLINE = WS.replace(r"\n", "")
# private-use stand-ins for a decimal point and a digit-group comma
DOT, COMMA = "\ue010", "\ue011"
# a private-use mark between words that are normalised together
BETWEEN = "\ue012"
# ASCII word boundaries (Java's \b also counts accented letters)
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column named before a projection may be inlined again into every use,
    also into a lambda that runs per array element; a lambda variable may not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", " ")


def words(c: Column | str) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(_c(c), WS + "+"), lambda w: w != "")


def word_total(c: Column | str) -> Column:
    """Number of pieces of ``trim(text)`` around white space; an empty text has one."""
    return F.size(F.split(trim_ws(_c(c)), WS + "+"))


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{L})-\s*\r?\n\s*(\p{L})", "$1$2")


def norm_accent_insensitive(c: Column | str) -> Column:
    """Lower-case letters and digits only, no accents, single spaces."""
    c = F.lower(join_hyphenated(fold_accents(text_or_empty(c))))
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def norm_strict(c: Column | str) -> Column:
    """Keeps accents and punctuation; unifies typography and spaces."""
    c = nfkc(text_or_empty(c))
    c = join_hyphenated(F.regexp_replace(c, r"\p{Cf}+", ""))
    c = F.regexp_replace(c, r"[\p{Pi}\p{Pf}]", '"')
    c = F.regexp_replace(c, r"\p{Pd}", "-")
    return trim_ws(F.regexp_replace(c, r"[\p{Z}\s\x0B]+", " "))


def norm_loose_decimal(c: Column | str, keep: str = "") -> Column:
    """Accent-insensitive, but decimals and digit groups keep their separators, and so do the characters ``keep``.

    Digit-digit separators are turned into letters' neighbours that survive the
    punctuation strip (private-use characters), and turned back at the end.
    """
    c = join_hyphenated(fold_accents(text_or_empty(c)))
    c = F.regexp_replace(c, r"(\d)\.(\d)", f"$1{DOT}$2")
    c = F.lower(F.regexp_replace(c, r"(\d),(\d)", f"$1{COMMA}$2"))
    c = F.btrim(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}§{DOT}{COMMA}{keep}]+", " "))
    return F.replace(F.replace(c, F.lit(DOT), F.lit(".")), F.lit(COMMA), F.lit(","))


def sanitize_text(c: Column | str) -> Column:
    c = F.regexp_replace(nfkc(text_or_empty(c)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\p{Cf}]+", "")
    c = F.regexp_replace(c, WS_NOT_NEWLINE + "+", " ")
    return trim_ws(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def norm_newlines(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), r"\r\n?", "\n"), r"\n{3,}", "\n\n")


# fixed values: UTF-8 Spanish letters as they look in code page 437/850
MOJIBAKE = {
    "┬┐": "¿", "├®": "é", "├í": "á", "├│": "ó", "├║": "ú", "├▒": "ñ", "├ü": "Á",
    "├ë": "É", "├ì": "Í", "├ô": "Ó", "├Ü": "Ú", "├æ": "Ñ", "┬í": "¡",
}


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 bytes read as Latin-1 are re-read; anything else gets the table."""
    c = _c(c)
    as_bytes = F.encode(F.when(~c.rlike(r"[^\x00-\xFF]"), c), "ISO-8859-1")
    reread = F.when(F.is_valid_utf8(as_bytes.cast("string")), F.decode(as_bytes, "UTF-8"))
    table = c
    for bad, good in MOJIBAKE.items():
        table = F.replace(table, F.lit(bad), F.lit(good))
    return F.coalesce(reread, nfc(table))


# fixed values: interrogative starters and articles dropped from keyword queries
EN_STARTERS = (
    "what|who|how|which|where|why|when|is|are|does|do|did|can|could|would|should|will|tell me|please|help|explain|"
    "describe|show me|give me|find|get|i need|i want"
)
ES_STARTERS = (
    "qué|quién|cómo|cuál|cuáles|dónde|por qué|cuánto|cuántos|cuánta|cuántas|cuándo|es|son|hay|tiene|tienen|puedo|"
    "puede|podría|dime|ayuda|explica|muestra|busca|necesito|quiero"
)
ARTICLES = "the|a|an|el|la|los|las|un|una|unos|unas"


def clean_query(c: Column | str) -> Column:
    c = _c(c)
    q = F.regexp_replace(c, rf"(?iu)^({EN_STARTERS}){WS}+", "")
    q = F.regexp_replace(q, rf"(?iu)^({ES_STARTERS}){WS}+", "")
    q = F.regexp_replace(q, r"^[¿?¡!]+", "")
    q = F.regexp_replace(q, rf"(?i){WORD_START}({ARTICLES}){WORD_END}", " ")
    q = trim_ws(squeeze(q))
    return F.when(F.length(q) < 3, c).otherwise(q)


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(_c(c)) / 4).cast("int")


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(norm_strict(c), " "), lambda w: w != ""))


def word_set(c: Column | str) -> Column:
    """Distinct lower-cased words longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text_or_empty(c)), WS + "+"), lambda w: F.length(w) > 2))


def jaccard_sets(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def jaccard_words(a: Column | str, b: Column | str) -> Column:
    return jaccard_sets(word_set(a), word_set(b))


def excerpt_tokens(c: Column | str) -> Column:
    return F.slice(F.filter(F.split(norm_accent_insensitive(c), " "), lambda t: F.length(t) >= 4), 1, 8)


def excerpt_window(
    text: Column | str, query: Column | str, max_chars: int, norm: Column | None = None, query_tokens: Column | None = None
) -> Column:
    """A window of ``max_chars`` around the earliest query token, else the head.

    ``norm`` and ``query_tokens`` are the normal form of the text and the query's ``excerpt_tokens`` where these are known.
    """
    text = text_or_empty(text)
    norm = norm_accent_insensitive(text) if norm is None else norm
    query_tokens = excerpt_tokens(query) if query_tokens is None else query_tokens

    def window(norm: Column, toks: Column) -> Column:
        found = F.array_min(F.filter(F.transform(toks, lambda t: F.instr(norm, t)), lambda p: p > 0))
        at = F.floor((found - 1) * (F.length(text) / F.greatest(F.lit(1), F.length(norm))))
        start = F.greatest(F.lit(0), at - int(max_chars * 0.2))
        return F.substring(text, F.coalesce(start, F.lit(0)).cast("int") + 1, F.lit(max_chars))

    windowed = let(norm, lambda n: let(query_tokens, lambda t: window(n, t)))
    return F.when(F.length(text) <= max_chars, text).otherwise(windowed)


def strip_reasoning(c: Column | str) -> Column:
    c = F.regexp_replace(_c(c), r"(?s)<think>.*?</think>", "")
    return trim_ws(F.regexp_replace(c, r"(?i)Thought:[^\n]*(\n|\z)", ""))


def truncate_for_embedding(c: Column | str, limit: int = 8000) -> Column:
    return F.substring(_c(c), 1, limit)


def vector_truncate(c: Column | str, dims: int) -> Column:
    return F.slice(_c(c), 1, dims)


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def distance_to_score(score: Column | str, distance: Column | str) -> Column:
    d = finite(_c(distance))
    return F.coalesce(finite(_c(score)), F.when(d.isNotNull(), F.greatest(F.lit(0.0), 1 - d)))


def first_text(*cols: Column | str, default: str | None = None) -> Column:
    """First value that is neither null nor an empty string."""
    parts = [F.nullif(_c(c).cast("string"), F.lit("")) for c in cols]
    return F.coalesce(*parts, F.lit(default))


def parse_int(c: Column | str) -> Column:
    """Leading integer of a text, null if there is none."""
    return F.regexp_extract(_c(c).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int")


def chunk_key(source: Column, index: Column, page: Column, text: Column) -> Column:
    return F.concat_ws(
        "::",
        source,
        F.coalesce(index.cast("string"), F.lit("NA")),
        F.coalesce(page.cast("string"), F.lit("")),
        F.length(text_or_empty(text)).cast("string"),
    )


def is_total_query(c: Column | str) -> Column:
    # fixed values
    return _c(c).rlike("(?iu)total|subtotal|suma|cantidad|cuantos|cuántos|count|amount")


# fixed values: phrasings of a direct answer
DIRECT_ANSWER = (
    r"los\s+datos\s+(personales\s+)?se\s+utilizar[aá]n\s+para",
    r"los\s+requisitos\s+(son|para)",
    r"se\s+requiere[n]?\s*:",
    r"para\s+(ello|esto)\s+se\s+necesita",
    r"documentos?\s+necesarios?",
)


def direct_answer_boost(c: Column | str) -> Column:
    return text_or_empty(c).rlike("(?iu)" + "|".join(DIRECT_ANSWER)).cast("int")


# fixed values: phrases that mark an absent or partial answer (accent-free form)
ABSENT_PHRASE = "no especificado en los documentos proporcionados"
PARTIAL_PHRASES = "no se menciona|no se especifica|no se encuentra|no hay informacion|no se indica"


def classify_response(c: Column | str) -> Column:
    a = norm_accent_insensitive(c)
    n = F.size(F.filter(F.split(a, " "), lambda w: w != ""))
    absent = a.rlike(rf"\b{ABSENT_PHRASE}\b")
    return (
        F.when(absent & (n <= CITE.max_words), "ABSENT")
        .when(absent | a.rlike(rf"\b({PARTIAL_PHRASES})\b"), "PARTIAL")
        .otherwise("FULL")
    )


# fixed values: refusal phrases
REFUSALS = (
    "no se encuentra",
    "no hay información",
    "no se menciona",
    "no especificado",
    "no cuento con información",
    "lo siento",
    "disculpa",
)


def is_refusal(c: Column | str) -> Column:
    low = F.lower(text_or_empty(c))
    out = F.lit(False)
    for p in REFUSALS:
        out = out | F.contains(low, F.lit(p))
    return out


def time_ago(ts: Column | str, now: Column) -> Column:
    """Elapsed time in the largest fitting unit; a month is 30 days, a year 12 months."""
    secs = F.floor((F.unix_micros(now) - F.unix_micros(_c(ts))) / 1_000_000)
    mins, hours = F.floor(secs / 60), F.floor(secs / 3600)
    days = F.floor(secs / 86400)
    months = F.floor(days / 30)

    def label(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(secs < 60, label(secs, " seg"))
        .when(mins < 60, label(mins, " min"))
        .when(hours < 24, label(hours, " h"))
        .when(days < 30, label(days, " d"))
        .when(months < 12, label(months, " meses"))
        .otherwise(label(F.floor(months / 12), " años"))
    )


def hybrid_signals(c: Column | str) -> Column:
    """True when a query looks exact: short, digits, quotes or a code."""
    c = _c(c)
    return (
        (F.size(F.split(c, WS + "+")) <= 3)
        | c.rlike(r"[0-9]")
        | c.rlike("[\"']")
        | c.rlike(r"[A-Z]{2,}-?[0-9]+")
    )


def cap_alpha(alpha: Column, exact: Column) -> Column:
    return F.when(exact, F.least(alpha, F.lit(SEARCH.alpha_cap))).otherwise(alpha)
