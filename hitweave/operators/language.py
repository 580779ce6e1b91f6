"""Language tagging by character trigrams (after Cavnar & Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.text import text_or_empty

SAMPLE = 1000
# fixed values: three-letter codes the tagger may report, and their short forms
SHORT_CODES = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru",
    "zho": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "hin": "hi",
}
DEFAULT_LANGUAGE = "es"


def short_code(code: Column) -> Column:
    """Two-letter code; anything unknown is Spanish."""
    table = F.create_map(*[F.lit(x) for kv in SHORT_CODES.items() for x in kv])
    known = F.when(code.isin(*SHORT_CODES.values()), code)
    return F.coalesce(F.try_element_at(table, code), known, F.lit(DEFAULT_LANGUAGE))


def _padded(text: Column) -> Column:
    """Lower-case letters, one space for anything else, and a space at both ends."""
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), F.lit(" "))


def _trigrams(padded: str) -> np.ndarray:
    """All trigrams of a text as numbers of 3 x 21 bits; a text of two characters is its only one."""
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.int64)])
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _text(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def _code(trigram: str) -> int:
    return int(_trigrams(trigram)[0])


def language_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = 300) -> DataFrame:
    """``(lang, tri, weight)``: the most frequent trigrams of each language with their log share, over whole texts.

    Trigrams are counted inside the tasks, which give one row for each language and trigram that they met, of which
    there are few; the result has at most ``size`` rows per language. The method compares a language's head of the
    ranking, where languages differ; 300 is its published length.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, int] = {}
        for b in batches:
            for lang_, padded in zip(b["lang"].tolist(), b["padded"].tolist(), strict=True):
                code, n = np.unique(_trigrams(padded), return_counts=True)
                for c, k in zip(code.tolist(), n.tolist(), strict=True):
                    total[lang_, c] = total.get((lang_, c), 0) + k
        yield pd.DataFrame([(x, _text(c), k) for (x, c), k in total.items()], columns=["lang", "tri", "n"])

    rows = labelled.select(F.col(lang).alias("lang"), _padded(text_or_empty(text)).alias("padded"))
    counts = rows.mapInPandas(count, "lang string, tri string, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tri"))
    return (
        counts.withColumns({"_t": total, "_r": rank})
        .where(F.col("_r") <= size)
        .select("lang", "tri", F.log(1 + 1000000.0 * F.col("n") / F.col("_t")).alias("weight"))
    )


def _tagger(profiles: DataFrame):
    """Arrow function: padded texts -> the language whose profile weighs most, null if no trigram is known."""
    rows = profiles.collect()  # 300 for each language
    langs = sorted({r.lang for r in rows}, reverse=True)  # of equal weights the last name wins
    codes = np.unique(np.array([_code(r.tri) for r in rows], np.int64))
    weight = np.zeros((len(codes) + 1, max(1, len(langs))))
    for r in rows:
        weight[np.searchsorted(codes, _code(r.tri)), langs.index(r.lang)] = r.weight

    @F.pandas_udf("string")
    def tag(padded: pd.Series) -> pd.Series:
        out = []
        for p in padded.tolist():
            g = _trigrams(p)
            at = np.minimum(np.searchsorted(codes, g), max(len(codes) - 1, 0))
            known = at[codes[at] == g] if len(codes) else at[:0]
            score = np.round(np.bincount(known, minlength=len(weight)) @ weight, 6)
            out.append(langs[int(np.argmax(score))] if len(known) else None)
        return pd.Series(out, dtype=object)

    return tag


def tag_language(docs: DataFrame, profiles: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns but the text, with ``language`` and ``confidence`` (.8 for a sample of more than 100 characters, else .5).

    A text is judged by its first ``SAMPLE`` characters, in its own row: profiles have 300 rows per language and travel
    with the function, texts are not shuffled.
    """
    sample = F.substring(text_or_empty(text), 1, SAMPLE)
    sure = F.when(F.length(sample) > 100, 0.8).otherwise(0.5)
    tagged = docs.withColumn("confidence", sure).withColumn("language", short_code(_tagger(profiles)(_padded(sample))))
    return tagged.drop(text)
