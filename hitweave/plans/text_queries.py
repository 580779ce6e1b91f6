"""Scalar text functions over whole documents, conversations and queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.functions import lists as L
from hitweave.functions import patterns as P
from hitweave.functions import text as X
from hitweave.operators import question as Q
from hitweave.operators.search import minmax_score
from hitweave.plans.registry import query
from hitweave.plans.sqltext import BULLET, CODE, LIST_LINE, NUMBERED, clean, hyphen, jtrim, nai, strict, ws_words
from hitweave.plans.tables import HITS_SQL, docs, hits, read

# every third document gets hyphenated line breaks, another third decimals and quotes
BROKEN = r"""CASE doc_id % 3 WHEN 0 THEN replace(text, ', ', E'-\n') WHEN 1 THEN replace(text, ', ', ' 3.25 "x" ')
             ELSE text END"""


def broken(spark, sd):
    t, m = F.col("text"), F.col("doc_id") % 3
    return docs(spark, sd).withColumn(
        "text",
        F.when(m == 0, F.replace(t, F.lit(", "), F.lit("-\n")))
        .when(m == 1, F.replace(t, F.lit(", "), F.lit(' 3.25 "x" ')))
        .otherwise(t),
    )


@query("norm_accent_insensitive", f"SELECT doc_id, {nai('t')} AS norm FROM (SELECT doc_id, {BROKEN} AS t FROM documents)")
def _nai(spark, sd):
    return broken(spark, sd).select("doc_id", X.norm_accent_insensitive("text").alias("norm"))


@query("norm_strict", f"SELECT doc_id, {strict('t')} AS norm FROM (SELECT doc_id, {BROKEN} AS t FROM documents)")
def _strict(spark, sd):
    return broken(spark, sd).select("doc_id", X.norm_strict("text").alias("norm"))


@query(
    "norm_loose_decimal",
    rf"""
    SELECT doc_id, trim(replace(replace(regexp_replace(
             regexp_replace(regexp_replace(lower(strip_accents({hyphen('t')})),
               '(\d)\.(\d)', '\1§d§\2', 'g'), '(\d),(\d)', '\1§c§\2', 'g'),
             '[^\p{{L}}\p{{N}}§]+', ' ', 'g'), '§d§', '.'), '§c§', ',')) AS norm
    FROM (SELECT doc_id, {BROKEN} AS t FROM documents)""",
)
def _loose(spark, sd):
    return broken(spark, sd).select("doc_id", X.norm_loose_decimal("text").alias("norm"))


@query(
    "sanitize_text",
    rf"""
    SELECT doc_id, {jtrim(r"regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\r]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')")} AS clean
    FROM (SELECT doc_id, replace(replace(text, '. ', chr(7) || E'.\t  '), E'\n', E'\n\n\n\n') AS t FROM documents)""",
)
def _sanitize(spark, sd):
    t = F.replace(F.replace("text", F.lit(". "), F.lit("\x07.\t  ")), F.lit("\n"), F.lit("\n\n\n\n"))
    return docs(spark, sd).select("doc_id", X.sanitize_text(t).alias("clean"))


@query(
    "norm_newlines",
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(replace(text, E'\n', E'\r\n\r\n\r'), '\r\n?', E'\n', 'g'),
                                  '\n{3,}', E'\n\n', 'g') AS clean
    FROM documents""",
)
def _newlines(spark, sd):
    return docs(spark, sd).select(
        "doc_id", X.norm_newlines(F.replace("text", F.lit("\n"), F.lit("\r\n\r\n\r"))).alias("clean")
    )


@query("repair_mojibake", "SELECT doc_id, text AS repaired, true AS ok FROM documents")
def _mojibake(spark, sd):
    # damage every text the way a Latin-1 reader would, then repair it
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs(spark, sd).select(
        "doc_id", X.repair_mojibake(damaged).alias("repaired"), (X.repair_mojibake(damaged) == F.col("text")).alias("ok")
    )


CLEANABLE = "CASE conv_id % 4 WHEN 0 THEN 'What is the ' || text WHEN 1 THEN '¿Qué ' || text WHEN 2 THEN 'qué ' || text ELSE text END"


@query("clean_query", f"SELECT conv_id, turn, {clean('q')} AS cleaned FROM (SELECT conv_id, turn, {CLEANABLE} AS q FROM conversations)")
def _clean(spark, sd):
    c = read(spark, sd, "conversations")
    return c.withColumn("q", F.expr(CLEANABLE)).select("conv_id", "turn", X.clean_query("q").alias("cleaned"))


@query("estimate_tokens", "SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens FROM documents")
def _tokens(spark, sd):
    return read(spark, sd, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@query("word_count", f"SELECT doc_id, len({ws_words(strict('text'))}) AS words FROM documents")
def _words(spark, sd):
    return docs(spark, sd).select("doc_id", X.word_count("text").alias("words"))


@query(
    "jaccard_words",
    r"""
    WITH s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'),
                                                        lambda w: length(w) > 2)) AS w FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0
             ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6)
             AS similarity
    FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
)
def _jaccard(spark, sd):
    d = docs(spark, sd).select("doc_id", X.word_set("text").alias("w"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(X.jaccard_sets(F.col("w"), F.col("v")), 6).alias("similarity"))


@query(
    "excerpt_tokens",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(string_split({nai('text')}, ' '),
          lambda t: length(t) >= 4), 1, 8), ' ') AS tokens FROM documents""",
)
def _etokens(spark, sd):
    return docs(spark, sd).select("doc_id", F.array_join(X.excerpt_tokens("text"), " ").alias("tokens"))


@query(
    "excerpt_window",
    f"""
    WITH d AS (SELECT doc_id, text, {nai('text')} AS norm,
                 list_slice(list_filter(string_split({nai("substring(text, 1000, 200)")}, ' '),
                                        lambda t: length(t) >= 4), 1, 8) AS toks FROM documents),
    p AS (SELECT *, list_min(list_filter(list_transform(toks, lambda t: strpos(norm, t)), lambda p: p > 0)) AS f FROM d)
    SELECT doc_id, CASE WHEN length(text) <= 600 THEN text
      ELSE substring(text, coalesce(greatest(0, floor((f - 1) * (length(text) / greatest(1, length(norm))::DOUBLE)) - 120), 0)::INT + 1, 600)
      END AS excerpt FROM p""",
)
def _ewindow(spark, sd):
    d = docs(spark, sd)
    return d.select("doc_id", X.excerpt_window("text", F.substring("text", 1000, 200), 600).alias("excerpt"))


# lists are made from the documents' lines; the fourth kind has none
LISTED = r"""'there are ' || (doc_id % 40) || E' items, 5% of 3.14\n' || replace(text, E'\n', CASE doc_id % 4
  WHEN 0 THEN E'\n- ' WHEN 1 THEN E'\n1) ' WHEN 2 THEN E'\nEC0217.01 and EC' || (1000 + doc_id) || ' ' ELSE E'\n' END)"""


def listed(spark, sd):
    i = F.col("doc_id")
    mark = (
        F.when(i % 4 == 0, F.lit("\n- "))
        .when(i % 4 == 1, F.lit("\n1) "))
        .when(i % 4 == 2, F.concat(F.lit("\nEC0217.01 and EC"), 1000 + i, F.lit(" ")))
        .otherwise(F.lit("\n"))
    )
    head = F.concat(F.lit("there are "), i % 40, F.lit(" items, 5% of 3.14\n"))
    return docs(spark, sd).withColumn("text", F.concat(head, F.replace("text", F.lit("\n"), mark)))


LIST_CTE = rf"""
    d AS (SELECT doc_id, {LISTED} AS t FROM documents),
    n AS (SELECT doc_id, t, len(regexp_extract_all(t, '(?m){BULLET}')) AS b,
                 len(regexp_extract_all(t, '(?mi){NUMBERED}')) AS m,
                 len(list_distinct(regexp_extract_all(t, '{CODE}'))) AS c,
                 strpos(t, nullif(regexp_extract(t, '(?mi){LIST_LINE}', 0), '')) - 1 AS list_start FROM d),
    l AS (SELECT *, greatest(CASE WHEN b >= 2 THEN b ELSE 0 END, CASE WHEN m >= 2 THEN m ELSE 0 END,
                             CASE WHEN c >= 2 THEN c ELSE 0 END) AS item_count FROM n)"""


@query(
    "detect_list",
    f"""WITH {LIST_CTE}
    SELECT doc_id, item_count > 0 AS is_list, item_count,
           concat_ws(',', CASE WHEN b >= 2 THEN 'bullets' END, CASE WHEN m >= 2 THEN 'numbered' END,
                     CASE WHEN c >= 2 THEN 'codes' END) AS patterns, list_start FROM l""",
)
def _list(spark, sd):
    d = listed(spark, sd).select("doc_id", L.detect_list("text").alias("l"))
    return d.select("doc_id", "l.is_list", "l.item_count", F.array_join("l.patterns", ",").alias("patterns"), "l.list_start")


# numbers of the stretch before the list: of 1 to 3 digits, not next to % . $ or another digit; the last from 3 to 100 counts
@query(
    "detect_count_mismatch",
    rf"""WITH {LIST_CTE},
    w AS (SELECT *, substring(t, greatest(0, list_start - 220)::INT + 1, (list_start - greatest(0, list_start - 220))::INT) AS head FROM l),
    x AS (SELECT *, regexp_extract_all(head, '[0-9A-Za-z_]+|[^0-9A-Za-z_]') AS p FROM w),
    y AS (SELECT *, list_filter(range(1, len(p) + 1), lambda i: regexp_full_match(p[i], '[0-9]{{1,3}}') AND coalesce(p[i - 1], ' ') NOT IN ('%', '.', '$')
            AND coalesce(p[i + 1], ' ') NOT IN ('%', '.', '$') AND coalesce(try_cast(p[i] AS INT), 0) BETWEEN 3 AND 100) AS spots FROM x),
    z AS (SELECT *, CASE WHEN item_count >= 3 AND list_start IS NOT NULL AND len(spots) > 0 THEN try_cast(p[list_last(spots)] AS INT) END AS told FROM y)
    SELECT doc_id, coalesce(told <= greatest(item_count * 3, 25) AND told >= item_count + 3, false) AS has_mismatch,
      told AS declared_total, item_count AS visible_items FROM z""",
)
def _mismatch(spark, sd):
    d = listed(spark, sd).withColumn("l", L.detect_list("text"))
    return d.select("doc_id", L.detect_count_mismatch("text", F.col("l")).alias("m")).select("doc_id", "m.*")


@query(
    "strip_reasoning",
    rf"""SELECT conv_id, turn, {jtrim(r"regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?i)Thought:[^\n]*(\n|$)', '', 'g')")} AS answer
    FROM (SELECT conv_id, turn, E'<think>a\nb</think>' || text || E'\nThought: x\n' || text AS t FROM conversations)""",
)
def _strip(spark, sd):
    t = F.concat(F.lit("<think>a\nb</think>"), F.col("text"), F.lit("\nThought: x\n"), F.col("text"))
    return read(spark, sd, "conversations").select("conv_id", "turn", X.strip_reasoning(t).alias("answer"))


@query("truncate_for_embedding", "SELECT doc_id, substring(text, 1, 8000) AS text FROM documents")
def _truncate(spark, sd):
    return read(spark, sd, "documents").select("doc_id", X.truncate_for_embedding("text").alias("text"))


@query(
    "vector_truncate",
    "SELECT vec_id, i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(32) r(i)",
)
def _vtruncate(spark, sd):
    e = read(spark, sd, "embeddings").select("vec_id", F.posexplode(X.vector_truncate("embedding", 32)).alias("i", "x"))
    return e.select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query(
    "distance_to_score",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN greatest(0.0, 1 - value / 20) END AS score FROM events""",
)
def _distance(spark, sd):
    i = F.col("event_id") % 3
    score = F.when(i == 0, F.col("value")).when(i == 1, F.lit(float("nan")))
    distance = F.when(i == 1, F.col("value") / 20)
    return read(spark, sd, "events").select("event_id", X.distance_to_score(score, distance).alias("score"))


META = """
    SELECT o_orderkey,
      coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END), ''),
               CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, 'UNKNOWN') AS source_name,
      CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS chunk_index,
      TRY_CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS INT) AS page,
      coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END), ''),
               CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END, 'UNKNOWN') || '::' ||
        coalesce((CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END)::VARCHAR, 'NA') || '::' ||
        coalesce(TRY_CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS INT)::VARCHAR, '') || '::' ||
        length(o_orderpriority) AS chunk_key
    FROM orders"""


@query("chunk_meta", META)
def _meta(spark, sd):
    k = F.col("o_orderkey")
    src = X.first_text(
        F.trim(F.when(k % 3 == 0, F.col("o_orderpriority"))), F.when(k % 3 == 1, F.col("o_orderstatus")), default="UNKNOWN"
    )
    idx = X.parse_int(F.when(k % 2 == 0, F.col("o_custkey")))
    page = X.parse_int("o_orderpriority")
    return read(spark, sd, "orders").select(
        "o_orderkey",
        src.alias("source_name"),
        idx.alias("chunk_index"),
        page.alias("page"),
        X.chunk_key(src, idx, page, F.col("o_orderpriority")).alias("chunk_key"),
    )


@query(
    "minmax_score",
    f"""WITH {HITS_SQL}
    SELECT query_id, vec_id, round((score - min(score) OVER w) /
      CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END, 4) AS norm_score
    FROM hits WINDOW w AS (PARTITION BY query_id)""",
)
def _minmax(spark, sd):
    h = minmax_score(hits(spark, sd), ["query_id"])
    return h.select("query_id", "vec_id", F.round("norm_score", 4).alias("norm_score"))


@query(
    "is_total_query",
    "SELECT doc_id, regexp_matches(text, '(?i)total|subtotal|suma|cantidad|cuantos|cuántos|count|amount') AS is_total FROM documents",
)
def _total(spark, sd):
    return read(spark, sd, "documents").select("doc_id", X.is_total_query("text").alias("is_total"))


ANSWERISH = """CASE doc_id % 6 WHEN 0 THEN 'Los Requisitos son ' || text WHEN 1 THEN text || ' se requieren: '
   WHEN 2 THEN 'los datos se utilizarán para ' || text WHEN 3 THEN text || ' Documento necesario' ELSE text END"""


@query(
    "direct_answer_boost",
    f"""SELECT doc_id, regexp_matches(t, '(?i){"|".join(X.DIRECT_ANSWER)}')::INT AS boost
    FROM (SELECT doc_id, {ANSWERISH} AS t FROM documents)""",
)
def _boost(spark, sd):
    return read(spark, sd, "documents").select("doc_id", X.direct_answer_boost(F.expr(ANSWERISH)).alias("boost"))


ANSWERS = """CASE (conv_id + turn) % 5 WHEN 0 THEN 'No especificado en los documentos proporcionados.'
   WHEN 1 THEN text || ' No especificado en los documentos proporcionados.'
   WHEN 2 THEN text || ' no hay información' WHEN 3 THEN 'Lo siento, ' || text ELSE text END"""


@query(
    "classify_response",
    rf"""WITH a AS (SELECT conv_id, turn, {nai(ANSWERS)} AS a FROM conversations),
    f AS (SELECT *, regexp_matches(a, '\b{X.ABSENT_PHRASE}\b') AS absent,
                 regexp_matches(a, '\b({X.PARTIAL_PHRASES})\b') AS part,
                 len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS n FROM a)
    SELECT conv_id, turn, CASE WHEN absent AND n <= 15 THEN 'ABSENT' WHEN absent OR part THEN 'PARTIAL' ELSE 'FULL' END
      AS response_type FROM f""",
)
def _response(spark, sd):
    c = read(spark, sd, "conversations").withColumn("a", F.expr(ANSWERS))
    return c.select("conv_id", "turn", X.classify_response("a").alias("response_type"))


@query(
    "is_refusal",
    f"""SELECT conv_id, turn, {" OR ".join(f"contains(lower(a), '{p}')" for p in X.REFUSALS)} AS refused
    FROM (SELECT conv_id, turn, {ANSWERS} AS a FROM conversations)""",
)
def _refusal(spark, sd):
    c = read(spark, sd, "conversations").withColumn("a", F.expr(ANSWERS))
    return c.select("conv_id", "turn", X.is_refusal("a").alias("refused"))


@query(
    "time_ago",
    """
    WITH e AS (SELECT event_id, floor((epoch_us(TIMESTAMP '2026-01-01 00:00:00')
                 - epoch_us(ts - to_days((event_id % 900)::INT) + to_days(CASE WHEN event_id % 2 = 0 THEN 730 ELSE 0 END))) / 1e6)::BIGINT AS s
               FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN s || ' seg' WHEN s // 60 < 60 THEN (s // 60) || ' min'
      WHEN s // 3600 < 24 THEN (s // 3600) || ' h' WHEN s // 86400 < 30 THEN (s // 86400) || ' d'
      WHEN s // 86400 // 30 < 12 THEN (s // 86400 // 30) || ' meses'
      ELSE (s // 86400 // 30 // 12) || ' años' END AS ago FROM e""",
)
def _ago(spark, sd):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    shifted = F.expr(
        "cast(ts as timestamp) - make_dt_interval(cast(event_id % 900 as int)) + make_dt_interval(if(event_id % 2 = 0, 730, 0))"
    )
    e = read(spark, sd, "events").withColumn("t", shifted)
    return e.select("event_id", X.time_ago("t", now).alias("ago"))


@query("pattern_tags")
def _tags(spark, sd):
    return P.pattern_tags(docs(spark, sd), "text").drop("text")
