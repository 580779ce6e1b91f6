"""Citations of generated answers, over the pages shown to every query."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.functions import text as X
from hitweave.operators import citations as C
from hitweave.operators.context import context_pages
from hitweave.plans.context_queries import contexts
from hitweave.plans.registry import query
from hitweave.plans.sqltext import WS_TRIM, nai
from hitweave.plans.tables import docs, read
from hitweave.session import write_table

# one answer per conversation turn: text, a stray section, and the section that counts
PAGE_A, PAGE_B = "(conv_id % 7)", "(conv_id % 5)"
QUOTE = "replace(replace(text, chr(34), ''), chr(10), ' ')"
ANSWER = f"""CASE (conv_id + turn) % 6 WHEN 0 THEN text
  WHEN 1 THEN 'No especificado en los documentos proporcionados.'
  ELSE text || chr(10) || 'Fuente:' || chr(10) || '- Página 99 — "not this one"' || chr(10) || 'more text' || chr(10) || 'fuente: ' || chr(10)
    || '- Página ' || {PAGE_A} || ' — "' || {QUOTE} || '"' || chr(10)
    || '-- pagina ' || {PAGE_A} || ' - "' || {QUOTE} || '" ' || chr(10)
    || '- PÁGINA ' || {PAGE_B} || ' – "short one"' || chr(10) || 'not a citation' END"""


def answers(spark, sd):
    c = read(spark, sd, "conversations")
    return c.select((F.col("conv_id") * (1 << 31) + F.col("turn")).alias("query_id"), F.expr(ANSWER).alias("answer"))


LINE = r'(?i)^-+\s*P[aá]gina\s+(\d+)\s*[—–-]\s*"([^"]+)"\s*$'
TAIL_CTE = rf"""
    a AS (SELECT conv_id * 2147483648 + turn AS query_id, {ANSWER} AS answer FROM conversations),
    h AS (SELECT *, len(regexp_extract_all(answer, '(?is).*?(?:(?:^|\n)Fuente:\s*)')) > 0 AS cited,
            list_sum(list_transform(regexp_extract_all(answer, '(?is).*?(?:(?:^|\n)Fuente:\s*)'), lambda x: length(x)))::INT AS body_at,
            length(list_last(regexp_extract_all(answer, '(?i)(?:^|\n)Fuente:\s*')))::INT AS head_len FROM a),
    s AS (SELECT *, substring(answer, body_at - head_len + 1) AS tail, substring(answer, body_at + 1) AS body FROM h)"""


@query(
    "one_bullet_per_page",
    rf"""WITH {TAIL_CTE},
    l AS (SELECT query_id, unnest(string_split(tail, E'\n')) AS line, unnest(range(0, len(string_split(tail, E'\n')))) AS i FROM s WHERE cited),
    p AS (SELECT *, regexp_extract(trim(line, {WS_TRIM}), '{LINE}', 1) AS page FROM l),
    k AS (SELECT query_id, string_agg(line, E'\n' ORDER BY i) AS kept FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY i) AS r FROM p) WHERE page = '' OR r = 1 GROUP BY query_id)
    SELECT query_id, CASE WHEN cited THEN substring(answer, 1, body_at - head_len) || kept ELSE answer END AS answer FROM s LEFT JOIN k USING (query_id)""",
)
def _bullets(spark, sd):
    return answers(spark, sd).select("query_id", C.one_bullet_per_page("answer").alias("answer"))


@query(
    "parse_citations",
    rf"""WITH {TAIL_CTE},
    l AS (SELECT query_id, trim(unnest(regexp_split_to_array(body, '\r?\n')), {WS_TRIM}) AS line,
                 unnest(range(0, len(regexp_split_to_array(body, '\r?\n')))) AS pos FROM s WHERE cited)
    SELECT query_id, pos, 'Página ' || regexp_extract(line, '{LINE}', 1) AS source_key, trim(regexp_extract(line, '{LINE}', 2), {WS_TRIM}) AS quote
    FROM l WHERE regexp_matches(line, '{LINE}')""",
)
def _parse(spark, sd):
    return C.parse_citations(answers(spark, sd), ["query_id"])


def pairs(spark, sd):
    """Documents with a quote made from their own words, mangled in four ways."""
    d = docs(spark, sd)
    i = F.col("doc_id") % 4
    w = X.words(F.col("text"))
    quote = (
        F.when(i == 0, F.array_join(F.slice(w, 3, 6), "  "))
        .when(i == 1, F.concat(F.array_join(F.slice(w, 2, 3), " "), F.lit("... "), F.array_join(F.slice(w, 9, 3), " ")))
        .when(i == 2, F.upper(F.array_join(F.slice(w, 5, 2), " ")))
        .otherwise(F.array_join(F.slice(w, 1, 20), " "))
    )
    return d.withColumn("quote", quote)


@query("quote_exists")
def _exists(spark, sd):
    return pairs(spark, sd).select("doc_id", C.quote_exists("quote", "text").alias("found"))


@query("fix_quote_length")
def _fix(spark, sd):
    return pairs(spark, sd).select("doc_id", C.fix_quote_length("quote", "text").alias("fixed"))


@query("best_span")
def _span(spark, sd):
    return pairs(spark, sd).select("doc_id", C.best_span("quote", "text").alias("span"))


def cited(spark, sd):
    """Answers to the example queries, quoting words of the first section shown."""
    # read by both sides: packed once
    pages = write_table(context_pages(contexts(spark, sd)), "pages")
    w = X.words("llm_text")
    i = F.col("query_id") % 5
    quote = (
        F.when(i == 0, F.array_join(F.slice(w, 2, 8), " "))
        .when(i == 1, F.array_join(F.slice(w, 2, 2), " "))
        .when(i == 2, F.array_join(F.slice(w, 1, 30), " "))
        .otherwise(F.lit("words that nobody wrote here"))
    )
    first = pages.groupBy("query_id").agg(F.min_by(F.struct("page_key", "llm_text"), "page_key").alias("p"))
    key = F.when(i == 4, F.lit("Página 0")).otherwise(F.col("p.page_key"))
    cites = first.select("query_id", F.lit(0).alias("pos"), key.alias("source_key"), F.col("p.llm_text").alias("llm_text"))
    return cites.withColumn("quote", F.replace(quote, F.lit('"'), F.lit(""))).drop("llm_text"), pages


@query("validate_citations")
def _validate(spark, sd):
    return C.validate_citations(*cited(spark, sd))


@query(
    "repair_flag",
    rf"""WITH {TAIL_CTE},
    c AS (SELECT query_id, count(*) AS citations, count(*) FILTER (length(line) % 3 <> 0) AS valid_citations FROM (
            SELECT query_id, trim(unnest(regexp_split_to_array(body, '\r?\n')), {WS_TRIM}) AS line FROM s WHERE cited)
          WHERE regexp_matches(line, '{LINE}') GROUP BY query_id),
    n AS (SELECT query_id, {nai("answer")} AS a FROM a),
    t AS (SELECT query_id, CASE WHEN regexp_matches(a, '\b{X.ABSENT_PHRASE}\b') AND len(string_split(a, ' ')) <= 15 THEN 'ABSENT'
            WHEN regexp_matches(a, '\b{X.ABSENT_PHRASE}\b') OR regexp_matches(a, '\b({X.PARTIAL_PHRASES})\b') THEN 'PARTIAL' ELSE 'FULL' END AS response_type FROM n)
    SELECT query_id, response_type, coalesce(citations, 0) AS citations, coalesce(valid_citations, 0) AS valid_citations,
      CASE WHEN coalesce(citations, 0) = 0 THEN response_type <> 'ABSENT' ELSE valid_citations = 0 END AS needs_repair
    FROM t LEFT JOIN c USING (query_id)""",
)
def _repair(spark, sd):
    a = answers(spark, sd)
    parsed = C.parse_citations(a, ["query_id"])
    body = F.regexp_replace(C._tail(F.col("answer")), r"(?i)^\n?Fuente:\s*", "")
    lines = a.select("query_id", F.posexplode(F.split(body, r"\r?\n", -1)).alias("pos", "l"))
    parsed = parsed.join(lines, ["query_id", "pos"]).withColumn("valid", F.length(X.trim_ws(F.col("l"))) % 3 != 0)
    return C.repair_flag(a, parsed)
