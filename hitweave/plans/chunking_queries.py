"""Document -> chunk operators over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import chunking as C
from hitweave.operators.language import language_profiles, tag_language
from hitweave.plans.registry import query
from hitweave.plans.sqltext import WS_TRIM
from hitweave.plans.tables import docs, read, spread

PAT = r"[^.!?]*[.!?]+(?:\s|$)|[^.!?\n]+(?:\n|$)"

# a sentence starts at its first occurrence at or after the end of the one before
SENT_CTE = rf"""
    split AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '{PAT}'), lambda m: trim(m, {WS_TRIM})),
                                               lambda m: m <> '') AS s FROM documents),
    walked AS (SELECT doc_id, s, list_reduce(
        list_transform(s, lambda m: {{'t': m, 'pos': 0::BIGINT, 'ps': []::BIGINT[]}}),
        lambda acc, x: {{'t': x.t, 'pos': strpos(substring(text, acc.pos + 1), x.t) - 1 + acc.pos + length(x.t),
                        'ps': list_append(acc.ps, strpos(substring(text, acc.pos + 1), x.t) - 1 + acc.pos)}},
        {{'t': '', 'pos': 0::BIGINT, 'ps': []::BIGINT[]}}) AS w FROM split),
    sents AS (SELECT doc_id, unnest(range(0, len(s))) AS sentence_no, unnest(s) AS sentence, unnest(w.ps)::INT AS start FROM walked)"""

SENT_CHUNK_CTE = rf"""{SENT_CTE},
    grouped AS (SELECT doc_id, list(sentence ORDER BY sentence_no) AS s, list(start ORDER BY sentence_no) AS p,
                       count(*)::INT AS n FROM sents GROUP BY doc_id),
    wins AS (SELECT g.*, text, unnest(range(0, CASE WHEN n <= 5 THEN 1 ELSE ceil((n - 5) / 4.0)::INT + 1 END))::INT AS i,
                    (CASE WHEN n <= 5 THEN 1 ELSE ceil((n - 5) / 4.0)::INT + 1 END) AS total_chunks
             FROM grouped g JOIN documents USING (doc_id)),
    sent_chunks AS (
      SELECT doc_id, i + 1 AS chunk_index, total_chunks, CASE WHEN i > 0 THEN i END AS prev_chunk_index,
        CASE WHEN i + 1 < total_chunks THEN i + 2 END AS next_chunk_index,
        CASE WHEN n <= 5 THEN text ELSE array_to_string(s[i * 4 + 1 : least(i * 4 + 5, n)], ' ') END AS text,
        CASE WHEN n <= 5 THEN text
             WHEN greatest(i * 4, least(i * 4 + 5, n) - 1) > i * 4
             THEN array_to_string(s[i * 4 + 1 : least(i * 4 + 5, n) - 1], ' ')
             ELSE array_to_string(s[i * 4 + 1 : least(i * 4 + 5, n)], ' ') END AS content_without_overlap,
        CASE WHEN n <= 5 THEN 0 ELSE p[i * 4 + 1] END AS start_position,
        CASE WHEN n <= 5 THEN length(text) ELSE p[least(i * 4 + 5, n)] + length(s[least(i * 4 + 5, n)]) END AS end_position
      FROM wins)"""


def sent_chunks(spark, sd):
    return C.sentence_chunk(docs(spark, sd))


@query("sentence_split", f'WITH {SENT_CTE} SELECT doc_id, sentence_no, sentence, start, (start + length(sentence))::INT AS "end" FROM sents')
def _split(spark, sd):
    return C.sentence_split(docs(spark, sd))


@query("sentence_chunk", f"WITH {SENT_CHUNK_CTE} SELECT * FROM sent_chunks")
def _sentence_chunk(spark, sd):
    return sent_chunks(spark, sd)


@query("recursive_chunk")
def _recursive(spark, sd):
    return C.recursive_chunk(docs(spark, sd))


# the first sentence of every line becomes a question; Spanish, English and plain thirds
FAQ = r"""CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '(?m)^([^.?\n]+)\.', E'¿\\1?\n', 'g')
          WHEN 1 THEN regexp_replace(text, '(?m)^([^.?\n]+)\.', E'\\1?\n', 'g') ELSE text END"""


def faq(spark, sd):
    i, t = F.col("doc_id") % 3, F.col("text")
    line = r"(?m)^([^.?\n]+)\."
    return docs(spark, sd).withColumn(
        "text",
        F.when(i == 0, F.regexp_replace(t, line, "¿$1?\n")).when(i == 1, F.regexp_replace(t, line, "$1?\n")).otherwise(t),
    )


ES = r"(¿[^?]+\?)\s*([^¿]+)|[^¿]+|¿"
EN = r"([A-Z][^?]*\?)\s*([^A-Z]*[^?]*\z|[^A-Z]+)|[A-Z]|[^A-Z]+"


def _pairs_sql(name: str, pat: str, src: str) -> str:
    return rf"""
    {name}_t AS (SELECT doc_id, unnest(regexp_extract_all(t, '{pat}', 0)) AS w, unnest(regexp_extract_all(t, '{pat}', 1)) AS q,
                   unnest(regexp_extract_all(t, '{pat}', 2)) AS a,
                   generate_subscripts(regexp_extract_all(t, '{pat}', 0), 1) AS i FROM {src}),
    {name}_p AS (SELECT doc_id, trim(q, {WS_TRIM}) AS question,
                   trim(regexp_replace(trim(a, {WS_TRIM}), '\n{{3,}}', E'\n\n', 'g'), {WS_TRIM}) AS answer, trim(a, {WS_TRIM}) AS raw,
                   sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS s,
                   sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}_t),
    {name} AS (SELECT * FROM {name}_p WHERE question <> '' AND length(raw) > 20 AND length(answer) <= 8000)"""


QA_CTE = rf"""
    d AS (SELECT doc_id, {FAQ} AS t FROM documents), {_pairs_sql("es", ES, "d")},
    few AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM es GROUP BY doc_id HAVING count(*) >= 3)),
    {_pairs_sql("en", EN, "few")},
    pairs AS (SELECT * FROM es UNION ALL
              SELECT * FROM en WHERE NOT EXISTS (SELECT 1 FROM es WHERE es.doc_id = en.doc_id AND en.s >= es.s AND en.s < es.e)),
    gaps AS (SELECT p.*, t, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last
             FROM pairs p JOIN d USING (doc_id)),
    agg AS (SELECT doc_id, count(*) AS n_pairs, sum(length(question) + length(answer)) AS chars, max(e) AS fin,
                   string_agg(CASE WHEN s > last THEN substring(t, last::INT + 1, (s - last)::INT) ELSE '' END, '' ORDER BY s) AS head
            FROM gaps GROUP BY doc_id)"""


@query(
    "detect_qa",
    rf"""WITH {QA_CTE}
    SELECT doc_id, coalesce(n_pairs, 0) AS n_pairs, round(CASE WHEN length(t) > 0 THEN coalesce(chars, 0) / length(t)::DOUBLE ELSE 0 END, 4) AS coverage,
      coalesce(n_pairs, 0) >= 3 AND coalesce(chars, 0) / length(t)::DOUBLE >= 0.6 AS is_qa,
      trim(coalesce(head, '') || substring(t, coalesce(fin, 0)::INT + 1), {WS_TRIM}) AS leftover
    FROM d LEFT JOIN agg USING (doc_id)""",
)
def _detect_qa(spark, sd):
    d = C.with_qa_structure(faq(spark, sd))
    return d.select(
        "doc_id",
        F.size("qa_pairs").alias("n_pairs"),
        F.round("qa_coverage", 4).alias("coverage"),
        F.col("qa_is_qa").alias("is_qa"),
        F.col("qa_leftover").alias("leftover"),
    )


@query("qna_chunk")
def _qna(spark, sd):
    named = F.concat(F.lit("doc-"), F.when(F.col("doc_id") % 10 == 1, F.lit("QnA-")).otherwise(""), "doc_id")
    return C.qna_chunk(faq(spark, sd).withColumn("source_name", named))


@query(
    "split_collections",
    f"""WITH {QA_CTE}
    SELECT CASE WHEN n_pairs >= 3 AND chars / length(t)::DOUBLE >= 0.6 THEN 'qna' ELSE 'doc' END AS collection, count(*) AS pairs
    FROM pairs JOIN agg USING (doc_id) JOIN d USING (doc_id) GROUP BY 1""",
)
def _collections(spark, sd):
    d = C.with_qa_structure(faq(spark, sd)).select("doc_id", "qa_is_qa", F.explode("qa_pairs").alias("p"))
    c = C.split_collections(d, "qa_is_qa")
    return c.groupBy("collection").agg(F.count("*").alias("pairs"))


@query(
    "link_chunks",
    """SELECT vec_id, label, row_number() OVER w AS chunk_index, count(*) OVER (PARTITION BY label) AS total_chunks,
      CASE WHEN row_number() OVER w > 1 THEN row_number() OVER w - 1 END AS prev_chunk_index,
      CASE WHEN row_number() OVER w < count(*) OVER (PARTITION BY label) THEN row_number() OVER w + 1 END AS next_chunk_index
    FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
)
def _link(spark, sd):
    e = read(spark, sd, "embeddings").select("vec_id", "label")
    return C.link_chunks(e, "label", "vec_id")


@query("tag_language")
def _language(spark, sd):
    """Each half of the documents is tagged by profiles that the other half gave."""
    d = spread(read(spark, sd, "documents").select("doc_id", "lang", "text"), "doc_id")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    a, b = d.where(half == 0), d.where(half == 1)
    tagged = tag_language(a, language_profiles(b), "doc_id").unionByName(tag_language(b, language_profiles(a), "doc_id"))
    return tagged.select("doc_id", "lang", "language", "confidence")


@query(
    "process_stats",
    f"""WITH {SENT_CHUNK_CTE}
    SELECT doc_id, length(d.text) AS total_characters, count(c.doc_id) AS total_chunks, lang AS detected_language,
           'sentence' AS chunker_used
    FROM documents d LEFT JOIN sent_chunks c USING (doc_id) GROUP BY ALL""",
)
def _stats(spark, sd):
    d = read(spark, sd, "documents").select("doc_id", "lang", "text")
    return C.process_stats(d, C.sentence_chunk(docs(spark, sd)), "doc_id", "sentence")
