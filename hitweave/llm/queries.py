"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import conversations, decontam, gif, html, importance, licences, lm, mixing, neardup, pii, quality, sharding, toxicity
from hitweave.llm.registry import query, read
from hitweave.llm.sqltext import CRC_TABLE, crc32


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_documents(read(spark, sf_dir, "documents"), 16)
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return d.select("doc_id", "size", "text_crc32", law, "shard", "slot", none, "virtual_slot", "map_version")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


@query("op8_gif")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digest(gif.store_texts(read(spark, sf_dir, "documents")))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return s.select("doc_id", (quality.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.REJECT).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold("doc_id", 3) == 1
    s = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


@query("op1_licences")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(read(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op6_html")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return p.withColumn("n_chars", F.length("text").cast("long"))


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def _features_sql(table: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"


RESAMPLE_SQL = f"""
WITH {CRC_TABLE}, d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
words AS (SELECT row, {_features_sql("d")}),
asked AS (SELECT {_features_sql("benchmark")}),
buckets AS (SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT w FROM words UNION SELECT w FROM asked), crc_table),
s AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM asked JOIN buckets USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM words JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY row),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN sums USING (row)),
scored AS (
  SELECT doc_id, n_features, weight,
    weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM weighed),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND r <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN r END AS rank
FROM ordered
"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_language_model")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.fold("doc_id", 7) == 2
    s = lm.lm_scores(read(spark, sf_dir, "documents"), ~held_out)
    return s.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


# situations: 0 nothing yet, 1 after a system message, 2 after the user, 3 after the assistant
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT named.*, {crc32("name")} % 20 AS kind FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS times(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN convs c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM placed),
messages AS (
  SELECT conv, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
      WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen),
inserts(q, p, more) AS (
  VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
moves(p, initial, letter, price, r) AS (
  SELECT q, '-', 'D', 4, q FROM (VALUES (0), (1), (2), (3)) AS v(q)
  UNION ALL VALUES (0, '-', 'R', 3, 2), (1, '-', 'R', 3, 2), (3, '-', 'R', 3, 2), (2, '-', 'R', 3, 3),
    (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3)),
best(conv, i, q, b) AS (
  SELECT conv, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'edits': ''}} FROM convs
  UNION ALL
  SELECT best.conv, best.i + 1, moves.r, min({{
    'cost': b.cost + 3 * length(more) + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
    'edits': b.edits || more || letter}})
  FROM best JOIN inserts ON best.q = inserts.q JOIN moves ON inserts.p = moves.p
    JOIN messages m ON m.conv = best.conv AND m.i = best.i + 1
  WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR moves.initial = m.initial)
  GROUP BY best.conv, best.i + 1, moves.r),
sizes AS (SELECT convs.conv, conv_id, count(i) AS n FROM convs LEFT JOIN messages USING (conv) GROUP BY convs.conv, conv_id),
chosen AS (
  SELECT sizes.conv, min({{'cost': b.cost + 3 * length(more), 'edits': b.edits || more}}) AS b
  FROM sizes JOIN best ON best.conv = sizes.conv AND best.i = n JOIN inserts ON best.q = inserts.q AND p IN (0, 3)
  GROUP BY sizes.conv),
letters AS (SELECT conv, unnest(string_split(b.edits, '')) AS letter, generate_subscripts(string_split(b.edits, ''), 1) AS place FROM chosen WHERE b.edits <> ''),
numbered AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY place) AS i FROM letters),
kept AS (
  SELECT k.conv, place, letter, role, text, row_number() OVER w - 1 AS j,
    first_value(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER w AS shift
  FROM numbered k LEFT JOIN messages m ON m.conv = k.conv AND m.i = k.i AND letter <> 'I'
  WHERE letter <> 'D' WINDOW w AS (PARTITION BY k.conv ORDER BY place)),
lines AS (
  SELECT conv, place, CASE WHEN letter = 'K' THEN role WHEN (j - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line
  FROM kept),
texts AS (SELECT conv, string_agg(line, chr(10) ORDER BY place) AS body FROM lines GROUP BY conv),
pairs AS (SELECT conv, fault, turn, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM messages),
figures AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.edits AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM sizes JOIN chosen USING (conv) LEFT JOIN figures USING (conv) LEFT JOIN texts USING (conv)
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(conversations.damage(read(spark, sf_dir, "conversations")))
