"""Message log and lead operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import conversations as C
from hitweave.operators import leads as L
from hitweave.plans.registry import query
from hitweave.plans.tables import MESSAGES_SQL, messages, read

NOW_SQL = "TIMESTAMP '2026-01-01 00:00:00'"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


@query(
    "recent_history",
    rf"""WITH {MESSAGES_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY _id DESC) AS r FROM messages QUALIFY r <= 5)
    SELECT message_id, CASE WHEN count(*) > 1 THEN string_agg('- Role: ' || message_role || E'\n  - Mensaje: ' || message, E'\n' ORDER BY _id) ELSE '' END AS history,
      coalesce(arg_max(message, _id) FILTER (r > 1 AND message_role = 'user'), '') AS previous_question FROM r GROUP BY message_id""",
)
def _history(spark, sd):
    return C.recent_history(messages(spark, sd))


@query(
    "normalize_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT _id::VARCHAR AS _id, message_id, message_role, coalesce(nullif(model, ''), 'default') AS model, message, timestamp,
      user_id, nullif(contact_name, '') AS contact_name FROM messages""",
)
def _normalize(spark, sd):
    return C.normalize_messages(messages(spark, sd), now())


SUMMARY_SQL = f"""WITH {MESSAGES_SQL}
    SELECT message_id, arg_min(message, timestamp) AS first_message, coalesce(arg_max(message, timestamp) FILTER (message_role = 'user'), '') AS last_query,
      CASE WHEN trim(coalesce(arg_max(message, timestamp) FILTER (message_role = 'assistant'), '')) = '' THEN ''
           ELSE arg_max(message, timestamp) FILTER (message_role = 'assistant') END AS last_response,
      count(*) AS message_count, count(*) FILTER (message_role = 'user') AS user_messages,
      count(*) FILTER (message_role = 'assistant' AND trim(message) <> '') AS assistant_messages,
      max(timestamp) AS last_updated, min(timestamp) AS created_at,
      coalesce(nullif(arg_max(coalesce(model, ''), timestamp), ''), 'N/A') AS model, message_id AS user_id,
      nullif(trim(arg_max(contact_name, timestamp) FILTER (message_role = 'user')), '') AS user_name
    FROM messages GROUP BY message_id"""


@query("conversation_summary", SUMMARY_SQL)
def _summary(spark, sd):
    return C.conversation_summary(messages(spark, sd))


@query(
    "conversation_thread",
    f"""WITH {MESSAGES_SQL}, wanted AS (SELECT DISTINCT 'conv-' || conv_id AS message_id FROM conversations WHERE role = 'system')
    SELECT m.message_id, _id, message_role, message, timestamp FROM messages m SEMI JOIN wanted USING (message_id)""",
)
def _thread(spark, sd):
    c = read(spark, sd, "conversations").where("role = 'system'")
    wanted = c.select(F.concat(F.lit("conv-"), "conv_id").alias("message_id"))
    return C.conversation_thread(messages(spark, sd), wanted).select("message_id", "_id", "message_role", "message", "timestamp")


@query(
    "default_reply_fill",
    f"""WITH {MESSAGES_SQL}, m AS (SELECT * REPLACE (CASE WHEN message_role = 'assistant' AND turn < 6 THEN ' ' ELSE message END AS message) FROM messages),
    replies AS (SELECT DISTINCT 'conv-' || conv_id AS message_id, 'Reply ' || conv_id AS reply FROM conversations),
    s AS (SELECT message_id, count(*) FILTER (message_role = 'assistant' AND trim(message) <> '') AS n,
            min(timestamp) FILTER (message_role = 'user') AS t, arg_min(user_id, timestamp) FILTER (message_role = 'user') AS u FROM m GROUP BY message_id)
    SELECT message_id, message_role, message, timestamp, user_id FROM m UNION ALL
    SELECT message_id, 'assistant', reply, t + INTERVAL 1 SECOND, u FROM s JOIN replies USING (message_id) WHERE n = 0 AND t IS NOT NULL""",
)
def _default(spark, sd):
    blank = F.when(F.expr("message_role = 'assistant' AND turn < 6"), " ").otherwise(F.col("message"))
    m = messages(spark, sd).withColumn("message", blank)
    replies = read(spark, sd, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("message_id"), F.concat(F.lit("Reply "), "conv_id").alias("reply")
    )
    return C.default_reply_fill(m, replies.distinct()).drop("_id")


RESETTING = "CASE WHEN (_id + turn) % 5 = 2 THEN CASE WHEN turn % 2 = 0 THEN 'Reset' ELSE 'reset ' END ELSE message END"


def resetting(spark, sd):
    return messages(spark, sd).withColumn("message", F.expr(RESETTING))


RESET_SQL = f"""WITH {MESSAGES_SQL}, m AS (SELECT * REPLACE ({RESETTING} AS message) FROM messages),
    r AS (SELECT *, max(timestamp) FILTER (message_role = 'user' AND lower(message) = 'reset') OVER (PARTITION BY message_id) AS last FROM m)
    SELECT _id, message_id, message FROM r WHERE (last IS NULL OR timestamp > last) AND NOT (message_role = 'user' AND lower(message) = 'reset')"""


@query("reset_history", RESET_SQL)
def _reset(spark, sd):
    return C.reset_history(resetting(spark, sd)).select("_id", "message_id", "message")


JUDGE_ID = "CASE WHEN event_id % 6 = 0 THEN 'chunk-filter-' || user_id ELSE 'ev-' || user_id END"


@query(
    "append_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT message_id, message_role, message, timestamp FROM messages UNION ALL
    SELECT {JUDGE_ID}, 'assistant', event_type, ts FROM events WHERE event_id % 6 <> 0""",
)
def _append(spark, sd):
    e = read(spark, sd, "events").select(
        F.expr(JUDGE_ID).alias("message_id"), F.lit("assistant").alias("message_role"),
        F.col("event_type").alias("message"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    log = messages(spark, sd).select("message_id", "message_role", "message", "timestamp")
    return C.append_messages(log, e)


@query(
    "export_messages",
    f"""WITH {MESSAGES_SQL}
    SELECT message_id, coalesce(contact_name, '') AS contact_name, message_role, message,
           strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp FROM messages""",
)
def _export(spark, sd):
    return C.export_messages(messages(spark, sd))


# --- leads

LEADS_SQL = """leads AS (
    SELECT c_custkey AS _id, 'L' || (c_custkey * 2) AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name ELSE '' END AS whatsapp_name,
      CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'Old ' || c_name END AS name,
      CASE WHEN c_custkey % 3 = 0 THEN '+52-' || (c_custkey % 60) END AS phone_number,
      CASE WHEN c_custkey % 3 = 1 THEN '+1-' || c_custkey END AS phone,
      CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(c_custkey::INT) END AS registration_date,
      CASE WHEN c_custkey % 8 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS created_at,
      NULL::TIMESTAMP AS last_message_date, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' END AS updated_at,
      c_custkey % 3 AS conversation_count, c_custkey % 7 AS message_count,
      CASE WHEN c_nationkey % 3 = 0 THEN 'active' WHEN c_nationkey % 3 = 1 THEN '' END AS status,
      CASE WHEN c_custkey % 7 = 0 THEN 'conv-' || (c_custkey % 100) END AS own_message_id
    FROM customer)"""


def leads(spark, sd):
    k = F.col("c_custkey")
    return read(spark, sd, "customer").select(
        k.alias("_id"),
        F.concat(F.lit("L"), k * 2).alias("id"),
        F.when(k % 5 != 0, F.col("c_name")).otherwise("").alias("whatsapp_name"),
        F.when((k % 5 == 0) & (k % 2 == 0), F.concat(F.lit("Old "), "c_name")).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("+52-"), k % 60)).alias("phone_number"),
        F.when(k % 3 == 1, F.concat(F.lit("+1-"), k)).alias("phone"),
        F.when(k % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + k * 3600)).alias("registration_date"),
        F.when(k % 8 == 0, F.lit("2023-01-01").cast("timestamp")).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_message_date"),
        F.when(k % 2 == 0, F.lit("2024-06-01").cast("timestamp")).alias("updated_at"),
        (k % 3).alias("conversation_count"),
        (k % 7).alias("message_count"),
        F.when(F.col("c_nationkey") % 3 == 0, "active").when(F.col("c_nationkey") % 3 == 1, "").alias("status"),
        F.when(k % 7 == 0, F.concat(F.lit("conv-"), k % 100)).alias("own_message_id"),
    )


VIEW = f"""_id::VARCHAR AS id, coalesce(nullif(whatsapp_name, ''), nullif(name, ''), 'Sin nombre') AS whatsapp_name,
    coalesce(nullif(phone_number, ''), nullif(phone, ''), '') AS phone_number,
    coalesce(registration_date, created_at, {NOW_SQL}) AS registration_date, coalesce(last_message_date, updated_at, {NOW_SQL}) AS last_message_date,
    coalesce(nullif(conversation_count, 0), nullif(message_count, 0), 0) AS conversation_count, coalesce(nullif(status, ''), 'new') AS status"""


@query("list_leads", f"WITH {LEADS_SQL} SELECT {VIEW} FROM leads")
def _leads(spark, sd):
    return L.list_leads(leads(spark, sd), now())


@query(
    "lead_lookup",
    f"""WITH {LEADS_SQL}, wanted AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'L' || o_custkey * 2 END AS wanted FROM orders),
    m AS (SELECT wanted, min(_id) AS _id FROM wanted JOIN leads l ON l._id::VARCHAR = wanted OR l.id = wanted GROUP BY wanted)
    SELECT wanted, {VIEW.replace("_id::VARCHAR AS id", "l._id::VARCHAR AS id")} FROM m JOIN leads l ON l._id = m._id""",
)
def _lead(spark, sd):
    k = F.col("o_custkey")
    wanted = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("L"), k * 2)).alias("wanted")
    return L.lead_lookup(leads(spark, sd), read(spark, sd, "orders").select(wanted).distinct(), now())


@query(
    "update_leads",
    f"""WITH {LEADS_SQL},
    p AS (SELECT c_custkey AS _id, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'gone' WHEN 2 THEN 'new' END AS st,
            CASE WHEN c_custkey % 3 = 0 THEN 'New ' || c_name ELSE '' END AS nm, NULL AS ph FROM customer)
    SELECT l._id, coalesce(CASE WHEN st IN ('active', 'inactive', 'new') THEN st END, status) AS status,
      coalesce(nullif(nm, ''), whatsapp_name) AS whatsapp_name, phone_number FROM leads l LEFT JOIN p USING (_id)""",
)
def _update(spark, sd):
    k = F.col("c_custkey")
    p = read(spark, sd, "customer").select(
        k.alias("_id"),
        F.when(k % 4 == 0, "active").when(k % 4 == 1, "gone").when(k % 4 == 2, "new").alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("New "), "c_name")).otherwise("").alias("whatsapp_name"),
        F.lit(None).cast("string").alias("phone_number"),
    )
    return L.update_leads(leads(spark, sd), p).select("_id", "status", "whatsapp_name", "phone_number")


@query(
    "lead_messages",
    f"""WITH {LEADS_SQL}, {MESSAGES_SQL},
    ids AS (SELECT DISTINCT l._id AS lead_id, m.message_id FROM leads l JOIN messages m ON m.user_id = l.phone_number
            UNION SELECT _id, own_message_id FROM leads WHERE own_message_id IS NOT NULL),
    f AS (SELECT _id AS mid FROM messages ORDER BY timestamp, _id LIMIT 20)
    SELECT lead_id, m._id FROM ids JOIN messages m USING (message_id) UNION ALL
    SELECT l._id, mid FROM leads l, f WHERE l._id NOT IN (SELECT lead_id FROM ids)""",
)
def _lead_messages(spark, sd):
    ls = leads(spark, sd).select(F.col("_id").alias("lead_id"), "phone_number", "own_message_id")
    return L.lead_messages(ls, messages(spark, sd).select("_id", "message_id", "user_id", "timestamp")).select("lead_id", "_id")


CONV_SQL = """conv AS (
    SELECT o_orderkey AS conv_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 4 = 3 THEN 'L' || o_custkey END AS lead_id,
      CASE WHEN o_orderkey % 4 = 1 THEN o_custkey::VARCHAR END AS nested_lead_id,
      CASE WHEN o_orderkey % 4 = 2 THEN '+52-' || (o_custkey % 60) || '-' || (o_custkey // 60) END AS phone_number,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END AS date, o_orderdate::TIMESTAMP AS created_at, o_orderpriority, o_orderstatus FROM orders)"""


@query(
    "lead_conversations",
    f"""WITH {LEADS_SQL}, {CONV_SQL}, lp AS (SELECT _id, id, CASE WHEN phone_number IS NOT NULL THEN phone_number || '-' || (_id // 60) END AS ph FROM leads),
    pairs AS (SELECT DISTINCT l._id AS lead, conv_id FROM lp l JOIN conv c ON c.lead_id = l._id::VARCHAR OR c.lead_id = l.id OR c.nested_lead_id = l._id::VARCHAR
              OR c.nested_lead_id = l.id OR c.phone_number = l.ph)
    SELECT lead, conv_id, coalesce(date, created_at) AS date,
      'user:' || o_orderpriority || '|' || CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE 'assistant' END || ':' || o_orderstatus AS talk
    FROM pairs JOIN conv USING (conv_id)""",
)
def _lead_conversations(spark, sd):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ts = F.col("o_orderdate").cast("timestamp")

    def msg(role, user, content, text, message):
        return F.struct(
            role.alias("role"), user.alias("is_from_user"), content.alias("content"), text.alias("text"), message.alias("message"),
            F.lit(None).cast("timestamp").alias("timestamp"), ts.alias("created_at"),
        )

    none = F.lit(None).cast("string")
    talk = F.array(
        msg(F.lit("user"), F.lit(None).cast("boolean"), F.lit(""), F.col("o_orderpriority"), none),
        msg(F.lit(""), k % 3 == 0, none, none, F.col("o_orderstatus")),
    )
    conv = read(spark, sd, "orders").select(
        k.alias("conv_id"),
        F.when(k % 4 == 0, c.cast("string")).when(k % 4 == 3, F.concat(F.lit("L"), c)).alias("lead_id"),
        F.when(k % 4 == 1, c.cast("string")).alias("nested_lead_id"),
        F.when(k % 4 == 2, F.concat(F.lit("+52-"), c % 60, F.lit("-"), F.floor(c / 60))).alias("phone_number"),
        F.when(k % 2 == 0, ts).alias("date"),
        ts.alias("created_at"),
        talk.alias("messages"),
    )
    ls = leads(spark, sd).withColumn("phone_number", F.concat("phone_number", F.lit("-"), F.floor(F.col("_id") / 60)))
    out = L.lead_conversations(ls, conv, now())
    lines = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return out.select("lead", "conv_id", "date", lines.alias("talk"))
