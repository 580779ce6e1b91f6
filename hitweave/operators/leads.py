"""Lead operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.text import first_text, text_or_empty

# fixed values
STATUSES = ("active", "inactive", "new")


def lead_view(now: Column) -> list[Column]:
    """Old and new field names under one, with defaults."""
    count = F.coalesce(F.nullif("conversation_count", F.lit(0)), F.nullif("message_count", F.lit(0)), F.lit(0))
    return [
        F.col("_id").cast("string").alias("id"),
        first_text("whatsapp_name", "name", default="Sin nombre").alias("whatsapp_name"),
        first_text("phone_number", "phone", default="").alias("phone_number"),
        F.coalesce("registration_date", "created_at", now).alias("registration_date"),
        F.coalesce("last_message_date", "updated_at", now).alias("last_message_date"),
        count.alias("conversation_count"),
        first_text("status", default="new").alias("status"),
    ]


def list_leads(leads: DataFrame, now: Column) -> DataFrame:
    """All leads, newest registration first (by the new field)."""
    return leads.orderBy(F.desc("registration_date"), "_id").select(*lead_view(now))


def lead_lookup(leads: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Leads whose ``_id`` or own ``id`` equals a wanted id: two equality joins, one row per wanted id."""
    by_key = leads.withColumn("wanted", F.col("_id").cast("string")).join(wanted, "wanted", "left_semi")
    by_id = leads.withColumn("wanted", F.col("id")).join(wanted, "wanted", "left_semi")
    both = by_key.select("wanted", "_id").unionByName(by_id.select("wanted", "_id"))
    first = both.groupBy("wanted").agg(F.min("_id").alias("_id"))
    return first.join(leads, "_id").select("wanted", *lead_view(now))


def update_leads(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update of the three writable fields; invalid or empty values change nothing."""
    p = patches.select(
        "_id",
        F.when(F.col("status").isin(*STATUSES), F.col("status")).alias("_status"),
        F.nullif("whatsapp_name", F.lit("")).alias("_name"),
        F.nullif("phone_number", F.lit("")).alias("_phone"),
    )
    new = {"status": "_status", "whatsapp_name": "_name", "phone_number": "_phone"}
    out = leads.join(p, "_id", "left").withColumns({c: F.coalesce(F.col(v), F.col(c)) for c, v in new.items()})
    return out.select(*leads.columns)


# leads of one phone that meet its messages in one go
DEALT = 512


def _by_phone(leads: DataFrame, messages: DataFrame) -> DataFrame:
    """All pairs of a lead and a message with the same phone.

    A few phones may have most rows: the leads of each are dealt to as many parts as hold some ``DEALT`` of them, and its
    messages go to each part. So a copy of a message is shuffled for hundreds of pairs.
    """
    parts = leads.groupBy("phone_number").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("_n"))
    dealt = leads.join(parts, "phone_number").withColumn("_part", F.pmod(F.xxhash64("lead_id"), F.col("_n")).cast("int")).drop("_n")
    copies = messages.join(parts, "phone_number").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    pairs = copies.hint("shuffle_merge").join(dealt, ["phone_number", "_part"])
    return pairs.select("lead_id", *messages.drop("phone_number").columns)


def lead_messages(leads: DataFrame, messages: DataFrame, fallback: int = 20) -> DataFrame:
    """Messages of the conversations a lead's phone wrote in, and of its own one.

    A lead without any conversation gets the first ``fallback`` messages of the log.
    """
    own = leads.where(text_or_empty("own_message_id") != "").select("lead_id", F.col("own_message_id").alias("message_id"))
    wrote = leads.where(text_or_empty("phone_number") != "").select("lead_id", "phone_number").distinct()
    phones = messages.select(F.col("user_id").alias("phone_number"), "message_id").distinct()
    # a lead with one phone meets each conversation of it once: only those with several phones need their pairs compared
    several = wrote.groupBy("lead_id").agg(F.count("*").alias("n")).where("n > 1").select("lead_id")
    # rows without lead_id count as one lead
    single = wrote.where("lead_id IS NOT NULL").join(several, "lead_id", "left_anti")
    rest_of = wrote.join(several, "lead_id", "left_semi").unionByName(wrote.where("lead_id IS NULL"))
    many = rest_of.join(phones, "phone_number").select("lead_id", "message_id")
    # its own conversation, if it is none of those
    new = own.join(single, "lead_id", "left").join(phones.withColumn("_known", F.lit(True)), ["phone_number", "message_id"], "left")
    ids = many.unionByName(new.where("_known IS NULL").select("lead_id", "message_id")).distinct()
    of_phone = phones.join(messages, "message_id")
    found = _by_phone(single, of_phone.select("phone_number", *messages.columns)).unionByName(
        ids.join(messages, "message_id").select("lead_id", *messages.columns)
    )
    served = single.join(phones.select("phone_number").distinct(), "phone_number", "left_semi").select("lead_id")
    first = messages.orderBy("timestamp", "_id").limit(fallback)
    item = F.struct(*messages.columns)
    # at most ``fallback`` rows, attached as one value
    head = first.agg(F.collect_list(item).alias("m")).scalar()
    served = served.unionByName(ids.select("lead_id")).distinct()
    rest = leads.join(served, "lead_id", "left_anti")
    plain = rest.select("lead_id", F.explode(head).alias("m")).select("lead_id", "m.*")
    return found.unionByName(plain.select("lead_id", *messages.columns))


def lead_conversations(leads: DataFrame, conversations: DataFrame, now: Column) -> DataFrame:
    """Conversations that name the lead in one of two shapes, or its phone: a union of equality joins."""
    keyed = [("lead_id", "_id"), ("nested_lead_id", "_id"), ("lead_id", "id"), ("nested_lead_id", "id")]
    parts = None
    for theirs, ours in keyed:
        j = conversations.select("conv_id", F.col(theirs).alias("k")).where(F.col("k").isNotNull()).join(
            leads.select(F.col(ours).cast("string").alias("k"), F.col("_id").alias("lead")), "k"
        )
        parts = j.select("lead", "conv_id") if parts is None else parts.unionByName(j.select("lead", "conv_id"))
    phone = conversations.select("conv_id", "phone_number").join(
        leads.where(text_or_empty("phone_number") != "").select("phone_number", F.col("_id").alias("lead")), "phone_number"
    )
    pairs = parts.unionByName(phone.select("lead", "conv_id")).distinct()
    view = F.transform(
        F.col("messages"),
        lambda m: F.struct(
            F.coalesce(F.nullif(m["role"], F.lit("")), F.when(m["is_from_user"], "user").otherwise("assistant")).alias("role"),
            F.coalesce(
                F.nullif(m["content"], F.lit("")), F.nullif(m["text"], F.lit("")), F.nullif(m["message"], F.lit("")), F.lit("")
            ).alias("content"),
            F.coalesce(m["timestamp"], m["created_at"], now).alias("timestamp"),
        ),
    )
    shown = conversations.select("conv_id", F.coalesce("date", "created_at", now).alias("date"), view.alias("messages"))
    return pairs.join(shown, "conv_id")
