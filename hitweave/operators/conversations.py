"""Message log operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.ranking import top_rank
from hitweave.functions.text import first_text, text_or_empty, trim_ws


def blank(c: Column | str) -> Column:
    return trim_ws(text_or_empty(c)) == ""


def recent_history(messages: DataFrame, last: int = 5) -> DataFrame:
    """Per conversation the last five messages as one text, oldest first, and the user message before the newest."""
    top = top_rank(messages, ["message_id"], [F.desc("_id")], last, "_r")
    line = F.concat(F.lit("- Role: "), "message_role", F.lit("\n  - Mensaje: "), "message")
    lines = F.array_sort(F.collect_list(F.struct("_id", line.alias("t"))))
    previous = F.max_by(F.when((F.col("_r") > 1) & (F.col("message_role") == "user"), F.col("message")),
                        F.when((F.col("_r") > 1) & (F.col("message_role") == "user"), F.col("_id")))
    out = top.groupBy("message_id").agg(lines.alias("_l"), previous.alias("_p"))
    history = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    return out.select(
        "message_id",
        F.when(F.size("_l") > 1, history).otherwise("").alias("history"),
        F.coalesce("_p", F.lit("")).alias("previous_question"),
    )


def normalize_messages(messages: DataFrame, now: Column) -> DataFrame:
    """Field defaults; newest first."""
    return messages.select(
        F.col("_id").cast("string").alias("_id"),
        first_text("message_id", default="").alias("message_id"),
        first_text("message_role", default="unknown").alias("message_role"),
        first_text("model", default="default").alias("model"),
        first_text("message", default="").alias("message"),
        F.coalesce("timestamp", now).alias("timestamp"),
        first_text("user_id", default="Unknown User").alias("user_id"),
        first_text("contact_name").alias("contact_name"),
    ).orderBy(F.desc("timestamp"), F.desc("_id"))


def conversation_summary(messages: DataFrame) -> DataFrame:
    """One row per conversation. The same aggregate serves batch and stream."""
    at = F.struct("timestamp", "_id")

    def last(role: str, value: str) -> Column:
        mine = F.col("message_role") == role
        return F.max_by(F.when(mine, F.col(value)), F.when(mine, at))

    agg = messages.groupBy("message_id").agg(
        F.min_by("message", at).alias("first_message"),
        last("user", "message").alias("_q"),
        last("assistant", "message").alias("_a"),
        last("user", "contact_name").alias("_c"),
        F.max_by("model", at).alias("_m"),
        F.count("*").alias("message_count"),
        F.count_if(F.col("message_role") == "user").alias("user_messages"),
        F.count_if((F.col("message_role") == "assistant") & ~blank("message")).alias("assistant_messages"),
        F.max("timestamp").alias("last_updated"),
        F.min("timestamp").alias("created_at"),
    )
    return agg.select(
        "message_id",
        "first_message",
        text_or_empty("_q").alias("last_query"),
        F.when(blank("_a"), "").otherwise(F.col("_a")).alias("last_response"),
        "message_count",
        "user_messages",
        "assistant_messages",
        "last_updated",
        "created_at",
        first_text("_m", default="N/A").alias("model"),
        first_text("message_id", default="Unknown User").alias("user_id"),
        F.nullif(trim_ws(F.col("_c")), F.lit("")).alias("user_name"),
    )


def conversation_thread(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted conversations in time order; sorting by both keys splits a long one over tasks."""
    return messages.join(wanted.select("message_id").distinct(), "message_id", "left_semi").orderBy(
        "message_id", "timestamp", "_id"
    )


def default_reply_fill(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Conversations without a real assistant turn get their configured reply one second after the first user turn."""
    mine = F.col("message_role") == "user"
    state = (
        messages.join(replies.select("message_id"), "message_id", "left_semi")
        .groupBy("message_id")
        .agg(
            F.count_if((F.col("message_role") == "assistant") & ~blank("message")).alias("_n"),
            F.min(F.when(mine, F.struct("timestamp", "_id", "user_id"))).alias("_u"),
        )
    )
    added = state.where((F.col("_n") == 0) & F.col("_u").isNotNull()).join(replies, "message_id").select(
        F.lit(None).cast("long").alias("_id"),
        "message_id",
        F.lit("assistant").alias("message_role"),
        F.col("reply").alias("message"),
        (F.col("_u.timestamp") + F.expr("INTERVAL 1 SECOND")).alias("timestamp"),
        F.col("_u.user_id").alias("user_id"),
    )
    return messages.select(*added.columns).unionByName(added)


def is_reset() -> Column:
    return (F.col("message_role") == "user") & (F.lower("message") == "reset")


def last_resets(messages: DataFrame) -> DataFrame:
    return messages.where(is_reset()).groupBy("message_id").agg(F.max("timestamp").alias("_reset"))


def reset_history(messages: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Only what came after a conversation's last reset; the resets themselves are not kept."""
    r = last_resets(messages) if resets is None else resets
    kept = messages.join(r, "message_id", "left")
    after = F.col("_reset").isNull() | (F.col("timestamp") > F.col("_reset"))
    return kept.where(after & ~is_reset()).drop("_reset")


def append_messages(log: DataFrame, turns: DataFrame) -> DataFrame:
    """New turns joined to the log; internal judge calls are not logged."""
    return log.unionByName(turns.where(~F.startswith(F.col("message_id"), F.lit("chunk-filter"))), allowMissingColumns=True)


def export_messages(messages: DataFrame) -> DataFrame:
    """The five export columns, oldest first; write with ``sources.write_csv``."""
    return messages.orderBy("timestamp", "_id").select(
        "message_id",
        text_or_empty("contact_name").alias("contact_name"),
        "message_role",
        "message",
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")).alias("timestamp"),
    )
