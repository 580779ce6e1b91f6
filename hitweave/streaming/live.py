"""Live views over the message log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from hitweave.operators.conversations import conversation_summary, is_reset
from hitweave.streaming.ingest import with_trigger


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stream_conversation_summary(
    messages: DataFrame, out: str, checkpoint: str, dedupe_after: str | None = None, every: str | None = None
):
    """Keep ``conversation_summary`` up to date; changed conversations are written per batch.

    ``dedupe_after`` (a watermark delay) also drops redelivered messages and bounds the ids that are remembered; the
    summaries themselves are one row for each conversation. ``every`` keeps the query running.
    """
    if dedupe_after:
        messages = messages.withWatermark("timestamp", dedupe_after).dropDuplicatesWithinWatermark(["message_id", "_id"])
    writer = conversation_summary(messages).writeStream.outputMode("update").foreachBatch(_batch_writer(out))
    return with_trigger(writer.option("checkpointLocation", checkpoint), every).start()


def compact_summary(spark: SparkSession, out: str, target: str) -> None:
    """Write the current row of every conversation to a new folder as one batch."""
    latest_summary(spark, out).write.mode("overwrite").parquet(f"{target}/batch_id=0")


def latest_summary(spark: SparkSession, out: str) -> DataFrame:
    """Current row of every conversation."""
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in ("message_id", "batch_id")]
    return rows.groupBy("message_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select("message_id", "s.*")


_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_NEVER = -(1 << 63)
_CHANGES = "message_id string, kind string, ts long, body string"


class ResetProcessor(StatefulProcessor):
    """Keyed state of a conversation: its last reset, its messages since then, and when it has rested long enough.

    Messages lie in a list of the state store, which is appended to; only a newer reset reads the list, and mostly clears it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reset = handle.getValueState("reset", "ts long")
        self.rests = handle.getValueState("rests", "ms long")
        self.messages = handle.getListState("messages", "ts long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = self.reset.get()[0] if self.reset.exists() else _NEVER
        known, newest = since, _NEVER
        for f in rows:
            newest = max(newest, int(f["ts"].max()))
            resets = f.loc[f["is_reset"], "ts"]
            if len(resets) and (int(resets.max()) > since or not self.reset.exists()):
                since = max(since, int(resets.max()))
                self.reset.update((since,))
                left = [(m[0], m[1]) for m in self.messages.get() if m[0] > since]  # what came too early
                self.messages.clear()
                if left:
                    self.messages.put(left)
            some = f[~f["is_reset"] & ((f["ts"] > since) | (not self.reset.exists()))]
            if len(some):
                self.messages.appendList(list(zip(some["ts"].astype(int).tolist(), some["body"].tolist(), strict=True)))
        until = self.rests.get()[0] if self.rests.exists() else 0
        if newest // 1000 > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(newest // 1000)
            self.rests.update((newest // 1000,))
        if since > known:
            yield pd.DataFrame({"message_id": [key[0]], "kind": ["reset"], "ts": [since], "body": [None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        for m in self.messages.get():
            block.append((key[0], "closed", m[0], m[1]))
            if len(block) == 1000:
                yield pd.DataFrame(block, columns=["message_id", "kind", "ts", "body"])
                block = []
        yield pd.DataFrame(block, columns=["message_id", "kind", "ts", "body"])
        for state in (self.messages, self.reset, self.rests):
            state.clear()

    def close(self) -> None:
        pass


def stream_reset(messages: DataFrame, out: str, checkpoint: str, time_out: str = "30 days", every: str | None = None):
    """Streaming form of ``reset_history`` with keyed state: a reset clears what the state holds of its conversation.

    The state of a conversation goes when no message came for ``time_out`` (event time): what it held is written to ``out``
    for good, where a later reset still hides it. Messages later than that are left out. The result does not depend on how
    messages are dealt into batches. ``live_history`` reads the state itself and what was written, not the message log.
    """
    spark = messages.sparkSession
    when = F.coalesce(F.unix_micros("timestamp"), F.lit(_NEVER))
    rows = messages.withWatermark("timestamp", time_out).select(
        "message_id", is_reset().alias("is_reset"), when.alias("ts"), F.to_json(F.struct(*messages.columns), _TIMES).alias("body"), "timestamp"
    )
    # as in the batch form, what is neither a reset nor none is left out
    keyed = rows.where(F.col("is_reset").isNotNull()).groupBy("message_id")
    changes = keyed.transformWithStateInPandas(ResetProcessor(), _CHANGES, "append", "eventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch_id={batch_id}")

    writer = changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _STATE)  # the query keeps it
    try:
        return with_trigger(writer, every).start()
    finally:
        spark.conf.set(name, before)


def live_history(spark: SparkSession, out: str, checkpoint: str, schema: StructType) -> DataFrame:
    """The messages that no later reset has cleared: those in the state, and those of conversations at rest."""
    state = spark.read.format("statestore").option("stateVarName", "messages").load(checkpoint)
    held = state.select(F.col("key.message_id").alias("message_id"), "list_element.ts", "list_element.body")
    changes = spark.read.schema(_CHANGES).parquet(f"{out}/changes")
    closed = changes.where("kind = 'closed'").select("message_id", "ts", "body")
    resets = changes.where("kind = 'reset'").groupBy("message_id").agg(F.max("ts").alias("_reset"))
    after = F.col("_reset").isNull() | (F.col("ts") > F.col("_reset"))
    closed = closed.join(resets, "message_id", "left").where(after).drop("_reset")
    rows = held.unionByName(closed).select(F.from_json("body", schema, _TIMES).alias("m"))
    return rows.select("m.*")
