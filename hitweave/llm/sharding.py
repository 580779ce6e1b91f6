"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, whose number never changes. A small versioned table maps slots to
shards. Version 0 deals the slots round; an edit moves some slots from full shards to empty ones so that the
bytes of all shards are near equal; growing moves slots into the new shard only. Records never move between slots.

A record's slot is a hash of its id and text. Repeated rows would share a slot: those of a group that holds more than a
``HEAVY``-th of a shard's bytes are hashed by row number as well. Such groups are few (``HEAVY`` for each shard at most), so
they are found by one aggregation and sent to the tasks.

Slot tables have ``slots`` rows at most, so folding them in one row is bounded. Nothing else is gathered.

Defined cases: a null text has no bytes; a record with null id is hashed by its text; repeated rows are placed each, and
any of them may be in any place of the group; empty tables give empty results and a map with no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.columns import unused_prefix
from hitweave.session import write_table

SLOTS = 4096
SEED = "slot"
HEAVY = 200


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_hash(key: str, text: str) -> Column:
    """Hash of a record's id and text."""
    return F.xxhash64(F.lit(SEED), F.col(key), F.col(text))


def slot_of(record: Column, row: Column, spread: Column, slots: int = SLOTS) -> Column:
    """Slot of a record by its hash, and by its row number where ``spread`` holds."""
    return F.pmod(F.when(spread, F.xxhash64(record, row)).otherwise(record), F.lit(slots)).cast("int")


def heavy_groups(records: DataFrame, shards: int, heavy: int = HEAVY) -> DataFrame:
    """``record`` of the repeated rows that hold more than a ``heavy``-th of a shard's bytes: ``heavy * shards`` rows at most.

    ``records`` has ``record, size``.
    """
    total = records.agg(F.sum("size").alias("total"))
    groups = records.groupBy("record").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    return groups.join(F.broadcast(total), F.lit(True)).where(F.col("bytes") * (heavy * shards) > F.col("total")).select("record")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, bytes, rows`` for every slot, also empty ones. ``records`` has ``virtual_slot`` and ``size``."""
    seen = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    full = every.join(seen, "virtual_slot", "left")
    return full.select("virtual_slot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")])


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt round, whatever they hold."""
    return stats.select(F.lit(0).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).cast("int").alias("shard"))


def _place(loose: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """Put loose slots, largest first, each into the shard with the least bytes at that time."""
    w = F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")
    # one row for each slot at most
    packed = loose.agg(F.sort_array(F.collect_list(w)).alias("todo"))
    base = loads.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("m"))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.col("m")[s], F.lit(0).cast("long")))
    # the state: bytes of each shard, and the shards chosen so far
    state = F.struct(F.col("loads").alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))

    def step(acc: Column, x: Column) -> Column:
        k = F.array_position(acc.loads, F.array_min(acc.loads)).cast("int") - 1
        more = F.transform(acc.loads, lambda v, i: F.when(i == k, v - x.minus).otherwise(v))
        return F.struct(more.alias("loads"), F.concat(acc.to, F.array(k)).alias("to"))

    done = (
        packed.join(base, F.lit(True))  # one row on each side
        .select("todo", start.alias("loads"))
        .select("todo", F.aggregate("todo", state, step, lambda acc: acc.to).alias("to"))
    )
    pairs = done.select(F.explode(F.arrays_zip(F.col("todo.virtual_slot").alias("virtual_slot"), F.col("to"))).alias("p"))
    return pairs.select(F.col("p.virtual_slot").alias("virtual_slot"), F.col("p.to").alias("shard"))


def rebalance(slot_map: DataFrame, stats: DataFrame, shards: int, version: int) -> DataFrame:
    """Edit a map: each shard keeps its largest slots up to the mean, the others go where there is least."""
    mean = stats.agg((F.sum("bytes") / shards).alias("mean"))
    down = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    m = slot_map.select("virtual_slot", "shard").join(stats, "virtual_slot").join(F.broadcast(mean), F.lit(True))
    m = m.withColumn("_full", F.sum("bytes").over(down) > F.col("mean"))
    kept = m.where("not _full")
    moved = _place(m.where("_full"), kept.groupBy("shard").agg(F.sum("bytes").alias("load")), shards)
    return kept.select("virtual_slot", "shard").unionByName(moved).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def grow(slot_map: DataFrame, stats: DataFrame, shards: int, version: int) -> DataFrame:
    """Map for one more shard: every old shard gives up its smallest slots, together a share of its bytes; nothing else moves."""
    of = Window.partitionBy("shard")
    up = of.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    m = slot_map.select("virtual_slot", "shard").join(stats, "virtual_slot")
    gone = F.sum("bytes").over(up) * (shards + 1) <= F.sum("bytes").over(of)
    return m.select(F.lit(version).alias("version"), "virtual_slot", F.when(gone, shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def small_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, record, row`` of all documents, stored in the shared folder."""
    crc = F.crc32(F.coalesce(F.encode(text, "utf-8"), F.lit(b""))).alias("text_crc32")
    d = docs.select(key, text_bytes(text).alias("size"), crc, record_hash(key, text).alias("record"), F.monotonically_increasing_id().alias("row"))
    return write_table(d, "sizes")


def with_slots(records: DataFrame, heavy: DataFrame, slots: int = SLOTS, record: str = "record", row: str = "row") -> DataFrame:
    """The records and their ``virtual_slot``. ``heavy`` is of bounded size."""
    x = unused_prefix(records)
    h = F.broadcast(heavy.select(F.col("record").alias(f"{x}heavy")))
    d = records.join(h, F.col(record) == F.col(f"{x}heavy"), "left")
    return d.withColumn("virtual_slot", slot_of(F.col(record), F.col(row), F.col(f"{x}heavy").isNotNull(), slots)).drop(f"{x}heavy")


def balanced_map(records: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Versions 0 and 1 of the map for these records, stored in the shared folder."""
    stats = write_table(slot_bytes(records.select("virtual_slot", "size"), slots), "slot-bytes")
    v0 = first_map(stats, shards)
    return write_table(v0.unionByName(rebalance(v0, stats, shards, 1)), "slot-map")


def edit_map(path: str, records: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Add a version to the map that is kept below ``path``, and return that version.

    The first call deals the slots round (version 0) and balances them; each later one starts from the last version, grows it
    to ``shards`` where it has fewer, and balances it by the bytes of these records. Earlier versions stay. One writer at a
    time.
    """
    spark = records.sparkSession
    stats = write_table(slot_bytes(records.select("virtual_slot", "size"), slots), "slot-bytes")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path)
        version = known.agg(F.max("version")).first()[0]
        last = known.where(F.col("version") == version).select("virtual_slot", F.col("shard").cast("int").alias("shard"))
        there = last.agg(F.max("shard")).first()[0] + 1
        if there > shards:
            raise ValueError(f"the map has {there} shards already")
    else:
        first_map(stats, shards).write.partitionBy("version").parquet(path)
        version, there, last = 0, shards, first_map(stats, shards).select("virtual_slot", "shard")
    for more in range(there, shards):
        last = grow(last, stats, more, version + 1).select("virtual_slot", "shard")
    new = write_table(rebalance(last, stats, shards, version + 1), "slot-map")
    new.write.mode("append").partitionBy("version").parquet(path)
    return new


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """Placement of every document: ``doc_id, size, text_crc32, shard, slot, virtual_slot, map_version``.

    ``slot`` counts a shard's documents from 0 without gaps, by virtual slot and id: ranks within a virtual slot
    plus the rows of the shard's slots before it, so no task holds more than one virtual slot.
    """
    small = small_records(docs)
    small = with_slots(small, write_table(heavy_groups(small, shards), "heavy"), slots)
    m = balanced_map(small, shards, slots).where("version = 1")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = small.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    offset = m.join(rows, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    ranked = small.withColumn("_r", F.row_number().over(rank) - 1)
    # the map has SLOTS rows at most
    out = ranked.join(F.broadcast(offset), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_r")).cast("long").alias("slot"), "virtual_slot",
        F.lit(1).alias("map_version"),
    )


def add_shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """The documents with their ``shard``; texts are not shuffled, only the map and the heavy groups are sent to them.

    A column ``shard`` that the documents have is replaced.
    """
    small = small_records(docs)
    heavy = write_table(heavy_groups(small, shards), "heavy")
    p = unused_prefix(docs)
    m = balanced_map(with_slots(small, heavy, slots), shards, slots).where("version = 1")
    m = m.select(F.col("virtual_slot").alias(f"{p}slot"), F.col("shard").alias(f"{p}shard"))
    d = docs.withColumn(f"{p}record", record_hash("doc_id", "text")).withColumn(f"{p}row", F.monotonically_increasing_id())
    keep = [c for c in docs.columns if c != "shard"]
    # a column of that name that the documents have is put aside
    d = with_slots(d.withColumnRenamed("virtual_slot", f"{p}kept"), heavy, slots, f"{p}record", f"{p}row")
    d = d.withColumnRenamed("virtual_slot", f"{p}slot").withColumnRenamed(f"{p}kept", "virtual_slot")
    d = d.join(F.broadcast(m), f"{p}slot")
    return d.select(*keep, F.col(f"{p}shard").alias("shard"))
