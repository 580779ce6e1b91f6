"""Document catalog, chunk store maintenance and record search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.functions.ranking import top_rank
from hitweave.functions.text import text_or_empty, trim_ws

# fixed values: readers, tried in this order, with their types and extensions
READERS = (
    ("FastPdfReader", ("application/pdf",), ("pdf",)),
    ("DocxReader", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), ("docx",)),
    ("TextReader", ("text/plain", "application/json", "text/markdown"), ("txt", "md", "markdown", "json")),
)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")


def route_by_type(files: DataFrame, name: str = "filename", mime: str = "type", ocr: str = "use_ocr") -> DataFrame:
    """Adds ``reader``; null means the type is not supported (the reject rows)."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    kind = text_or_empty(mime)
    pdf = (kind == "application/pdf") | (ext == "pdf")
    image = F.startswith(kind, F.lit("image/")) | ext.isin(*IMAGE_EXTENSIONS)
    reader = F.when(pdf & F.col(ocr), "OcrPdfReader").when(pdf, "FastPdfReader").when(image, "ImageReader")
    for label, mimes, exts in READERS:
        reader = reader.when(kind.isin(*mimes) | ext.isin(*exts), label)
    return files.withColumn("reader", reader)


def file_catalog(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin(1, 2))


def catalog_state(events: DataFrame) -> DataFrame:
    """What events tell of each (file, user): its latest upload ``u`` and latest finish ``d``."""
    up = F.col("event") == "upload"
    return events.groupBy("filename", "user_id").agg(
        F.max(F.when(up, F.struct("event_ts", "size", "type", "namespace"))).alias("u"),
        F.max(F.when(~up, F.struct("event_ts", "chunks"))).alias("d"),
    )


def merge_catalog(states: DataFrame) -> DataFrame:
    """One state of several for each (file, user)."""
    return states.groupBy("filename", "user_id").agg(F.max("u").alias("u"), F.max("d").alias("d"))


def catalog_rows(states: DataFrame) -> DataFrame:
    """The catalog: an upload replaces earlier rows (status 1, no counts); a later finish sets the counts and status 2."""
    done = F.col("d.event_ts") > F.col("u.event_ts")
    return states.where(F.col("u").isNotNull()).select(
        "filename",
        "user_id",
        F.col("u.size").alias("size"),
        F.col("u.type").alias("type"),
        F.col("u.namespace").alias("namespace"),
        F.col("u.event_ts").alias("upload_date"),
        F.when(done, F.col("d.chunks")).alias("chunks"),
        F.when(done, F.col("d.chunks")).alias("vectors_uploaded"),
        F.when(done, 2).otherwise(1).alias("status"),
    )


def catalog_register(events: DataFrame) -> DataFrame:
    """Upload and finish events -> one row per (file, user): the latest upload, completed by its finish.

    ``sources.store.Catalog`` keeps the same table in place.
    """
    return catalog_rows(catalog_state(events))


def upsert_by_source(old: DataFrame, new: DataFrame, key: str = "source_name") -> DataFrame:
    """Replace every chunk of the incoming sources, in both collections; ``sources.store`` does so on a stored table."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def scan_chunks_both(doc: DataFrame, qna: DataFrame, limit: int | None = None) -> DataFrame:
    """All objects of both collections, or the first ``limit`` of each in (source, chunk) order."""
    by = ["source_name", "chunk_index"]
    if limit is None:
        return doc.unionByName(qna, allowMissingColumns=True)
    return doc.orderBy(*by).limit(limit).unionByName(qna.orderBy(*by).limit(limit), allowMissingColumns=True)


def manual_record(texts: DataFrame, text: str = "text") -> DataFrame:
    """Schema defaults of a record typed in by hand."""
    t = trim_ws(F.col(text))
    return texts.where(text_or_empty(text) != "").select(
        "id",
        t.alias("text"),
        F.lit("Manual").alias("source_name"),
        F.lit("manual").alias("source_type"),
        F.length(t).cast("long").alias("source_size"),
        F.lit("default").alias("namespace"),
        F.lit(1).alias("chunk_index"),
        F.lit(1).alias("total_chunks"),
        F.lit("en").alias("language"),
        F.lit(0).alias("start_position"),
        F.length(t).alias("end_position"),
        t.alias("content_without_overlap"),
        F.lit("manual").alias("chunker_used"),
    )


def record_upsert(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change table ``(id, seq, op, text)``: the last change per id wins.

    ``create`` makes a manual record, ``update`` replaces the text of an existing one, ``delete`` removes it.
    """
    last = top_rank(changes, ["id"], [F.desc("seq")], 1, "_r").drop("_r", "seq")
    kept = records.join(last.select("id"), "id", "left_anti")
    updated = records.join(last.where("op = 'update' AND text IS NOT NULL").select("id", F.col("text").alias("_new")), "id")
    updated = updated.withColumn("text", F.col("_new")).drop("_new")
    unreadable = records.join(last.where("op = 'update' AND text IS NULL").select("id"), "id", "left_semi")
    created = manual_record(last.where("op = 'create'").select("id", "text"))
    return kept.unionByName(updated).unionByName(unreadable).unionByName(created.select(*records.columns))


def delete_source(files: DataFrame, chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after deletion by ``name`` (everything) or by ``file_id`` (chunks only if finished)."""
    names = requests.where(F.col("name").isNotNull()).select(F.col("name").alias("filename"))
    by_id = requests.where(F.col("file_id").isNotNull()).select("file_id")
    finished = files.join(by_id, "file_id", "left_semi").where("status = 2").select("filename")
    gone = names.unionByName(finished).distinct().withColumnRenamed("filename", "source_name")
    left = files.join(names.distinct(), "filename", "left_anti").join(by_id.distinct(), "file_id", "left_anti")
    return left, chunks.join(gone, "source_name", "left_anti")


def document_inventory(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """One row per source: the first chunk's properties and the number of chunks."""
    props = [c for c in chunks.columns if c not in ("source_name", order)]
    first = F.min_by(F.struct(*props), order).alias("_f")
    named = chunks.where(text_or_empty("source_name") != "")
    return named.groupBy("source_name").agg(first, F.count("*").alias("chunk_count")).select(
        "source_name", "chunk_count", "_f.*"
    )


def record_search(records: DataFrame, needle: str, page: int, order: str, per_page: int = 20) -> DataFrame:
    """One page of the records whose text contains the needle, with the number of all matches."""
    hit = records
    if needle.strip():
        hit = records.where(F.contains(F.lower(text_or_empty("text")), F.lit(needle.lower())))
    total = hit.agg(F.count("*").alias("n")).scalar()
    return hit.orderBy(order).offset((page - 1) * per_page).limit(per_page).withColumn("total_matches", total)
