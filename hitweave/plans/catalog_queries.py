"""Catalog, store maintenance and record search over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import catalog as G
from hitweave.plans.registry import query
from hitweave.plans.tables import CORPUS_SQL, corpus, read
from hitweave.sources.files import STAGED_ID, scan_documents, scan_test_cases, stage_cases, stage_dir, stage_documents
from hitweave.sources.store import Catalog, SourceStore, delete_stored

FILES_SQL = """files AS (SELECT doc_id AS file_id, 'file-' || (doc_id % 300) || '.' ||
      CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'TXT' WHEN 2 THEN 'md' WHEN 3 THEN 'png' WHEN 4 THEN 'docx' WHEN 5 THEN 'exe' ELSE 'bin' END AS filename,
      CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/gif' WHEN 3 THEN '' END AS type,
      doc_id % 2 = 0 AS use_ocr, (doc_id % 4)::INT AS status, 'user-' || (doc_id % 3) AS user_id, n_chars AS size, source AS namespace FROM documents)"""


def files(spark, sd):
    i = F.col("doc_id")
    ext = ["pdf", "TXT", "md", "png", "docx", "exe", "bin"]
    mime = ["application/pdf", "text/plain", "image/gif", ""]
    return read(spark, sd, "documents").select(
        i.alias("file_id"),
        F.concat(F.lit("file-"), i % 300, F.lit("."), F.get(F.array(*map(F.lit, ext)), (i % 7).cast("int"))).alias("filename"),
        F.get(F.array(*map(F.lit, mime)), (i % 5).cast("int")).alias("type"),
        (i % 2 == 0).alias("use_ocr"),
        (i % 4).cast("int").alias("status"),
        F.concat(F.lit("user-"), i % 3).alias("user_id"),
        F.col("n_chars").alias("size"),
        F.col("source").alias("namespace"),
    )


@query(
    "route_by_type",
    rf"""WITH {FILES_SQL}, x AS (SELECT *, lower(regexp_extract(filename, '\.([^.]*)$', 1)) AS ext, coalesce(type, '') AS t FROM files)
    SELECT file_id, CASE WHEN (t = 'application/pdf' OR ext = 'pdf') AND use_ocr THEN 'OcrPdfReader' WHEN t = 'application/pdf' OR ext = 'pdf' THEN 'FastPdfReader'
      WHEN starts_with(t, 'image/') OR ext IN ('png', 'jpg', 'jpeg', 'webp') THEN 'ImageReader'
      WHEN t = '{G.READERS[1][1][0]}' OR ext = 'docx' THEN 'DocxReader'
      WHEN t IN ('text/plain', 'application/json', 'text/markdown') OR ext IN ('txt', 'md', 'markdown', 'json') THEN 'TextReader' END AS reader FROM x""",
)
def _route(spark, sd):
    return G.route_by_type(files(spark, sd)).select("file_id", "reader")


@query("file_catalog", f"WITH {FILES_SQL} SELECT file_id, filename, status FROM files WHERE status IN (1, 2)")
def _files(spark, sd):
    return G.file_catalog(files(spark, sd)).select("file_id", "filename", "status")


@query(
    "catalog_register",
    f"""WITH {FILES_SQL},
    up AS (SELECT filename, user_id, arg_max(size, file_id) AS size, arg_max(namespace, file_id) AS namespace, max(file_id) AS ts FROM files WHERE status <> 3 GROUP BY ALL),
    dn AS (SELECT filename, user_id, arg_max(size % 50, file_id) AS chunks, max(file_id) AS ts FROM files WHERE status = 3 GROUP BY ALL)
    SELECT filename, user_id, size, namespace, up.ts AS upload_date, CASE WHEN dn.ts > up.ts THEN chunks END AS chunks,
      CASE WHEN dn.ts > up.ts THEN chunks END AS vectors_uploaded, CASE WHEN dn.ts > up.ts THEN 2 ELSE 1 END AS status
    FROM up LEFT JOIN dn USING (filename, user_id)""",
)
def _register(spark, sd):
    f = files(spark, sd)
    kind = F.when(F.col("status") == 3, "finish").otherwise("upload")
    e = f.withColumns({"event": kind, "event_ts": F.col("file_id"), "chunks": F.col("size") % 50})
    # events come in two deliveries, out of order
    catalog = Catalog(spark, stage_dir(spark, "catalog"), buckets=16)
    catalog.create(e.where("file_id % 3 <> 1"))
    catalog.register(e.where("file_id % 3 = 1"))
    return catalog.rows().drop("type")


@query(
    "upsert_by_source",
    f"""WITH {CORPUS_SQL}, new AS (SELECT DISTINCT source_name FROM corpus WHERE right(source_name, 1) IN ('1', '4'))
    SELECT vec_id, source_name, chunk_index, text FROM corpus WHERE source_name NOT IN (SELECT source_name FROM new)
    UNION ALL SELECT vec_id + 1000000, source_name, chunk_index, 'new ' || text FROM corpus
    WHERE source_name IN (SELECT source_name FROM new) AND chunk_index % 2 = 0""",
)
def _upsert(spark, sd):
    c = corpus(spark, sd).select("vec_id", "source_name", "chunk_index", "text")
    new = c.where("right(source_name, 1) IN ('1', '4') AND chunk_index % 2 = 0").withColumns(
        {"vec_id": F.col("vec_id") + 1000000, "text": F.concat(F.lit("new "), "text")}
    )
    # a stored table, changed twice in place: first the sources that end in 1, then those in 4
    store = SourceStore(spark, stage_dir(spark, "chunks"), buckets=32)
    store.create(c)
    for last in ("1", "4"):
        store.replace(new.where(F.endswith("source_name", F.lit(last))))
    return store.read()


@query("scan_chunks_both", f"WITH {CORPUS_SQL} SELECT vec_id, collection, source_name, chunk_index FROM corpus")
def _both(spark, sd):
    c = corpus(spark, sd).select("vec_id", "collection", "source_name", "chunk_index")
    return G.scan_chunks_both(c.where("collection = 'doc'"), c.where("collection = 'qna'"))


@query(
    "record_upsert",
    """WITH rec AS (SELECT doc_id AS id, text, coalesce('src-' || label, source) AS source_name FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
    ch AS (SELECT event_id % 900 AS id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 3 THEN 'delete' ELSE 'update' END AS op,
             CASE WHEN event_id % 9 <> 0 THEN ' ' || event_type || ' ' || event_id || ' ' END AS text FROM events),
    last AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
    SELECT id, text, source_name FROM rec WHERE id NOT IN (SELECT id FROM last) OR id IN (SELECT id FROM last WHERE op = 'update' AND text IS NULL)
    UNION ALL SELECT id, l.text, source_name FROM rec JOIN last l USING (id) WHERE op = 'update' AND l.text IS NOT NULL
    UNION ALL SELECT id, trim(text), 'Manual' FROM last WHERE op = 'create' AND coalesce(text, '') <> ''""",
)
def _records(spark, sd):
    rec = corpus(spark, sd).select(F.col("vec_id").alias("id"), "text", "source_name")
    i = F.col("event_id")
    ch = read(spark, sd, "events").select(
        (i % 900).alias("id"),
        i.alias("seq"),
        F.when(i % 4 == 0, "create").when(i % 4 == 3, "delete").otherwise("update").alias("op"),
        F.when(i % 9 != 0, F.concat(F.lit(" "), "event_type", F.lit(" "), i, F.lit(" "))).alias("text"),
    )
    return G.record_upsert(rec, ch)


DELETES_SQL = f"""{FILES_SQL}, ch AS (SELECT doc_id AS chunk_id, filename AS source_name FROM documents JOIN files ON file_id = doc_id),
    req AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'file-' || (event_id % 100) || '.pdf' END AS name, CASE WHEN event_id % 3 = 1 THEN event_id % 700 END AS file_id FROM events),
    gone AS (SELECT name FROM req WHERE name IS NOT NULL UNION SELECT filename FROM files WHERE status = 2 AND file_id IN (SELECT file_id FROM req WHERE file_id IS NOT NULL))"""


@query(
    "delete_source",
    f"""WITH {DELETES_SQL}
    SELECT 'file' AS kind, file_id AS id FROM files WHERE filename NOT IN (SELECT name FROM req WHERE name IS NOT NULL)
      AND file_id NOT IN (SELECT file_id FROM req WHERE file_id IS NOT NULL)
    UNION ALL SELECT 'chunk', chunk_id FROM ch WHERE source_name NOT IN (SELECT name FROM gone)""",
)
def _delete(spark, sd):
    f = files(spark, sd)
    chunks = f.select(F.col("file_id").alias("chunk_id"), F.col("filename").alias("source_name"))
    i = F.col("event_id")
    req = read(spark, sd, "events").select(
        F.when(i % 3 == 0, F.concat(F.lit("file-"), i % 100, F.lit(".pdf"))).alias("name"), F.when(i % 3 == 1, i % 700).alias("file_id")
    )
    stored = SourceStore(spark, stage_dir(spark, "files"), "filename", 32), SourceStore(spark, stage_dir(spark, "chunks"), buckets=32)
    for store, rows in zip(stored, (f, chunks), strict=True):
        store.create(rows)
    delete_stored(stored[1], stored[0], req)
    left, kept = (s.read() for s in stored)
    return left.select(F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(
        kept.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    )


@query(
    "document_inventory",
    f"""WITH {CORPUS_SQL} SELECT source_name, count(*) AS chunk_count, arg_min(vec_id, chunk_index) AS vec_id, arg_min(text, chunk_index) AS text,
      arg_min(total_chunks, chunk_index) AS total_chunks FROM corpus GROUP BY source_name""",
)
def _inventory(spark, sd):
    c = corpus(spark, sd).select("source_name", "chunk_index", "vec_id", "text", "total_chunks")
    return G.document_inventory(c)


@query(
    "record_search",
    """SELECT doc_id, text, count(*) OVER () AS total_matches FROM documents WHERE contains(lower(text), 'the and')
    ORDER BY doc_id LIMIT 20 OFFSET 20""",
)
def _search(spark, sd):
    return G.record_search(read(spark, sd, "documents").select("doc_id", "text"), "The And", 2, "doc_id")


@query("scan_text_files", "SELECT doc_id, 'txt' AS source_type, strlen(text) + 1 AS source_size, text || E'\n' AS text FROM documents")
def _scan(spark, sd):
    """Every document written as a file of its own (the writer ends it with a line break) and read back."""
    path = stage_documents(read(spark, sd, "documents").select("doc_id", "text"))
    d = scan_documents(spark, path)
    doc_id = F.regexp_extract("source_name", STAGED_ID, 1).cast("long").alias("doc_id")
    return d.select(doc_id, "source_type", "source_size", "text")


@query(
    "scan_test_cases",
    """SELECT 'CASE-' || item_id AS id, text AS query, 'src-' || (item_id % 10) AS source_matches, '' AS keywords, item_id % 12 = 0 AS should_refuse,
      'passage' AS tags FROM benchmark""",
)
def _cases(spark, sd):
    c = scan_test_cases(spark, stage_cases(read(spark, sd, "benchmark")))
    lists = {n: F.array_join(n, ",") for n in ("source_matches", "keywords", "tags")}
    return c.withColumns(lists)
