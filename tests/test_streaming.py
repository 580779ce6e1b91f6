from hitweave.operators.conversations import conversation_summary, reset_history
from hitweave.streaming import ingest, live

SCHEMA = "_id long, message_id string, message_role string, model string, message string, timestamp timestamp, contact_name string"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_ingest_replaces_by_source(spark, tmp_path):
    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    root.mkdir()
    src = root / "v1"
    put(src, "a.txt", "palabra " * 400)
    put(src, "b.md", "¿Uno?\nEsta es la primera respuesta larga.\n¿Dos?\nEsta es la segunda respuesta larga.\n¿Tres?\nEsta es la tercera respuesta larga.")
    put(src, "c.txt", "   ")
    put(src, "d.exe", "skip")
    run = lambda: ingest.stream_ingest(spark, str(root), store, mark, version_folders=1).awaitTermination()
    run()
    first = ingest.current_chunks(spark, store).groupBy("source_name", "collection").count().collect()
    assert {(r[0], r[1], r[2]) for r in first} == {("a.txt", "doc", 3), ("b.md", "qna", 3)}
    state = {r["source_name"]: (r["status"], r["busy"]) for r in ingest.current_status(spark.read.parquet(f"{store}/status")).collect()}
    assert state == {"a.txt": ("completed", False), "b.md": ("completed", False), "c.txt": ("failed", False)}
    put(root / "v2", "a.txt", "corto y nuevo")
    run()
    second = ingest.current_chunks(spark, store).where("source_name = 'a.txt'").collect()
    assert [r["text"] for r in second] == ["corto y nuevo"]
    # a retried batch rewrites only its own folder
    batch = spark.read.parquet(f"{store}/chunks").count()
    run()
    assert spark.read.parquet(f"{store}/chunks").count() == batch
    # compaction keeps what is current and nothing else
    small = str(tmp_path / "small")
    ingest.compact(spark, store, small)
    rows = lambda s: sorted(map(str, ingest.current_chunks(spark, s).drop("batch_id").collect()))
    assert rows(small) == rows(store) and spark.read.parquet(f"{small}/chunks").count() == 4
    state = {r["source_name"]: r["status"] for r in ingest.current_status(spark.read.parquet(f"{small}/status")).collect()}
    assert state == {"a.txt": "completed", "b.md": "completed", "c.txt": "failed"}


def test_equal_names_in_two_folders_are_two_sources(spark, tmp_path):
    root, store, mark = tmp_path / "in + more", str(tmp_path / "store"), str(tmp_path / "mark")
    root.mkdir()
    put(root / "x", "a.txt", "uno")
    put(root / "y z", "a.txt", "dos")
    ingest.stream_ingest(spark, str(root), store, mark).awaitTermination()
    got = {(r["source_name"], r["text"]) for r in ingest.current_chunks(spark, store).collect()}
    assert got == {("x/a.txt", "uno"), ("y z/a.txt", "dos")}


def test_continuous_trigger_picks_up_later_files(spark, tmp_path):
    import time

    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    put(root, "a.txt", "uno")
    q = ingest.stream_ingest(spark, str(root), store, mark, every="1 second")
    try:
        q.processAllAvailable()
        put(root, "b.txt", "dos")
        end = time.time() + 60
        while time.time() < end and ingest.current_chunks(spark, store).count() < 2:
            time.sleep(0.5)
        assert {r["text"] for r in ingest.current_chunks(spark, store).collect()} == {"uno", "dos"}
    finally:
        q.stop()


ROWS = [
    (1, "x", "user", "m", "hola", "2024-01-01 00:00:00", "Ana"),
    (2, "x", "assistant", None, " ", "2024-01-01 00:01:00", None),
    (3, "x", "user", "m", "Reset", "2024-01-01 00:02:00", "Ana "),
    (4, "x", "user", "m", "otra vez", "2024-01-01 00:03:00", "Ana"),
    (5, "y", "user", "m", "reset ", "2024-01-01 00:00:00", ""),
]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "timestamp string"))
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_live_views_equal_batch(spark, tmp_path):
    src = str(tmp_path / "log")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    frame(spark, ROWS[:3]).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    live.stream_conversation_summary(stream(), out, mark).awaitTermination()
    live.stream_reset(stream(), out + "2", mark + "2").awaitTermination()
    frame(spark, ROWS[3:]).write.mode("append").parquet(src)
    live.stream_conversation_summary(stream(), out, mark).awaitTermination()
    live.stream_reset(stream(), out + "2", mark + "2").awaitTermination()
    whole = frame(spark, ROWS)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert rows(live.latest_summary(spark, out)) == rows(conversation_summary(whole))
    kept = reset_history(whole).select("_id", "message_id", "message")
    assert rows(live.live_history(spark, out + "2", mark + "2", whole.schema).select("_id", "message_id", "message")) == rows(kept)
    assert sorted(r["_id"] for r in kept.collect()) == [4, 5]


def conversation_rows(seed, n=60):
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        role, text = r.choice([("user", "reset"), ("user", "Reset"), ("assistant", "reset"), ("user", f"m{i}"), ("assistant", f"a{i}"), ("user", None), (None, "x")])
        out.append((i, f"c{r.randrange(4)}", role, "m", text, f"2024-01-01 {r.randrange(24):02}:{r.randrange(60):02}:00.{i:06}", None))
    return out


def test_reset_state_in_any_batching(spark, tmp_path):
    for seed in range(2):
        data = conversation_rows(seed)
        want = sorted(map(tuple, reset_history(frame(spark, data)).select(sorted(frame(spark, data).columns)).collect()), key=str)
        for sizes in ((60,), (20, 20, 20)):
            base, at = tmp_path / f"{seed}-{len(sizes)}", 0
            src, out, mark = (str(base / x) for x in ("log", "out", "mark"))
            for n in sizes:
                frame(spark, data[at : at + n]).coalesce(1).write.mode("append").parquet(src)
                at += n
                live.stream_reset(spark.readStream.schema(SCHEMA).parquet(src), out, mark).awaitTermination()
            got = live.live_history(spark, out, mark, frame(spark, data).schema)
            assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=str) == want


def test_reset_state_is_bounded_by_the_time_out(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    days = [
        [(1, "x", "user", "m", "one", "2024-01-01 00:00:00", None), (2, "y", "user", "m", "two", "2024-01-01 01:00:00", None)],
        [(3, "z", "user", "m", "three", "2024-01-09 00:00:00", None)],
        [(4, "z", "user", "m", "four", "2024-01-09 01:00:00", None), (5, "x", "user", "m", "RESET", "2024-01-10 00:00:00", None)],
        [(6, "x", "assistant", "m", "six", "2024-01-10 01:00:00", None)],
    ]
    for day in days:
        frame(spark, day).write.mode("append").parquet(src)
        live.stream_reset(spark.readStream.schema(SCHEMA).parquet(src), out, mark, time_out="3 days").awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "messages").load(mark)
    assert sorted(r[0] for r in state.select("key.message_id").collect()) == ["x", "z", "z"]  # the first days are closed
    got = live.live_history(spark, out, mark, frame(spark, days[0]).schema)
    every = frame(spark, [r for d in days for r in d])
    assert sorted(r["_id"] for r in got.collect()) == sorted(r["_id"] for r in reset_history(every).collect()) == [2, 3, 4, 6]


def states(spark, store):
    return {r["source_name"]: (r["status"], r["stage"], r["busy"]) for r in ingest.current_status(spark.read.parquet(f"{store}/status")).collect()}


def test_status_is_visible_while_a_batch_is_worked_on(spark, tmp_path):
    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    put(root, "a.txt", "uno dos")
    put(root, "b.txt", "tres")
    seen = []

    def chunker(docs):
        seen.append(states(spark, store))
        return ingest.default_chunker(docs)

    ingest.stream_ingest(spark, str(root), store, mark, chunker).awaitTermination()
    assert seen == [{"a.txt": ("processing", "chunking", True), "b.txt": ("processing", "chunking", True)}]
    assert states(spark, store) == {"a.txt": ("completed", "done", False), "b.txt": ("completed", "done", False)}


def test_a_bad_source_does_not_stop_the_others(spark, tmp_path):
    from pyspark.sql import functions as F

    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    for i in range(9):
        put(root, f"s{i}.txt", f"text {i}" if i != 4 else "BOOM")

    def chunker(docs):
        bad = F.when(F.col("text") == "BOOM", F.raise_error(F.lit("cannot be read"))).otherwise(F.col("text"))
        return ingest.default_chunker(docs.withColumn("text", bad))

    ingest.stream_ingest(spark, str(root), store, mark, chunker).awaitTermination()
    assert {n: s[0] for n, s in states(spark, store).items()} == {f"s{i}.txt": "failed" if i == 4 else "completed" for i in range(9)}
    assert {r["source_name"] for r in ingest.current_chunks(spark, store).collect()} == {f"s{i}.txt" for i in range(9) if i != 4}
    events = spark.read.parquet(f"{store}/status").where("error IS NOT NULL").collect()
    assert [(e["source_name"], "cannot be read" in e["error"]) for e in events] == [("s4.txt", True)]
    # a batch of nothing but failures
    put(root, "t.txt", "BOOM")
    ingest.stream_ingest(spark, str(root), store, mark, chunker).awaitTermination()
    assert states(spark, store)["t.txt"] == ("failed", "chunking", False) and states(spark, store)["s1.txt"][0] == "completed"


def test_versions_in_one_batch(spark, tmp_path):
    import os

    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    root.mkdir()
    for i, text in enumerate(("old", "newest", "older")):
        put(root / f"v{i}", "a.txt", text)
        os.utime(root / f"v{i}" / "a.txt", (1_700_000_000 + [0, 500, 100][i],) * 2)
    ingest.stream_ingest(spark, str(root), store, mark, version_folders=1).awaitTermination()
    assert [r["text"] for r in ingest.current_chunks(spark, store).collect()] == ["newest"]


def test_the_log_of_a_drain_holds_lists_and_not_files(spark, tmp_path):
    import os
    import pathlib

    root, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    root.mkdir()
    for i in range(10):  # dates run against names
        put(root / f"v{9 - i}", "a.txt" if i % 2 else f"{i}.md", f"text {i}")
        os.utime(root / f"v{9 - i}" / ("a.txt" if i % 2 else f"{i}.md"), (1_700_000_000 + i * 1_000_000,) * 2)
    run = lambda: ingest.stream_ingest(spark, str(root), store, mark, files_per_batch=3, version_folders=1).awaitTermination()
    run()
    logged = lambda: sum(p.read_text().count('"path"') for p in pathlib.Path(mark, "sources", "0").iterdir() if not p.name.startswith("."))
    assert logged() == 4  # lists of three files; before, all ten files
    batches = spark.read.parquet(f"{store}/sources")
    assert batches.groupBy("batch_id").count().count() == 4
    current = {r["source_name"]: r["text"] for r in ingest.current_chunks(spark, store).collect()}
    assert current == {"a.txt": "text 9", **{f"{i}.md": f"text {i}" for i in range(0, 10, 2)}}  # the newest version, whatever its batch
    put(root / "z", "a.txt", "last")
    run()
    run()
    assert logged() == 5 and {r["text"] for r in ingest.current_chunks(spark, store).where("source_name = 'a.txt'").collect()} == {"last"}


def test_states_without_work_between_them_are_one_write(spark, tmp_path):
    sources = spark.createDataFrame([("a", 2), ("b", 0)], "source_name string, chunks long")
    log = ingest.StatusLog(str(tmp_path / "status"))
    log.begin(sources.drop("chunks"), ingest.CHUNKING)
    log.add(sources.drop("chunks"), ingest.SAVING)
    log.finish(sources)
    rows = spark.read.parquet(log.path)
    assert sorted(rows.columns) == ["chunks", "error", "progress", "seq", "source_name", "stage", "status", "step"]
    got = {(r["source_name"], r["seq"]): (r["status"], r["stage"], r["progress"], r["chunks"]) for r in rows.collect()}
    early = {(n, i): (*ingest.STAGES[i], None) for n in "ab" for i in range(4)}
    assert got == {**early, ("a", 4): ("completed", "done", 100, 2), ("b", 4): ("failed", "chunking", 35, 0)}
    assert rows.where("seq <> step").count() == 0


def test_columns_are_built_once_a_context(spark):
    from hitweave.operators.chunking import _qa_columns

    assert _qa_columns("text") is _qa_columns("text") and _qa_columns("body") is not _qa_columns("text")
