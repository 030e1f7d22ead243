import json

from threadloom.sources import files, transcripts
from threadloom.streaming import refresh

LANDED = "source_file string, line_no bigint, line_id bigint, batch_no int, raw_line string"
MESSAGE = "source_file string, session_uuid string, seq bigint, line_no bigint, ts bigint, role string, content string"


def lines(spark, *rows):
    body = lambda t: json.dumps({"type": "user", "timestamp": "2025-09-01T10:00:00Z", "message": {"content": t}})
    return spark.createDataFrame([(f"/p/{f}.jsonl", n, i, b, body(t)) for f, n, i, b, t in rows], LANDED)


def test_batches_replace_whole_sessions(spark, tmp_path):
    landing, target = str(tmp_path / "landing"), refresh.VersionedTable(spark, str(tmp_path / "table"), MESSAGE)
    adapt = lambda df: transcripts.event_messages(files.current_lines(df)).select("source_file", "session_uuid", "seq", "line_no", "ts", "role", "content")
    merge = refresh.merge_batch(lambda: spark.read.schema(LANDED).parquet(landing), adapt, target)
    follow = lambda: refresh.follow(spark, landing, LANDED, str(tmp_path / "ckpt"), merge, once=True).awaitTermination()
    assert target.read().count() == 0
    lines(spark, ("a", 1, 1, 0, "one"), ("b", 1, 2, 0, "bee")).write.mode("append").parquet(landing)
    follow()
    lines(spark, ("a", 2, 3, 1, "two"), ("a", 1, 4, 1, "one again"), ("a", 2, 5, 1, "two!")).write.mode("append").parquet(landing)
    follow()
    got = {(r.session_uuid, r.seq, r.content) for r in target.read().collect()}
    assert got == {("a", 0, "one again"), ("a", 1, "two!"), ("b", 0, "bee")}
    before = target.versions()
    merge(spark.read.schema(LANDED).parquet(landing).limit(1), before[-1])
    assert {(r.session_uuid, r.seq, r.content) for r in target.read().collect()} == got and target.versions() == before


def test_windows_over_tables_and_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    want = {tuple(r) for r in refresh.activity_windows(events).collect()}
    src = str(tmp_path / "events")
    events.write.parquet(src)
    stream = refresh.activity_windows(spark.readStream.schema(events.schema).parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == want and want


def test_growing_files_are_followed_and_reconciled(spark, tmp_path):
    import os
    import time

    from threadloom.store import Store
    from threadloom.streaming.refresh import pass_over, watch

    line = '{"type":"user","uuid":"u%d","timestamp":"2025-09-01T10:00:00Z","message":{"role":"user","content":"number %d"}}\n'
    folder = tmp_path / "projects" / "-p"
    folder.mkdir(parents=True)
    path, other = folder / "11111111-2222-3333-4444-555555555555.jsonl", folder / "22222222-2222-3333-4444-555555555555.jsonl"
    path.write_text(line % (1, 1))
    other.write_text(line % (2, 2))
    store = Store(spark, f"file://{tmp_path}/store", buckets=2, indexed=False)
    query = watch(store, [str(tmp_path / "projects")], f"file://{tmp_path}/checkpoint", lambda: 7, every="1 second", backstop=1000)
    try:
        for _ in range(120):
            if store.read("messages").count() == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert store.read("messages").count() == 2
    tick = pass_over(store, [str(tmp_path / "projects")], lambda: 8, backstop=2)
    path.write_text(path.read_text() + line % (3, 3))
    os.remove(other)
    tick(None, 1)
    assert store.read("messages").count() == 3
    tick(None, 2)
    assert sorted(r.content for r in store.read("messages").collect()) == ["number 1", "number 3"]
    with store.lease():
        tick(None, 3)
