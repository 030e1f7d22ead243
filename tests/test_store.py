import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from threadloom.api import Engine
from threadloom.sources import files
from threadloom.store import Busy, Store, backfill, index, ingest_all, purge_missing, reconcile

A, B, R = "11111111-2222-3333-4444-555555555555", "22222222-2222-3333-4444-555555555555", "33333333-2222-3333-4444-555555555555"
NOW = 1_756_730_000


def event(kind, content, at=0, **more):
    return json.dumps(
        {
            "type": kind,
            "timestamp": f"2025-09-01T10:00:{at:02d}Z",
            "cwd": "/home/p",
            "uuid": f"u{at}",
            "message": {"role": kind, "content": content, **more},
        },
    )


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + end)


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "root"
    write(
        base / "projects" / "-home-p" / f"{A}.jsonl",
        [
            event("user", "where is the lockfile"),
            event(
                "assistant",
                [
                    {"type": "text", "text": "in the cache"},
                    {"type": "tool_use", "name": "Read", "input": {"file_path": "src/a.py"}},
                ],
                1,
                model="m",
                usage={"input_tokens": 5, "output_tokens": 2},
            ),
            "{broken",
        ],
    )
    write(base / "projects" / "-home-p" / A / "subagents" / "agent-1.jsonl", [event("user", "child lockfile", 2)])
    item = {
        "timestamp": "2025-09-01T10:00:03Z",
        "type": "response_item",
        "payload": {"type": "message", "role": "user", "content": [{"text": "rollout lockfile"}]},
    }
    count = {
        "timestamp": "2025-09-01T10:00:04Z",
        "type": "event_msg",
        "payload": {
            "type": "token_count",
            "info": {"total_token_usage": {"input_tokens": 3, "total_tokens": 9}},
            "rate_limits": {"limit_id": "plan", "primary": {"used_percent": 5}},
        },
    }
    write(base / "rollouts" / f"rollout-x-{R}.jsonl", [json.dumps(item), json.dumps(count)])
    chat = [
        {"sessionId": B, "kind": "main"},
        {"id": "1", "type": "user", "timestamp": "2025-09-01T10:00:05Z", "content": "chat lockfile"},
        {"id": "2", "type": "gemini", "content": [{"text": "answer"}], "model": "g", "tokens": {"total": 4}},
    ]
    write(base / "tmp" / "pid" / "chats" / "session-1.jsonl", [json.dumps(c) for c in chat])
    return base


def test_ingest_query_change_and_purge(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    projects = spark.createDataFrame([("pid", "/home/chat")], "project_id string, project_path string")
    stats = ingest_all(store, [str(root)], NOW, projects=projects)
    assert (stats.scanned, stats.ingested, stats.skipped, stats.sessions) == (4, 4, 0, 4)
    s = {r.uuid: r for r in store.read("sessions").collect()}
    assert set(s) == {A, "agent-1", R, B} and s["agent-1"].parent_session == A and s[B].project_path == "/home/chat" and s[A].turn_count == 1 and s[B].title == "chat lockfile"
    assert {r.session_uuid: r.total_tokens for r in store.read("session_usage").collect()} == {A: 7, R: 9, B: 4}
    assert {(r.kind, r.value) for r in store.read("tool_targets").collect()} == {("tool", "Read"), ("file", "src/a.py")}
    assert store.read("quota_snapshots").first().limit_id == "plan:primary"
    assert store.read("ingest_state").agg(F.sum("unparsed_lines")).first()[0] == 1

    engine = Engine(store.dataset(), NOW)
    assert engine.data.text.n == 7 and "is the" in store.text().hits(["is the"]).select("id").join(store.read("messages"), "id").first().content
    assert {r.session_uuid for r in engine.search("lockfile").collect()} == {A, "agent-1"}
    assert {r.session_uuid for r in engine.search("lockfile", source="all").collect()} == {A, "agent-1", R, B}
    assert [r.content for r in engine.show(A[:8]).collect()] == ["where is the lockfile", "in the cache"]
    assert [(r.uuid, r.subagents, r.total_tokens) for r in engine.list().collect()] == [(A, 1, 7)]
    assert [r.uuid for r in engine.drill_down("file", "src/a.py").collect()] == [A]
    assert engine.activity("tool").first().value == "Read" and engine.usage("model").first().key == "m" and engine.doctor().count() == 4
    assert {k: v.count() for k, v in engine.recall("/home").items()} == {"sessions": 1, "files": 1, "commands": 0}
    with pytest.raises(LookupError):
        engine.show("nothing")
    with pytest.raises(ValueError):
        engine.list(source="unknown")

    assert ingest_all(store, [str(root)], NOW).ingested == 0
    path = root / "projects" / "-home-p" / f"{A}.jsonl"
    with path.open("a") as out:
        out.write(event("user", "and now", 9) + "\n" + event("user", "not finished", 10))
    again = ingest_all(store, [str(root)], NOW + 5)
    assert (again.ingested, again.skipped) == (1, 3)
    assert sorted(r.content for r in store.read("messages").where(F.col("session_uuid") == A).collect()) == [
        "Read src/a.py", "and now", "in the cache", "where is the lockfile"
    ]
    assert store.read("messages").count() == 4 + 1 + 1 + 2 and store.read("sessions").where(F.col("uuid") == A).first().turn_count == 2

    os.remove(root / "rollouts" / f"rollout-x-{R}.jsonl")
    assert purge_missing(store, [str(root)]) == 1
    assert {r.uuid for r in store.read("sessions").collect()} == {A, "agent-1", B} and purge_missing(store, [str(root)]) == 0


def test_a_session_of_another_source_is_refused(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ingest_all(store, [str(root / "rollouts")], NOW)
    write(root / "projects" / "-home-q" / f"{R}.jsonl", [event("user", "impostor")])
    ingest_all(store, [str(root / "projects")], NOW)
    assert store.read("sessions").where(F.col("uuid") == R).first().source == "codex"
    assert [(r.uuid, r.seen_source, r.conflicting_source) for r in store.read("source_conflicts").collect()] == [(R, "codex", "claude-code")]
    assert store.read("messages").where("content = 'impostor'").count() == 0


def test_an_unusable_chat_keeps_what_it_had(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    engine = Engine.fresh(store, [str(root)], NOW)
    assert engine.search("chat", source="gemini").count() == 1
    path = root / "tmp" / "pid" / "chats" / "session-1.jsonl"
    path.write_text(path.read_text() + '{"$set": {"messages": null}}\n')
    for k in (1, 2):
        ingest_all(store, [str(root)], NOW + k)
        assert store.read("messages").where(F.col("session_uuid") == B).count() == 2
        assert store.read("ingest_state").where(F.col("source_file") == str(path)).first().unparsed_lines == k
    path.write_text(path.read_text() + '{"$set": {"messages": []}}\n')
    ingest_all(store, [str(root)], NOW + 3)
    assert store.read("messages").where(F.col("session_uuid") == B).count() == 2


def test_scan_of_overlapping_roots_lists_a_file_once(spark, root):
    assert files.listing(spark, [str(root), str(root / "projects"), str(root / "nowhere")]).count() == 4
    shutil.rmtree(root)


@pytest.mark.parametrize("text", [b"", b"no end", b"a\n", b"a\n\nbb\nccc", b"one\ntwo\nthree\n" * 9, "é位\n".encode() * 20 + b"tail", b"x" * 70 + b"\ny\n", b"\n\n\n", b"k" * 15 + b"\n" + b"m" * 16 + b"\nz\n"])
def test_lines_of_parts_are_those_of_the_whole(tmp_path, text, monkeypatch):
    """Parts may cut lines and characters anywhere; the sum of the parts is the file."""
    want = []
    for k, line in enumerate(text.split(b"\n")[:-1], 1):
        if len(line) > 40:
            want.append((k, None, True))
        elif line:
            want.append((k, line.decode(), False))
    assert _read_here(tmp_path, text, 16, 40, monkeypatch) == want


def _read_here(tmp_path, text, chunk, longest, monkeypatch):
    """The reader of one task over all parts, and the counting that ``lines`` does."""
    import pyarrow as pa

    monkeypatch.setattr(files, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(files, "LONGEST_LINE", longest)
    path = tmp_path / "y.bin"
    path.write_bytes(text)
    n = max(1, -(-len(text) // chunk))
    rows = [("f", f"file:{path}", k, k * chunk, (k + 1) * chunk, len(text)) for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdef"))
    got = [r for b in files._read_lines(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns])]
    before, out = 0, []
    for k in range(n):
        out += [(before + at + 1, raw, long) for _, c, at, raw, long in got if c == k and long is not None]
        before += next(at for _, c, at, _, long in got if c == k and long is None)
    return out


def test_a_grown_file_appends_and_a_pass_is_one_commit(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    ingest_all(store, [str(root)], NOW)
    first = store.manifest()
    path = root / "projects" / "-home-p" / f"{A}.jsonl"
    with path.open("a") as out:
        out.write(event("user", "more", 20) + "\n")
    ingest_all(store, [str(root)], NOW + 1)
    second = store.manifest()
    for bucket, folders in first["tables"]["messages"].items():
        assert second["tables"]["messages"][bucket][: len(folders)] == folders  # nothing was rewritten
    assert second["version"] == first["version"] + 1 and store.read("messages").where(F.col("session_uuid") == A).count() == 4
    assert store.read("messages", first).count() == store.read("messages").count() - 1  # readers of the old version keep it
    path.write_text(event("user", "told anew", 1) + "\n" + event("user", "x" * 4000, 2) + "\n")  # grown, but its end is another
    ingest_all(store, [str(root)], NOW + 2)
    assert {len(r.content) for r in store.read("messages").where(F.col("session_uuid") == A).collect()} == {9, 4000}
    path.write_text(event("user", "rewritten", 1) + "\n")
    ingest_all(store, [str(root)], NOW + 3)
    assert [r.content for r in store.read("messages").where(F.col("session_uuid") == A).collect()] == ["rewritten"]
    assert store.read("tool_targets").count() == 0 and store.read("messages").where(F.col("session_uuid") != A).count() == 4
    text = store.text()
    assert text.n == 5 and text.hits(["rewritten"]).count() == 1 and text.hits(["told anew"]).count() == text.hits(["xxxx"]).count() == 0


def test_one_writer_and_a_lost_race(spark, root, tmp_path, monkeypatch):
    store, other = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    with store.lease():
        with pytest.raises(Busy):
            ingest_all(other, [str(root)], NOW)
        assert Engine.fresh(other, [str(root)], NOW).data.messages.count() == 0
    ingest_all(other, [str(root)], NOW)
    stale = store.manifest()
    monkeypatch.setattr(store, "manifest", lambda version=None: stale)
    other.commit({"quota_snapshots": other.read("quota_snapshots")}, {}, {})
    with pytest.raises(FileExistsError):
        store.commit({"quota_snapshots": other.read("quota_snapshots").limit(0)}, {}, {})
    assert other.read("quota_snapshots").count() == 1


def test_counters_backfill_reconcile_and_doctor(spark, root, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    path = root / "projects" / "-home-p" / f"{A}.jsonl"
    extra = [event("assistant", "no usage", 30), json.dumps({"type": "assistant", "message": {"content": "no uuid", "usage": {"input_tokens": 9}}}), event("assistant", "odd", 31, usage={"input_tokens": 1, "odd_tokens": 2, "tier": "x"})]
    path.write_text(path.read_text() + "\n".join(extra) + "\n")
    index(store, [str(root)], NOW)
    state = {r.source_file: r for r in store.read("ingest_state").collect()}
    assert (state[str(path)].usage_skipped, state[str(path)].usage_unmapped, state[str(path)].unparsed_lines) == (2, 1, 1)
    engine = Engine(store.dataset(), NOW)
    checks = {r.name: (r.ok, r.n) for r in engine.doctor(store, [str(root), str(tmp_path / "gone")]).collect()}
    assert checks["roots missing"] == (False, 1) and checks["unparsed lines"] == (False, 1) and checks["usage skipped"] == (False, 2)
    assert checks["files current"] == (True, 4) and checks["coverage of gemini"] == (True, 0) and checks["source conflicts"] == (True, 0) and "size ratio, percent" in checks
    assert set(engine.recall("/home", no_commands=True)) == {"sessions", "files"}
    # facts that are lost come back from the stored lines
    store.commit({}, {}, {"tool_targets": store.read("sessions").selectExpr("uuid AS session_uuid")})
    assert store.read("tool_targets").count() == 0 and backfill(store) > 0 and backfill(store) == 0
    assert {(r.kind, r.value) for r in store.read("tool_targets").collect()} == {("tool", "Read"), ("file", "src/a.py")}
    os.remove(path)
    assert reconcile(store, [str(root)], NOW + 9).ingested == 0 and A not in {r.uuid for r in store.read("sessions").collect()}
