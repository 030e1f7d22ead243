import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.catalog import Dataset
from threadloom.plans import ask, search, sessions
from threadloom.plans.search import SearchFilter
from threadloom.plans.sessions import SessionFilter

AS_OF = 1_000_000
TEXTS = [
    "The deploy failed with a permission error", "permission permission PERMISSION denied", "nothing to see", "Été: the cache PERMISSION", "aaaa aaaaa aaa", "索引重建失敗，因為位移值過期", "位移值", None, "", "go ms go permission",
    "a deploy of the cache index " * 5,
]
MESSAGES = "id bigint, session_uuid string, seq int, ts bigint, role string, content string, raw_json string"
SESSIONS = "uuid string, project_path string, source_file string, started_at bigint, ended_at bigint, turn_count int, title string, parent_session string, agent_type string, source string"


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, f"s{k % 3}", k // 3, AS_OF - k * 1000, ["user", "assistant", "tool_use"][k % 3] if k != 8 else None, t, None) for k, t in enumerate(TEXTS)]
    rows += [(100, "orphan", 0, None, "user", "permission of nobody", None), (101, None, None, None, None, None, None)]
    own = [
        ("s0", "/A_b/x", "f0", 1, 30, 2, "t0", None, None, None),
        ("s1", "/a%b/y", "f1", 1, 20, 1, None, "s0", "tester", ""),
        ("s2", None, "f2", 1, None, 0, "t2", "gone", None, "codex"),
        ("s3", "/a_b/z", "f3", 1, 30, 5, "t3", "s1", None, "claude-code"),
    ]
    targets = [
        (0, "s0", 5, "file", "src/A.py"),
        (1, "s1", 6, "file", "src/a.py"),
        (2, "s2", 7, "command", "Go Test ./..."),
        (9, "zz", 9, "command", "ls"),
    ]
    usage = spark.createDataFrame(
        [],
        "session_uuid string, model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, reasoning bigint, tool bigint, total_tokens bigint, source string, categories_json string",
    )
    facts = spark.createDataFrame(targets, "message_id bigint, session_uuid string, ts bigint, kind string, value string")
    return Dataset(
        spark.createDataFrame(own, SESSIONS),
        spark.createDataFrame(rows, MESSAGES),
        facts,
        usage,
        spark.createDataFrame([], "source_file string, usage_stale int"),
    )


def fts(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(c, tokenize='trigram')")
    rows = [*TEXTS, *[None] * (100 - len(TEXTS)), "permission of nobody", None]
    for k, t in enumerate(rows):
        if k < len(TEXTS) or k >= 100:
            db.execute("insert into f(rowid, c) values (?, ?)", (k, t or ""))
    return dict(db.execute("select rowid, bm25(f) from f where f match ?", (query,)).fetchall())


@pytest.mark.parametrize(
    "terms", [["permission"], ["permission", "deploy"], ["été"], ["aaa"], ["位移值"], ["cache", "index", "the"]]
)
def test_bm25_equals_an_independent_index(data, terms):
    want = fts(" OR ".join(f'"{t}"' for t in terms))
    rows = data.messages.where(F.col("id").isin(list(want)))
    got = {r.id: r.bm25 for r in search._scored(rows, data.messages, terms).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_filters(data):
    assert set(ids(search.search(data, "permission", AS_OF))) == {0, 1, 3, 9, 100}
    assert set(ids(search.search(data, "permission go", AS_OF))) == {9}
    assert set(ids(search.search(data, "permission", AS_OF, SearchFilter(role="user", since=AS_OF - 500)))) == {0}
    assert set(ids(search.search(data, "permission", AS_OF, SearchFilter(project="/a_B")))) == {0, 3, 9}
    assert set(ids(search.search(data, "permission", AS_OF, SearchFilter(touched="SRC/a")))) == {0, 1, 3, 9}
    assert ids(search.search(data, "go", AS_OF)) == [9, 10] or ids(search.search(data, "go", AS_OF)) == [9]
    assert search.search(data, '"', AS_OF).count() == 0
    with pytest.raises(ValueError):
        search.search(data, "  ", AS_OF)


def test_best_first_and_visible_hit(data):
    rows = search.search(data, "permission denied", AS_OF).collect()
    assert [r.id for r in rows] == [1] and "[" in rows[0].snippet
    scores = [r.score for r in search.search(data, "permission", AS_OF).collect()]
    assert scores == sorted(scores, reverse=True)


def test_retrieve_tiers_and_caps(data):
    rows = search.retrieve(data, ["permission", "go"], AS_OF).collect()
    assert [r.full for r in rows] == sorted([r.full for r in rows], reverse=True)
    by = {r.id: r for r in rows}
    alone = {r.id: r.score for r in search.retrieve(data, ["permission"], AS_OF).collect()}
    assert by[9].score == pytest.approx(alone[9] + 0.5)
    capped = search.retrieve(data, ["permission", "go"], AS_OF, per_session=1).collect()
    assert len({r.session_uuid for r in capped}) == len(capped)
    assert search.retrieve(data, [], AS_OF).count() == 0


def test_ask_budget_floor_and_order(data):
    rows = ask.ask(data, "what about permission", AS_OF, window=1).orderBy("rank", "seq").collect()
    assert rows and all(any(r.is_hit for r in rows if r.rank == k) for k in {r.rank for r in rows})
    assert ask.ask(data, "  ", AS_OF).count() == 0 and ask.ask(data, "unheardof", AS_OF).count() == 0


def test_ask_gives_the_hits_of_a_group_that_is_too_large(spark, data):
    long = [(k, "s0", k, 1, "user", ("needle " if k == 5 else "") + "w" * 590, None) for k in range(10)]
    big = Dataset(data.sessions, spark.createDataFrame(long, MESSAGES), data.tool_targets, data.session_usage, data.ingest_state)
    rows = ask.ask(big, "needle", AS_OF, window=5, tokens=200).collect()
    assert [(r.seq, r.is_hit, len(r.text)) for r in rows] == [(5, True, 81)]


def uuids(df):
    return [r.uuid for r in df.collect()]


def test_listing_and_nesting(data):
    assert uuids(sessions.list_sessions(data)) == ["s0"]
    assert uuids(sessions.list_sessions(data, SessionFilter(include_subagents=True))) == ["s3", "s0", "s1"]
    assert uuids(sessions.list_sessions(data, SessionFilter(limit=1))) == ["s3"]
    assert uuids(sessions.list_sessions(data, SessionFilter(source="all"))) == ["s0", "s2"]
    assert uuids(sessions.list_sessions(data, SessionFilter(parent="s0"))) == ["s1"]
    assert uuids(sessions.list_sessions(data, SessionFilter(project="/a%", include_subagents=True))) == ["s1"]
    assert uuids(sessions.list_sessions(data, SessionFilter(ran="go test", source="codex"))) == ["s2"]
    assert uuids(sessions.list_sessions(data, SessionFilter(target=("file", "src/a.py"), include_subagents=True))) == ["s1"]
    assert [r.subagents for r in sessions.list_sessions(data).collect()] == [1]


def test_resolve(data):
    assert uuids(sessions.resolve(data, "s2")) == ["s2"]
    assert len(uuids(sessions.resolve(data, "s"))) == 2 and uuids(sessions.resolve(data, "nope")) == []
    assert uuids(sessions.resolve(data, "S3")) == ["s3"]


def test_pages_and_windows(data):
    page = sessions.read_messages(data, "s0", 0, 2).collect()
    assert [r.seq for r in page] == [0, 1] and all(r.has_more for r in page) and page[0].raw_json == ""
    assert [r.has_more for r in sessions.read_messages(data, "s0", 2, 2).collect()] == [False, False]
    assert [r.seq for r in sessions.get_window(data, "s0", 1, 1, 1).orderBy("seq").collect()] == [0, 1, 2]
    assert sessions.get_window(data, "s2", 1, 1, 1).count() == 0


def test_windows_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(sessions, "STRETCH", 4)
    rows = [(k, f"s{k % 2}", k // 2, 1, "user" if k // 2 % 11 in (0, 1, 7) else "tool_use", f"t{k}", None) for k in range(400)]
    df = spark.createDataFrame(rows, MESSAGES)
    hits = spark.createDataFrame(
        [("s0", 0), ("s0", 50), ("s1", 103), ("s1", 199), ("s1", 500), ("zz", 1)], "session_uuid string, hit_seq int"
    )
    got = {}
    for r in sessions.windows(df, hits, 2, 3).collect():
        got.setdefault((r.session_uuid, r.hit_seq), []).append(r.seq)
    for u, q in (("s0", 0), ("s0", 50), ("s1", 103), ("s1", 199), ("s1", 500)):
        shown = [r[2] for r in rows if r[1] == u and r[4] == "user"]
        assert sorted(got[u, q]) == [s for s in shown if s <= q][-3:] + [s for s in shown if s > q][:3]
    assert ("zz", 1) not in got


def test_activity(data):
    assert [tuple(r) for r in sessions.activity_by_kind(data, "command", source="all").collect()] == [("Go Test ./...", 1), ("ls", 1)]
    assert [tuple(r) for r in sessions.activity_by_kind(data, "file", since=6).collect()] == [("src/a.py", 1)]
    rows = {r.key: (r.sessions, r.messages) for r in sessions.activity_summary(data, "project", 0, source="all").collect()}
    assert rows["/a%b/y"] == (1, 4) and rows["/a_b/z"] == (1, 0)
    with pytest.raises(ValueError):
        sessions.activity_summary(data, "week")
