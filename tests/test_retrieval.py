"""Expected hits over a small corpus of several languages, code and noise."""

import pytest

from threadloom.api import Engine
from threadloom.functions import expr
from threadloom.sources import corpus

NOW = 1_756_720_800
SESSIONS = [
    ("auth", "Login loop", [("user", "The login page redirects forever after the cookie change"), ("assistant", "The session cookie lacks SameSite, so the redirect repeats"), ("tool_use", "Bash curl -i /login")], 2),
    ("cache", "Cache misses", [("user", "Why does the build cache miss on every run?"), ("assistant", "The cache key contains a timestamp; use the lockfile hash instead")], 10),
    ("zh_index", "索引重建", [("user", "為什麼索引每次啟動都會重建"), ("assistant", "因為位移值過期，改成比對檔案指紋之後就不會重建索引")], 5),
    ("zh_deploy", "部署失敗", [("user", "部署腳本在測試環境失敗"), ("assistant", "環境變數沒有載入，先執行設定腳本")], 40),
    ("mixed", "Webhook 重試", [("user", "webhook 重試太多次怎麼辦"), ("assistant", "把 webhook 的重試改成指數退避 exponential backoff")], 1),
    ("code", "Parser panic", [("user", 'panic: index out of range in parse_header("x-trace")'), ("assistant", "parse_header() reads one byte past the slice; guard len(buf) first")], 3),
    ("sql", "Slow query", [("user", "SELECT over orders takes 40 s"), ("assistant", "An index on orders(customer_id, created_at) removes the full scan")], 90),
    ("release", "Release notes", [("user", "Draft notes for 2.4"), ("assistant", "2.4 adds retries, drops Python 3.8 and speeds up the parser")], 200),
    ("noise1", "Lunch", [("user", "anything new?"), ("assistant", "nothing today")], 1),
    ("noise2", "Formatting", [("user", "please reformat the table"), ("assistant", "done, columns are aligned")], 1),
    ("old_cache", "Cache again", [("user", "cache cache cache"), ("assistant", "noted")], 700),
    ("ops", "Disk full", [("user", "the runner reports no space left on device"), ("assistant", "Old artifacts fill the disk; prune them nightly")], 7),
]
SEARCHES = [
    ("cookie redirect", "auth", 1),
    ("lockfile", "cache", 1),
    ('"cache key"', "cache", 1),
    ("位移值", "zh_index", 1),
    ("webhook 退避", "mixed", 1),
    ("parse_header", "code", 2),
    ("index orders", "sql", 1),
    ("SAMESITE", "auth", 1),
    ("no space left", "ops", 1),
    ("環境", "zh_deploy", 2),
    ("cache", "cache", 3),
]
QUESTIONS = [
    ("why did the login redirect loop?", "auth", 1),
    ("how did we fix the cache misses", "cache", 2),
    ("索引為什麼會重建", "zh_index", 1),
    ("webhook 重試怎麼處理", "mixed", 1),
    ("what caused the panic in parse_header", "code", 1),
    ("which index made the orders query fast", "sql", 1),
    ("disk space on the runner", "ops", 1),
    ("部署為什麼失敗", "zh_deploy", 1),
    ('what was foo("bar in parse_header', "code", 1),
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(s, "/work/p", t, None, [(k, r, c, days) for k, (r, c) in enumerate(m)]) for s, t, m, days in SESSIONS]
    return Engine(corpus.dataset(spark, spark.createDataFrame(rows, corpus.CORPUS), NOW), NOW)


@pytest.mark.parametrize(("query", "session", "top"), SEARCHES)
def test_search_finds_the_session(engine, query, session, top):
    rows = engine.search(query).collect()
    assert session in [r.session_uuid for r in rows][:top]
    assert all(any(t.lower() in r.snippet.replace("[", "").replace("]", "").lower() for t in query.replace('"', "").split()) for r in rows)


@pytest.mark.parametrize(("question", "session", "top"), QUESTIONS)
def test_ask_brings_the_session_within_the_budget(spark, engine, question, session, top):
    df = engine.ask(question, tokens=400)
    rows = df.orderBy("rank", "seq").collect()
    assert session in list(dict.fromkeys(r.session_uuid for r in rows))[:top]
    assert all(r.role in ("user", "assistant") for r in rows)
    assert sum(r[0] for r in df.select(expr.estimate_tokens(df.text)).collect()) <= 400


def test_the_same_on_one_and_many_partitions(spark, engine):
    from dataclasses import replace

    for n in (1, 7):
        other = Engine(
            replace(engine.data, messages=engine.data.messages.repartition(n), sessions=engine.data.sessions.repartition(n)), NOW
        )
        assert [tuple(r) for r in other.search("cache").collect()] == [tuple(r) for r in engine.search("cache").collect()]


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text(
        '{"session":"a","project":"/p","title":"t","messages":[{"seq":0,"role":"user","content":"hello there","offset_days":1}]}\n',
    )
    data = corpus.read(spark, str(path), NOW)
    assert data.messages.first().ts == NOW - 86_400 and data.sessions.first().turn_count == 1
