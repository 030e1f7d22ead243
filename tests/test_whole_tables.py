"""Queries without SQL that run over whole tables, against brute force."""

import json
import re
from collections import Counter

import duckdb

import __spark_entry__ as entry
from threadloom import schema
from threadloom.functions import expr, redact
from threadloom.operators.sequence import drop_repeats
from threadloom.plans import reference_queries


def table(sf, name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


def test_first_lines_of_all_messages_are_capped(spark, sf):
    got = {r.id: r["line"] for r in entry.queries()["first_line"](spark, sf).collect()}
    want = {}
    for k, content in table(sf, "messages", "id, content"):
        line = content.split("\n", 1)[0].encode() if content is not None else None
        want[k] = line if line is None else line[:200].decode("utf-8", "ignore")
    assert got == want
    assert any(content and len(content.split("\n", 1)[0].encode()) > 200 for _, content in table(sf, "messages", "id, content"))


def redacted(text):
    for pattern, mark in redact.RULES:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", mark), text, flags=re.ASCII)
    return text.encode()[: schema.TARGET_BYTES].decode("utf-8", "ignore")


def acted(lines):
    """Brute force over the current copy of each line: (source_file, line_no) -> raw_line."""
    own, calls = set(), []
    for (file, _), raw in lines.items():
        try:
            line = json.loads(raw)
        except (TypeError, ValueError):
            continue
        message = line.get("message") if isinstance(line, dict) and line.get("type") in ("user", "assistant") else None
        content = message.get("content") if isinstance(message, dict) else None
        for b in content if isinstance(content, list) else ():
            if isinstance(b, dict) and b.get("type") == "tool_use":
                name = b.get("name") if isinstance(b.get("name"), str) else ""
                if name.startswith(schema.OWN_TOOLS):
                    own.add((file, b.get("id")))
                calls.append((file, b.get("id"), name, b.get("input")))
    out = Counter()
    for file, ident, name, args in calls:
        kind, field = schema.TOOL_FIELDS.get(name, (None, None))
        value = args.get(field) if kind and isinstance(args, dict) else None
        if isinstance(value, str) and value.strip(" ") and (file, ident) not in own:
            out[kind, redacted(value)] += 1
    return out


def test_events_acted_on_targets_of_every_kind(spark, sf):
    copies = table(sf, "event_lines", "source_file, line_no, batch_no, line_id, raw_line")
    lines = {(f, n): raw for f, n, _, _, raw in sorted(copies, key=lambda r: (r[2], r[3]))}
    got = {(r.kind, r.value): r.n for r in entry.queries()["event_targets"](spark, sf).collect()}
    assert got == acted(lines) and {k for k, _ in got} == {"file", "command", "pattern", "url"}


def test_commands_are_redacted_and_capped(spark, monkeypatch):
    commands = ["ls", "curl -H 'Authorization: Basic dXNlcjpwdw=='", "export API_KEY=abcdef123456", "echo " + "位" * 300, " "]
    blocks = [{"type": "tool_use", "id": str(k), "name": "Bash", "input": {"command": c}} for k, c in enumerate(commands)]
    raw = json.dumps({"type": "assistant", "uuid": "u", "message": {"content": blocks}})
    df = spark.createDataFrame([("/x/a.jsonl", 1, 1, 1, raw)], "source_file string, line_no bigint, batch_no bigint, line_id bigint, raw_line string")
    monkeypatch.setattr(reference_queries, "table", lambda *_: df)
    got = {(r.kind, r.value): r.n for r in reference_queries.event_targets(spark, "").collect()}
    assert got == acted({("/x/a.jsonl", 1): raw})
    values = {v for _, v in got}
    assert len(values) == 4 and "export API_KEY=[REDACTED:secret]" in values and max(len(v.encode()) for v in values) in (510, 511, 512)


def test_checks_count_lines_and_files_of_every_format(spark, sf):
    def broken(raw):
        try:
            json.loads(raw)
        except (TypeError, ValueError):
            return True
        return False

    lines = {t: table(sf, t, "source_file, raw_line") for t in ("event_lines", "rollout_lines", "chat_lines")}
    n = entry.queries()["doctor_unparsed"](spark, sf).first().n
    assert n == sum(broken(raw) for rows in lines.values() for _, raw in rows)
    got = {r.source: r.on_disk for r in entry.queries()["doctor_coverage"](spark, sf).collect()}
    assert got == {s: len({f for f, _ in lines[t]}) for s, t in (("claude-code", "event_lines"), ("codex", "rollout_lines"), ("gemini", "chat_lines"))}


def test_broken_lines_of_each_format_are_counted(spark, monkeypatch):
    frames = {t: spark.createDataFrame([("{",), ("{}",), (None,)][: k + 1], "raw_line string") for k, t in enumerate(("event_lines", "rollout_lines", "chat_lines"))}
    monkeypatch.setattr(reference_queries, "table", lambda _s, _d, name: frames[name])
    assert reference_queries.doctor_unparsed(spark, "").first().n == 4


def test_repeated_lines_of_every_session_are_dropped(spark, sf):
    sessions = {}
    for s, seq, k, raw in table(sf, "messages", "session_uuid, seq, id, raw_json"):
        sessions.setdefault(s, []).append((seq, k, raw or ""))
    want = set()
    for s, rows in sessions.items():
        rows.sort()
        want |= {(s, seq, k) for n, (seq, k, raw) in enumerate(rows) if n == 0 or raw != rows[n - 1][2]}
    got = [(r.session_uuid, r.seq, r.id) for r in entry.queries()["consecutive_dedupe"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and len({s for s, _, _ in got}) == len(sessions) > 1


def test_repeats_across_blocks_and_null_groups(spark):
    rows = [(g, n, v) for g in ("a", None) for n, v in enumerate(["x", "x", None, None, "x", "y", "y", "y", "y", "y", "z"])]
    rows += [("a", 50, "z"), ("a", None, "x"), ("a", -9, "x"), ("a", 90, None)]
    df = spark.createDataFrame(rows, "s string, n int, v string")
    want = [(None, 0), (None, 2), (None, 4), (None, 5), (None, 10), ("a", None), ("a", 2), ("a", 4), ("a", 5), ("a", 10), ("a", 90)]
    for block in (1, 2, 3, 4096):
        got = [(r.s, r.n) for r in drop_repeats(df, ["s"], ["n"], "v", block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def title(text):
    text = text.strip(expr.WHITE_SPACE)
    if text.startswith("<command-") and "</command-name>" in text.partition("<command-name>")[2]:
        return text.partition("<command-name>")[2].partition("</command-name>")[0].strip(expr.WHITE_SPACE)
    for opening, closing in (("<local-command-caveat", "</local-command-caveat>"), ("<task-notification", "</task-notification>"), ("[Request interrupted", "]")):
        if text.startswith(opening):
            text = text.partition(closing)[2].strip(expr.WHITE_SPACE)
            break
    return text[:100]


def test_titles_of_all_user_texts(spark, sf):
    got = {r.id: r.title for r in entry.queries()["title_from"](spark, sf).collect()}
    rows = table(sf, "messages", "id, role, content")
    assert got == {k: title(c) for k, role, c in rows if role == "user" and c is not None}
    assert any(role == "user" and c and c != c.strip() for _, role, c in rows)


def test_wrapped_titles(spark, monkeypatch):
    texts = {
        "<command-name>/init</command-name>": "/init",
        "\n\t<command-message>m</command-message>\n<command-name>\n/go </command-name> x": "/go",
        "<command-name>open": "<command-name>open",
        "\u3000<task-notification>a</task-notification>\n real\u00a0": "real",
        "[Request interrupted by user]\n": "",
        "<local-command-caveat>only": "",
        "\n" + "位" * 150 + "\n": "位" * 100,
        " \t\n": "",
    }
    df = spark.createDataFrame([(k, "user", t) for k, t in enumerate(texts)], "id int, role string, content string")
    monkeypatch.setattr(reference_queries, "table", lambda *_: df)
    got = [r.title for r in reference_queries.title_from(spark, "").orderBy("id").collect()]
    assert got == list(texts.values()) == [title(t) for t in texts]


def test_categories_of_several_names_are_sorted(spark, monkeypatch):
    maps = ['{"z":1, "a" :2,"B":3}', '{"one":1}', "{}", None, "{cut"]
    df = spark.createDataFrame([(str(k), "m", c) for k, c in enumerate(maps)], "session_uuid string, model string, categories_json string")
    monkeypatch.setattr(reference_queries, "table", lambda *_: df)
    got = {r.session_uuid: r.categories_json for r in reference_queries.canonical_categories(spark, "").collect()}
    assert got == {str(k): json.dumps(json.loads(maps[k]), sort_keys=True, separators=(",", ":")) for k in (0, 1, 2)}
