import json
import random

from threadloom.operators import change_feed as cf

LINES = "source_file string, line_no bigint, line_id bigint, batch_no int, raw_line string, kind string, id string, pos int"


def brute(lines):
    newest, out = {}, set()
    for f, n, i, b, raw, *_ in lines:
        if n >= 2 and (b, i) > newest.get((f, n), ((-1, -1),))[0]:
            newest[f, n] = ((b, i), raw)
    per = {}
    for (f, n), (_, raw) in newest.items():
        per.setdefault(f, []).append((n, raw))
    for f, rows in per.items():
        live, bad = [], False
        for n, raw in sorted(rows):
            try:
                j = json.loads(raw)
            except (ValueError, TypeError):
                continue
            if not isinstance(j, dict):
                continue
            if "$set" in j:
                s = j["$set"]
                if isinstance(s, dict) and "messages" in s:
                    if not isinstance(s["messages"], list):
                        bad = True
                        break
                    live = [[m["id"], n] for m in s["messages"]]
            elif "$rewindTo" in j:
                ids = [i for i, _ in live]
                live = live[: ids.index(j["$rewindTo"])] if j["$rewindTo"] in ids else live
            elif j.get("id"):
                for m in live:
                    if m[0] == j["id"]:
                        m[1] = n
                        break
                else:
                    live.append([j["id"], n])
        if not bad:
            out |= {(f, p, i, n) for p, (i, n) in enumerate(live)}
    return out


def run(spark, lines):
    got = cf.live_messages(spark.createDataFrame(lines, LINES))
    return {tuple(r) for r in got.select("source_file", "pos", "msg_id", "line_no").collect()}


def random_logs(seed, files, length):
    rng, lines, line_id = random.Random(seed), [], 0
    for f in range(files):
        for n in range(1, length):
            kind = rng.random()
            ids = [f"m{k}" for k in range(7)]
            if kind < 0.05:
                body = {"$set": {"messages": [{"id": i} for i in rng.sample(ids, rng.randrange(5))]}}
            elif kind < 0.08:
                body = {"$set": rng.choice([{"lastUpdated": 1}, {}, None, 3])}
            elif kind < 0.3:
                body = {"$rewindTo": rng.choice(ids + ["nobody"])}
            elif kind < 0.33:
                body = rng.choice([{"id": ""}, {"id": None}, {"x": 1}, [1], "text", None])
            else:
                body = {"id": rng.choice(ids), "text": "x"}
            raw = json.dumps(body) if rng.random() > 0.03 else '{"id": "cut'
            for _ in range(rng.choice([1, 1, 1, 2])):
                line_id += 1
                lines.append((f"f{f}", n, line_id, rng.randrange(4), raw, None, None, None))
    rng.shuffle(lines)
    return lines


def test_random_logs_against_a_replay(spark):
    lines = random_logs(11, 40, 30)
    assert run(spark, lines) == brute(lines)


def test_long_file_crosses_position_blocks(spark):
    lines = [("big", n, n, 0, json.dumps({"id": f"m{n}"}), None, None, None) for n in range(2, 9000)]
    lines += [
        ("big", 9000, 9000, 0, json.dumps({"$rewindTo": "m8500"}), None, None, None),
        ("big", 9001, 9001, 0, json.dumps({"id": "m8600"}), None, None, None),
    ]
    assert run(spark, lines) == brute(lines)


def test_unusable_replacement_and_empty(spark):
    lines = [
        ("a", 2, 1, 0, '{"id":"x"}', None, None, None),
        ("a", 3, 2, 0, '{"$set":{"messages":null}}', None, None, None),
        ("b", 1, 3, 0, '{"sessionId":"s"}', None, None, None),
        ("c", 2, 4, 0, None, None, None, None),
    ]
    assert run(spark, lines) == set()
    assert run(spark, []) == set()


def test_nulls_in_every_column(spark):
    lines = [
        (None, 2, 1, 0, '{"id":"x"}', None, None, None),
        ("a", None, 2, 0, '{"id":"x"}', None, None, None),
        ("a", 2, None, None, '{"id":"old"}', None, None, None),
        ("a", 2, 3, 0, '{"id":"y"}', None, None, None),
        ("a", 3, 4, None, '{"id":"z"}', None, None, None),
    ]
    assert run(spark, lines) == {("a", 0, "y", 2), ("a", 1, "z", 3)}


def test_columns_of_last_writers(spark):
    rows = [
        (1, 1, "insert", "a", "x", None), (1, 2, "update", None, "y", None), (1, 2, "update", None, "y", None), (2, 1, "insert", "b", "z", 1), (2, 3, "delete", None, None, None), (2, 2, "update", "late", None, None),
        (3, 1, "insert", "c", "w", 2), (3, 2, "replace", "d", None, None), (4, 1, "delete", None, None, None), (4, 2, "update", "back", None, None), (None, 1, "insert", "n", None, None),
    ]
    df = spark.createDataFrame(rows, "k int, n int, op string, u string, v string, extra int")
    got = {tuple(r) for r in cf.apply_changes(df, ["k"], ["n"], "op", ["u", "v"]).collect()}
    assert got == {(1, "a", "y"), (3, "d", None), (4, "back", None), (None, "n", None)}


def test_hot_key(spark):
    rows = [(0, n, "update", f"v{n}" if n % 7 else None, None, 0) for n in range(3000)]
    df = spark.createDataFrame(rows, "k int, n int, op string, u string, v string, extra int").repartition(8)
    assert [tuple(r) for r in cf.apply_changes(df, ["k"], ["n"], "op", ["u"]).collect()] == [(0, "v2999")]


def test_message_columns_are_those_of_the_last_version(spark):
    put = lambda i, **more: json.dumps({"id": i, **more})
    lines = [
        ("f", 1, 1, 1, "{}"), ("f", 2, 2, 1, put("a", type="user", content="one", model="m")), ("f", 3, 3, 1, put("b", type="gemini", content="two")),
        ("f", 4, 4, 1, put("a", type="user", content="three")), ("f", 4, 5, 0, put("a", type="user", content="stale copy")),
        ("f", 5, 6, 1, json.dumps({"$rewindTo": "b"})), ("f", 6, 7, 1, put("b", type="info", content=[{"text": "four"}])),
        ("g", 2, 8, 1, json.dumps({"$set": {"messages": [{"id": "x", "type": "user"}, {"type": "noid"}, {"id": "y", "tokens": {"input": 1}}]}})), ("g", 3, 9, 1, "broken"), ("g", 4, 10, None, None),
    ]
    df = spark.createDataFrame(lines, "source_file string, line_no bigint, line_id bigint, batch_no int, raw_line string")
    got = {(r.source_file, r.pos): (r.msg_id, r.type, r.model, r.content, r.tokens) for r in cf.message_rows(df).collect()}
    assert got == {
        ("f", 0): ("a", "user", None, '"three"', None), ("f", 1): ("b", "info", None, '[{"text":"four"}]', None),
        ("g", 0): ("x", "user", None, None, None), ("g", 1): (None, None, None, None, None), ("g", 2): ("y", None, None, None, '{"input":1}'),
    }
    assert cf.message_rows(df.limit(0)).count() == 0
