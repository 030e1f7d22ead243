import random

from threadloom.llm import conversations as cv

MESSAGES = "id bigint, session_uuid string, seq int, ts bigint, role string, content string, block int, v string"
SESSIONS = "uuid string, role string"


def brute(messages, sessions):
    first, per = {}, {}
    for i, u, q, _, r, t, *_ in messages:
        if u is not None and ((u, q) not in first or i < first[u, q][0]):
            first[u, q] = (i, r, t)
    for (u, q), (_, r, t) in first.items():
        per.setdefault(u, []).append((q, r, t))
    bad = set()
    for u in {s for s, _ in sessions if s is not None} | set(per):
        rows = sorted(per.get(u, []), key=lambda x: (x[0] is None, x[0] or 0))
        roles = [cv.ROLES.get((r or "").strip().lower()) for _, r, _ in rows]
        said = [r for r, (_, _, t) in zip(roles, rows) if r in ("user", "assistant") and (t or "").replace("​", "").strip()]
        fine = [q for q, _, _ in rows] == list(range(len(rows))) and None not in roles and said and said[0] == "user"
        if not fine or any(r == "user" and said[k + 1 : k + 2] != ["assistant"] for k, r in enumerate(said)):
            bad.add(u)
    return bad


def dropped(spark, messages, sessions):
    return {r.session_uuid for r in cv.to_drop(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(sessions, SESSIONS)).collect()}


def talk(u, n, start=0, **change):
    rows = [(start + k, u, k, 1000 + 10 * k, ["user", "assistant"][k % 2], f"text {k}", None, None) for k in range(n)]
    return [change.get("at", {}).get(k, r) for k, r in enumerate(rows)]


def test_random_sessions_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 4)
    rng = random.Random(9)
    messages, i = [], 0
    for s in range(150):
        for q in range(rng.randrange(0, 14)):
            if rng.random() < 0.04:
                continue
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                i += 1
                role = rng.choice(["user", "assistant"]) if rng.random() < 0.1 else [" User", "Model ", "human", "gemini"][q % 2 + rng.choice([0, 2]) * (q % 2 == 0)] if rng.random() < 0.95 else rng.choice(
                    ["thinking", "tool_use", None, "n/a", "system"]
                )
                text = rng.choice(["hi"] * 12 + [None, "", " ​ ", "\n"])
                messages.append((i, f"s{s}", q if rng.random() > 0.01 else None, None, role, text, None, None))
    rng.shuffle(messages)
    sessions = [(f"s{k}", "x") for k in range(160)] + [(None, "x"), ("s1", "x")]
    assert dropped(spark, messages, sessions) == brute(messages, sessions)


def test_long_session_over_many_blocks(spark):
    good, odd = talk("good", 6000), talk("odd", 6000, 10_000)
    odd[3001] = (*odd[3001][:4], "user", "again", None, None)
    gap = [r for r in talk("gap", 6000, 20_000) if r[2] != 4096]
    end = talk("end", 5001, 30_000)
    assert dropped(spark, good + odd + gap + end, []) == {"odd", "gap", "end"}


def test_empty_tables(spark):
    assert dropped(spark, [], []) == set()
    assert dropped(spark, [], [("a", None)]) == {"a"}
    assert dropped(spark, talk("a", 2), []) == set()


def test_rebuilt_rows_and_gaps(spark):
    rows = [(k, "a", k, 1_756_720_800 + 60 * k + 500_000 * (k >= 300), ["user", "assistant"][k % 2], f"t{k}", None, None) for k in range(400)]
    rows += [(900, "a", 5, None, "user", "copy", None, None), (901, "bad", 0, 1, "assistant", "x", None, None)]
    got = cv.rebuild(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame([], SESSIONS)).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(400)) and [r.content for r in got][5] == "t5"
    assert [r.segment for r in got] == [0] * 300 + [1] * 100


def test_units_of_time(spark):
    df = spark.createDataFrame(
        [(None,), (0,), (1756720800,), (1756720800123,), (1756720800123456,), (1756720800123456789,)], "ts bigint"
    )
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(cv.epoch_seconds(F.col("ts"))).collect()] == [None, None, *[1756720800] * 4]


def brute_segments(messages):
    first = {}
    for i, u, q, ts, r, t, *_ in messages:
        key = (u, q, i if q is None else None)
        if u is not None and (key not in first or i < first[key][0]):
            first[key] = (i, ts, r, t)
    per = {}
    for (u, q, _), (i, ts, r, t) in first.items():
        if ts and ts > 0:
            per.setdefault(u, []).append((ts, -1 if q is None else q, i, cv.ROLES.get((r or "").strip().lower()), bool((t or "").replace("​", "").strip())))
    gaps = sorted(b[0] - a[0] for rows in per.values() for a, b in zip(sorted(rows), sorted(rows)[1:]) if b[0] > a[0])
    limit = gaps[max(0, -(-len(gaps) * 99 // 100) - 1)] * cv.GAP_FACTOR if gaps else 2**62
    out = {}
    for u, rows in per.items():
        rows.sort()
        segment = turns = replies = n = 0
        last = before = known = block = None
        for ts, _, _, role, said in rows:
            cut = before is not None and ts - before > limit
            if cut:
                out[u, segment] = (n, turns, replies)
                segment, n, turns, replies = segment + 1, 0, 0, 0
            if ts // cv.SPAN != block:
                block, known = ts // cv.SPAN, None
            n, before = n + 1, ts
            user = None
            if said and role in ("user", "assistant"):
                user = role == "user"
            elif said and role is None:
                user = True if known is None else not known
            if user is not None:
                turns, known = turns + 1, user
                replies += not user and last is True and not cut
                last = user
        out[u, segment] = (n, turns, replies)
    return out


def test_sessions_by_time_against_brute_force(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for s in range(60):
        at = 1_700_000_000
        for q in range(rng.randrange(0, 30)):
            i += 1
            at += rng.choice([5, 20, 60, 0]) if q != 12 or s % 7 else 400_000
            rows.append((i, f"s{s}", q if rng.random() > 0.1 else None, at if rng.random() > 0.05 else 0, rng.choice(["user", "Assistant", "model", None, "tool_use", "?"]), rng.choice(["x", "x", "x", " ", None]), None, None))
    rows += [(5000, None, 1, 5, "user", "x", None, None), (1, "s0", 0, 1_700_000_000, "user", "x", None, None)]
    df = spark.createDataFrame(rows, MESSAGES)
    got = {(r.session_uuid, r.segment): (r.n_rows, r.n_turns, r.n_replies) for r in cv.sessionise(df.dropDuplicates(["id"])).collect()}
    seen = {r.id: tuple(r) for r in df.dropDuplicates(["id"]).collect()}
    assert got == brute_segments(list(seen.values()))
    assert max(k for _, k in got) > 0 and cv.sessionise(df.limit(0)).count() == 0
