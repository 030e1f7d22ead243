import json

from pyspark.sql import functions as F

from threadloom.operators import nested

SCHEMA = "line_id bigint, raw_line string, ord int, node string, e string"


def frame(spark, *bodies):
    return spark.createDataFrame(
        [(k, b if b is None or isinstance(b, str) and b.startswith("{cut") else json.dumps(b), 0, "", "") for k, b in enumerate(bodies)],
        SCHEMA,
    )


def rows(df):
    return sorted((r.line_id, r["child"], r.parent_ord, r["ord"]) for r in nested.elements(df).collect())


def test_event_shapes(spark):
    blocks = [
        "text",
        {"type": "text"},
        None,
        5,
        "",
        {"type": "tool_result", "content": ["a", None, {"x": 1}]},
        {"type": "tool_result", "content": "s"},
        {"type": "tool_result", "content": {"y": 1}},
        {"type": "tool_result", "content": ""},
    ]
    events = frame(
        spark,
        {"message": {"content": blocks}},
        {"message": {"content": "alone"}},
        {"message": {"content": ""}},
        {"message": {"content": {"type": "tool_result", "content": "z"}}},
        {"message": None},
        None,
        "{cut",
        {"message": {"content": 3}},
    )
    none = frame(spark)
    got = rows(nested.holders(events, none, none))
    assert got == sorted(
        [
            *[(0, "message_block", -1, k) for k in (0, 1, 4, 5, 6, 7, 8)],
            (0, "result_block", 5, 0),
            (0, "result_block", 5, 2),
            (0, "result_block", 6, 0),
            (0, "result_block", 7, 0),
            (1, "message_block", -1, 0),
            (3, "message_block", -1, 0),
            (3, "result_block", 0, 0),
        ],
    )


def test_rollouts_and_chats(spark):
    rollouts = frame(
        spark,
        {"payload": {"type": "message", "content": ["a", {"b": 1}, None]}},
        {"payload": {"type": "other", "content": ["a"]}},
        {"payload": {"type": "message", "content": "s"}},
    )
    chats = frame(
        spark,
        {"id": 1, "toolCalls": [{"n": 1}, None, "no"], "thoughts": {"t": 1}},
        {"$set": {"messages": [{"thoughts": [{"a": 1}]}, None, {"toolCalls": {"n": 2}}]}},
        {"id": 2, "toolCalls": "text", "thoughts": None},
    )
    got = rows(nested.holders(frame(spark), rollouts, chats))
    assert got == sorted(
        [
            (0, "content_block", -1, 0),
            (0, "content_block", -1, 1),
            (2, "content_block", -1, 0),
            (0, "tool_call", -1, 0),
            (0, "thought", -1, 0),
            (1, "thought", 0, 0),
            (1, "tool_call", 2, 0),
        ],
    )


def events_of(spark, *raw):
    df = spark.createDataFrame([(k, r, 0, "", "") for k, r in enumerate(raw)], SCHEMA)
    return nested.holders(df, frame(spark), frame(spark))


def test_identity_ignores_spelling_and_is_shared(spark):
    held = events_of(
        spark,
        '{"message":{"content":[{"b":[1,{"c":"x"}],"a":2}]}}',
        '{ "message" : {"content": [ {"a" :2, "b":[ 1, {"c":"x"} ] } ] } }',
        '{"message":{"content":[{"b":[{"c":"x"},1],"a":2}]}}',
    )
    ids = [r.node for r in nested.elements(held).orderBy("line_id").collect()]
    assert ids[0] == ids[1] != ids[2]
    stored = {r.node: (r.n, r.body) for r in nested.stored(nested.descend(held, bodies=True)).collect()}
    assert stored[ids[0]] == (2, '{"a":2,"b":[1,{"c":"x"}]}') and len(stored) == 5
    assert {n for n, body in stored.values() if body == '{"c":"x"}'} == {3}


def test_parents_are_linked_by_identity(spark):
    got = nested.descend(events_of(spark, '{"message":{"role":"user","usage":{"k":{"n":1}},"content":[{"type":"tool_result","content":[{"k":1},"s"]},"t"]}}')).collect()
    node = {(r["child"], r["ord"], r.path): r.node for r in got}
    parent = {(r["child"], r["ord"], r.path): r.parent for r in got}
    record, block = node["record", -1, ""], node["message_block", 0, ""]
    assert parent["message_block", 0, ""] == parent["message_block", 1, ""] == parent["object", -1, "/usage"] == record
    assert parent["result_block", 0, ""] == parent["result_block", 1, ""] == block
    assert parent["object", -1, "/usage/k"] == node["object", -1, "/usage"]
    assert [k for k, p in parent.items() if p is None] == [("record", -1, "")]


def test_identity_at_any_depth_and_of_long_texts(spark):
    deep = {"a": {"b": {"c": {"d": {"e": "x" * 300_000}}}}}
    other = {"a": {"b": {"c": {"d": {"e": "y"}}}}}
    held = events_of(spark, *[f'{{"message":{{"content":{t}}}}}' for t in (json.dumps(deep), json.dumps(deep, indent=1), json.dumps(other))])
    ids = [r.node for r in nested.elements(held).orderBy("line_id").collect()]
    assert ids[0] == ids[1] != ids[2]


def below(v, path=""):
    """Paths of all objects in a value, by brute force."""
    found = [path] if isinstance(v, dict) else []
    for k, e in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        found += below(e, f"{path}/{k}")
    return found


def test_objects_of_every_depth_are_linked_and_stored_once(spark):
    deep = {"z": 1}
    for k in range(40):
        deep = {"in": [[deep]], "k": k}
    use = {"type": "tool_use", "input": {"edits": [{"a": 1.50}, {"a": 1.5}, {"b": {"c": None}}], "deep": deep}}
    result = {"type": "tool_result", "content": ["s", {"x": {"c": None}}, [{"y": 1}], None], "more": {"c": None}}
    events = frame(spark, {"message": {"content": [use, result, "s"]}})
    chats = frame(spark, {"toolCalls": [{"args": {"c": None}, "result": [{"r": {"c": None}}]}]})
    occurrences = nested.holders(events, frame(spark), chats)
    got = nested.descend(occurrences, bodies=True).collect()
    paths = lambda root, at: sorted(r.path for r in got if (r.root, r.parent_ord, r["ord"]) == (root, *at))
    assert paths("message_block", (-1, 0)) == sorted(below(use))
    assert paths("message_block", (-1, 1)) == ["", "/content/2/0", "/more"]
    assert paths("result_block", (1, 0)) == [""] and paths("result_block", (1, 1)) == ["", "/x"]
    assert paths("tool_call", (-1, 0)) == ["", "/args", "/result/0", "/result/0/r"]
    node = {(r.root, r.parent_ord, r["ord"], r.path): r.node for r in got}
    parent = {(r.root, r.parent_ord, r["ord"], r.path): r.parent for r in got}
    assert parent["message_block", -1, 0, "/input/edits/2/b"] == node["message_block", -1, 0, "/input/edits/2"]
    assert parent["message_block", -1, 0, "/input/edits/2"] == node["message_block", -1, 0, "/input"]
    assert parent["result_block", 1, 1, ""] == parent["result_block", 1, 0, ""] == node["message_block", -1, 1, ""]
    assert parent["tool_call", -1, 0, "/result/0"] == node["tool_call", -1, 0, ""]
    assert parent["tool_call", -1, 0, ""] in {r.node for r in got if r["child"] == "record"}
    same = {r.node for r in got if r.body == '{"c":null}'}
    assert len(same) == 1 and {r.n for r in nested.stored(nested.descend(occurrences, bodies=True)).collect() if r.node in same} == {5}
    assert len({r.node for r in got}) == len({r.body for r in got})


def test_deep_bridge_has_every_object_of_the_tables(spark, sf):
    from threadloom.plans import data_queries as q

    got = q.p5_bridge(spark, sf)
    kept = got.where(got["child"].isin(*nested.ELEMENTS)).select("line_id", "child", "parent_ord", "ord")
    flat = q.p5_found(spark, sf)
    assert kept.exceptAll(flat).isEmpty() and flat.exceptAll(kept).isEmpty()
    held = q._held(spark, sf).collect()
    want = sum(len(below(json.loads(r.text))) for r in held)
    texts = got.where("path = ''").where(got["child"].isin("message_block", "result_block", "content_block")).count()
    objects = got.count() - sum(
        isinstance(e, str) for r in held for *_, e in nested._elements(r.holder, r["at"], json.loads(r.text))
    )
    assert objects == want > 0 and texts > 0
