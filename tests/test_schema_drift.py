import json

from pyspark.sql import functions as F

from threadloom.operators import schema_drift as sd


def kinds(**fields):
    return {k: (frozenset([v]), frozenset()) for k, v in fields.items()}


def test_parse_schema_reads_nesting_and_odd_names():
    got = sd.parse_schema(
        "OBJECT<a: BIGINT, `b c:<`: STRING, d: OBJECT<x: ARRAY<OBJECT<y: VOID, z: DECIMAL(3,1)>>, w: BOOLEAN>, e: VOID, f: ARRAY<STRING>, g: DECIMAL(2,0)>",
    )
    assert got == {
        "a": ("number", [], "BIGINT"), "b c:<": ("string", [], "STRING"), "d": ("object", ["w", "x"], "OBJECT"), "f": ("array", [], "ARRAY"), "g": ("number", [], "DECIMAL(2,0)")
    }
    assert sd.parse_schema("OBJECT<>") == {}


def test_rename_needs_a_single_pair_of_one_type():
    one = {"1.0": kinds(a="string", k="number"), "1.1": kinds(b="string", k="number")}
    assert sd.diff_versions(one, ["1.0", "1.1"]) == [("a", "b", "renamed", "1.1")]
    two = {"1.0": kinds(a="string", c="string"), "1.1": kinds(b="string", d="string")}
    assert {x[2] for x in sd.diff_versions(two, ["1.0", "1.1"])} == {"added", "removed"}
    other = {"1.0": kinds(a="string"), "1.1": kinds(b="number")}
    assert sd.diff_versions(other, ["1.0", "1.1"]) == [("a", "", "removed", "1.1"), ("b", "", "added", "1.1")]


def test_whole_types_and_retyped():
    seen = {"1.0": kinds(a="string"), "1.2": kinds(a="object")}
    assert sd.diff_versions(seen, ["1.0", "1.1", "1.2"]) == [("*", "", "removed", "1.1"), ("*", "", "added", "1.2")]
    assert sd.diff_versions(seen, ["1.0", "1.2"]) == [("a", "", "retyped", "1.2")]


def test_versions_order_by_numbers():
    assert sorted(["1.10.0", "1.9", "1.2.3"], key=sd.version_key) == ["1.2.3", "1.9", "1.10.0"]


def test_flooding_prefers_alike_names_and_children():
    old = {"leafUuid": (frozenset(["object"]), frozenset(["a", "b"])), "other": (frozenset(["object"]), frozenset(["q"]))}
    new = {"leaf_uuid": (frozenset(["object"]), frozenset(["a", "b"])), "branch": (frozenset(["object"]), frozenset(["z"]))}
    got = sd.correspondences(old, new, {"kept"})
    assert (got[0][0], got[0][1]) == ("leafUuid", "leaf_uuid") and len(got) == 2


def frames(spark, records):
    rows = [(s, r, k, v, json.dumps(body)) for k, (s, r, v, body) in enumerate(records)]
    df = spark.createDataFrame(
        rows, "src string, record string, row_id bigint, version string, body string"
    ).withColumn("b", F.expr("parse_json(body)"))
    schemas = df.select("src", "record", "version", F.expr("schema_of_variant(b)").alias("schema"))
    return df.select(
        "src", "record", "row_id", "version", F.expr("try_variant_get(b, '$', 'map<string,variant>')").alias("fields")
    ), schemas


def test_report_and_unified_table(spark):
    records = [
        ("s", "t", "1.0", {"cwd": "/a", "n": 1, "x": None}),
        ("s", "t", "1.0", {"cwd": "/b"}),
        ("s", "t", "2.0", {"path": "/c", "n": "7", "extra": True}),
        ("s", "t", None, {"zzz": 1}),
        ("s", "u", "2.0", {"o": {"p": 1}}),
    ]
    rows, schemas = frames(spark, records)
    got = {tuple(r) for r in sd.drift_report(schemas).collect()}
    assert got == {
        ("s", "t", "cwd", "path", "renamed", "2.0"),
        ("s", "t", "n", "", "retyped", "2.0"),
        ("s", "t", "extra", "", "added", "2.0"),
        ("s", "u", "*", "", "added", "2.0"),
    }
    table = sorted(sd.unify(rows, schemas).collect(), key=lambda r: r.row_id)
    assert [r.f_path for r in table] == ["/a", "/b", "/c", None, None]
    assert [r.f_n for r in table] == ["1", None, "7", None, None]
    assert table[2].f_extra is True and json.loads(table[4].f_o) == {"p": 1}


def test_empty_and_repeated(spark):
    _, schemas = frames(spark, [("s", "t", "1.0", {"a": 1})] * 3)
    assert sd.drift_report(schemas).count() == 0
    assert sd.drift_report(schemas.limit(0)).count() == 0


def test_version_text_in_any_form(spark):
    df = spark.createDataFrame(
        [("v1.2.3",), ("1.2.3+abc",), ('{"build":"x","semver":"0.30.1+1f"}',), ("none",), (None,)], "v string"
    )
    assert [r[0] for r in df.select(sd.version_text(F.col("v"))).collect()] == ["1.2.3", "1.2.3", "0.30.1", None, None]


def field(kind, *children):
    return (frozenset([kind]), frozenset(children))


def test_settled_scores_choose_among_several_pairs(monkeypatch):
    """Names alone mislead here: what the objects hold flows to their pairs."""
    old = {"a": {"meta_info": field("object", "sha", "branch"), "data": field("object", "width", "height"), "keep": field("string")}}
    new = {"b": {"meta_data": field("object", "width", "height"), "git": field("object", "sha", "branch"), "keep": field("string")}}
    want = {("meta_info", "git", "renamed", "b"), ("data", "meta_data", "renamed", "b")}
    assert set(sd.diff_versions(old | new, ["a", "b"], single_pairs=False)) == want
    assert {c for _, _, c, _ in sd.diff_versions(old | new, ["a", "b"])} == {"added", "removed"}
    monkeypatch.setattr(sd, "flood", lambda old, new, kept: {(a, b): float(a[0] == b[0]) for a in old for b in new})
    assert set(sd.diff_versions(old | new, ["a", "b"], single_pairs=False)) != want


def test_unlike_names_are_no_rename_by_score():
    both = {k: field("string") for k in ("k", "uuid", "text")}
    old, new = {"a": {"userType": field("string"), **both}}, {"b": {"zz9": field("string"), **both}}
    assert {c for _, _, c, _ in sd.diff_versions(old | new, ["a", "b"], single_pairs=False)} == {"added", "removed"}
    assert {c for _, _, c, _ in sd.diff_versions(old | new, ["a", "b"])} == {"renamed"}


def test_unified_table_loses_no_value(spark):
    records = [
        ("s", "t", "1.0", {"n": "abc", "big": 9007199254740993, "part": 1}),
        ("s", "t", "1.0", {"n": "12", "big": 5, "part": 2}),
        ("s", "t", "2.0", {"n": 7, "big": -9007199254740993, "part": 2.25, "f_n": True, "uncast": "x"}),
    ]
    rows, schemas = frames(spark, records)
    got = sorted(sd.unify(rows, schemas).collect(), key=lambda r: r.row_id)
    assert [r.f_n for r in got] == [None, 12, 7] and got[0].uncast == {"n": "abc"} and got[1].uncast == {}
    assert [r.f_big for r in got] == [9007199254740993, 5, -9007199254740993]
    assert [float(r.f_part) for r in got] == [1, 2, 2.25] and got[2].f_f_n is True and got[2].f_uncast == "x"
    few = sorted(sd.unify(rows, schemas, most_columns=1).collect(), key=lambda r: r.row_id)
    assert few[0].f_big == 9007199254740993 and few[0].more == {"n": "abc", "part": "1"} and "f_n" not in few[0]
