import random

import pytest

from threadloom.operators.text_index import TextIndex, scored

SCHEMA = "id bigint, content string, gram string, size int"


def messages(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 7) for k, t in rows.items()], SCHEMA)


def brute(rows, terms):
    out = {}
    for k, text in rows.items():
        low = (text or "").lower()
        f = tuple(sum(low.startswith(t.lower(), i) for i in range(len(low))) for t in terms)
        if any(f):
            out[k] = f
    return out


def found(index, terms):
    return {r.id: tuple(r[f"f{k}"] for k in range(len(terms))) for r in index.hits(terms).collect()}


def texts(rng, n):
    words = ["lockfile", "Lock", "file", "位移值", "aaaa", "permission denied", "x", "naïve", "LOCKFILE", "\n"]
    return " ".join(rng.choice(words) for _ in range(n))


TERMS = ["lockfile", "permission denied", "aaa", "位移值", "le x", "ïve", "nothing here"]


def test_hits_equal_brute_force_through_runs_removals_and_merges(spark, tmp_path):
    rng = random.Random(1)
    path = f"file://{tmp_path}/text"
    index = TextIndex(spark, path)
    rows = {k: texts(rng, rng.randrange(0, 30)) for k in range(80)} | {900: None, 901: "", 902: "ab", 903: "lockfile " * 2000}
    index.add(messages(spark, rows))
    assert found(index, TERMS) == brute(rows, TERMS)
    more = {k: texts(rng, 10) for k in range(100, 130)}
    index.add(messages(spark, more))
    rows |= more
    index.remove(messages(spark, {k: None for k in [*range(0, 20), 100, 5555]}))
    rows = {k: t for k, t in rows.items() if k >= 20 and k != 100}
    index.add(messages(spark, {5: "lockfile again", 6: "other"}))  # removed ids come again with another text
    rows |= {5: "lockfile again", 6: "other"}
    assert found(index, TERMS) == brute(rows, TERMS)
    again = TextIndex(spark, path)
    again.merge()
    assert found(again, TERMS) == brute(rows, TERMS) and not again.gone and len(again.runs) == 2
    sizes = [max(len(t or "") - 2, 0) for t in rows.values()]
    assert (again.n, again.total) == (len(rows), sum(sizes)) and again.average == pytest.approx(sum(sizes) / len(rows))


def test_only_the_buckets_of_the_terms_are_read(spark):
    index = TextIndex(spark)
    index.add(messages(spark, {k: "lockfile number %d" % k for k in range(50)}))
    plan = index.hits(["lockfile"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "content" not in plan


def test_scores_are_those_of_the_scan(spark, sf):
    from threadloom.plans import search

    m = spark.read.parquet(f"{sf}/messages.parquet").select("id", "content")
    index = TextIndex(spark)
    index.add(m)
    terms = ["lockfile", "the"]
    want = {r.id: r.bm25 for r in search._scored(m.where("contains(lower(content), 'lockfile') and contains(lower(content), 'the')"), m, terms).collect()}
    got = {r.id: r.bm25 for r in scored(index, terms, True).collect()}
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)


def test_empty_and_too_short(spark):
    index = TextIndex(spark)
    index.add(messages(spark, {1: "abc"}).limit(0))
    assert index.n == 0 and found(index, ["abc"]) == {} and index.ids().count() == 0
    index.remove(messages(spark, {1: ""}))
    with pytest.raises(ValueError):
        index.hits(["ab"])
