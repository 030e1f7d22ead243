import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing

TARGETS = "source string, target_share double, max_repeats int, tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, ["a", "a", "a", "a", "a", "a", "b", "c"][k % 8], "word " * (20 + k % 30), 0) for k in range(1600)]
    rows += [(5000, None, "x", 0), (5001, "z", "not wanted", 0), (5002, "a", None, 0), (5003, "b", "", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens int")


def mix(spark, docs, targets, **kw):
    t = spark.createDataFrame([(*x, 0) for x in targets], TARGETS)
    m = mixing.mix(docs, t, block_tokens=300, **kw)
    return m, mixing.shares(m, t)


def test_shares_meet_their_targets_within_a_document(spark, docs):
    m, s = mix(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("nowhere", 0.0, 1)], shard_tokens=4000)
    got = {r.source: r for r in s.collect()}
    total = sum(r.tokens for r in got.values())
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[name].actual_share - share) * total <= 60
    assert got["b"].most_repeats == 2 and got["a"].most_repeats == 1 and got["nowhere"].tokens == 0
    assert m.groupBy("shard").count().count() == 2 ** math.ceil(math.log2(total / 4000))


def test_missing_sources_scale_the_others(spark, docs):
    _, s = mix(spark, docs, [("a", 0.25, 2), ("b", 0.25, 4), ("gone", 0.5, 5)])
    got = {r.source: r.actual_share for r in s.collect()}
    assert got["gone"] == 0 and got["a"] == pytest.approx(0.5, abs=0.01)


def test_no_document_above_its_cap_and_whole_passes_first(spark, docs):
    m, _ = mix(spark, docs, [("a", 0.1, 1), ("b", 0.9, 3)])
    times = m.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("turns")).collect()
    assert max(r.n for r in times) == 3 and all(r.n == r.turns for r in times)
    assert {r.n for r in times if r.source == "b"} == {3}


def test_the_same_seed_gives_the_same_mix_on_any_partitioning(spark, docs):
    a, _ = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], shard_tokens=5000)
    b, _ = mix(spark, docs.repartition(7), [("a", 0.5, 1), ("b", 0.5, 2)], shard_tokens=5000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_tree_splits_exactly():
    quotas = [1000, 37, 0, 5]
    levels = mixing.split_tree(quotas, 4, 1)
    shard = [mixing.shard_of(levels, np.full(n, s), np.arange(n)) for s, n in enumerate(quotas)]
    sizes = np.bincount(np.concatenate(shard), minlength=16)
    assert sizes.sum() == 1042 and sizes.max() - sizes.min() <= 4
    assert [len(x) for x in shard] == quotas
    spread = np.bincount(shard[0], minlength=16) / sizes
    assert abs(spread - 1000 / 1042).max() < 0.1


def planned(spark, totals, targets):
    t = spark.createDataFrame(totals, "source string, tokens bigint")
    rows = mixing.plan(t, spark.createDataFrame([(*x, 0) for x in targets], TARGETS)).collect()
    return {r.source: (r.share, r.passes, r.rest) for r in rows}


def test_plan(spark):
    assert planned(spark, [], [("a", 1.0, 1)]) == {}
    got = planned(spark, [("a", 100), ("b", 100), ("z", 5)], [("a", 0.5, 3), ("b", 0.5, 1), (None, 0.2, 1), ("gone", 0.4, 2), ("z", 0.0, 1)])
    assert got == {"a": (0.5, 1, 0.0), "b": (0.5, 1, 0.0)}
    assert planned(spark, [("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 4)]) == {"a": (0.5, 0, 40.0), "b": (0.5, 4, 0.0)}


def test_many_sources_and_a_finer_tree(spark, docs, monkeypatch):
    """Levels that the driver may not hold are split node by node; each shard is still a fair sample."""
    monkeypatch.setattr(mixing, "MOST_CELLS", 8)
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)] + [(f"x{k}", 0.0, 1) for k in range(300)]
    m, s = mix(spark, docs, targets, shard_tokens=1500)
    sizes = {r.shard: r["count"] for r in m.groupBy("shard").count().collect()}
    total = m.agg(F.sum("n_tokens")).first()[0]
    assert len(sizes) == 2 ** math.ceil(math.log2(total / 1500)) and max(sizes) == len(sizes) - 1
    assert m.count() == m.select("source", "doc_id", "turn").distinct().count()
    assert sum(r.actual_share for r in s.collect()) == pytest.approx(1)


def test_running_sums_over_hash_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES_BITS", 3)
    df = spark.range(500).selectExpr("id", "id % 2 as g", "id % 7 as v")
    rows = mixing.ranked(df, ["g"], F.xxhash64("id"), ["id"], F.col("v"), "upto").collect()
    for g in (0, 1):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.upto)
        assert own[-1].upto == sum(r.v for r in own) and all(b.upto - a.upto in (b.v, 0) or b.v == 0 or a.v == 0 for a, b in zip(own, own[1:]))


def test_empty(spark, docs):
    m, s = mix(spark, docs.limit(0), [("a", 1.0, 1)])
    assert m.count() == 0 and [r.actual_share for r in s.collect()] == [0.0]
    m, _ = mix(spark, docs, [])
    assert m.count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame(
        [(1, "a", "hello world <|endoftext|>"), (2, "a", None), (3, "a", "x y " * 100_000)],
        "doc_id bigint, source string, text string",
    )
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df).collect()}
    assert got[1] > 5 and got[2] == 0 and got[3] >= 200_000
