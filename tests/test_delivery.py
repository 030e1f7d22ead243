import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import delivery

SCHEMA = "type string, ident string, batch int, row bigint, rank string, hi string"


def found(df, **kw):
    out = delivery.surplus_copies(df, [F.col("type"), F.col("ident")], F.col("batch"), F.col("row"), **kw)
    return {r.row_id for r in out.collect()}


def brute(rows):
    best, keyed = {}, []
    for t, i, b, r, *_ in rows:
        if i is not None and i.strip():
            key = (t, i.strip().lower())
            keyed.append((key, b if b is not None else -(2**62), r))
            best[key] = max(best.get(key, (-(2**63), 0)), keyed[-1][1:])
    return {r for k, b, r in keyed if best[k] != (b, r)}


def test_random_feed_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for r in range(600):
        ident = rng.choice([None, "", "  ", "HOT", "hot", " Hot ", *[f"id{rng.randrange(120)}" for _ in range(6)]])
        rows.append((rng.choice(["a", "b", None]), ident, rng.choice([None, *range(9)]), r, "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    assert found(df, ingest_batches=7, merge_every=2) == brute(rows)


def test_ties_in_batch_keep_the_largest_row(spark):
    rows = [("a", "x", 1, k, None, None) for k in range(5)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {0, 1, 2, 3}


def test_empty_and_unidentified(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()
    assert found(spark.createDataFrame([("a", None, 1, 1, "", ""), (None, " ", None, 2, "", "")], SCHEMA)) == set()


def test_very_long_identifiers(spark):
    long = "k" * 200_000
    assert found(
        spark.createDataFrame(
            [("a", long, 1, 1, "", ""), ("a", long + " ", 2, 2, "", ""), ("a", long + "z", 2, 3, "", "")], SCHEMA
        ),
    ) == {1}


def test_find_sorted_with_equal_halves():
    hi, lo = np.array([1, 1, 1, 5]), np.array([2, 4, 9, 0])
    got = delivery.find_sorted(hi, lo, np.array([1, 1, 1, 5, 5, 7]), np.array([4, 9, 5, 0, 1, 0]))
    assert got.tolist() == [1, 2, -1, 3, -1, -1]


def batch(spark, rows):
    return spark.createDataFrame(rows, "hi bigint, lo bigint, rank bigint, row_id bigint")


def test_index_survives_merges_and_replaces_what_it_keeps(spark):
    """Batches in the order of arrival: later copies replace, late batches with earlier copies don't."""
    index = delivery.DeliveryIndex(spark, expected_ids=100, merge_every=2)
    for k in (0, 1, 4, 2, 3):
        index.add(batch(spark, [(h, h, k, 100 * k + h) for h in range(k, k + 10)]))
    assert len(index.runs) <= 2
    best = {h: max(k for k in range(5) if k <= h < k + 10) for h in range(14)}
    assert sorted(r.row_id for r in index.kept().collect()) == sorted(100 * k + h for h, k in best.items())


def test_index_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    first = delivery.DeliveryIndex(spark, path, 10)
    first.add(batch(spark, [(h * 2**60, h, 1, h) for h in range(8)]))
    again = delivery.DeliveryIndex(spark.newSession(), path)
    assert (again.bits, again.runs, again.ids) == (first.bits, first.runs, 8)
    again.add(batch(spark, [(3 * 2**60, 3, 2, 103), (5, 5, 0, 105)]))
    assert sorted(r.row_id for r in again.kept().collect()) == [0, 1, 2, 4, 5, 6, 7, 103, 105]
    import pytest

    with pytest.raises(Exception):  # the first one's state is no longer the last
        first.add(batch(spark, [(9, 9, 9, 9)]))


def test_surplus_to_an_earlier_session(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    key = lambda df: delivery.surplus_copies(df, [F.col("type"), F.col("ident")], F.col("batch"), F.col("row"), index_path=path)
    one = spark.createDataFrame([("a", "x", 1, 1, "", ""), ("a", "y", 1, 2, "", ""), ("a", "y", 2, 3, "", "")], SCHEMA)
    assert {r.row_id for r in key(one).collect()} == {2}
    two = spark.createDataFrame([("a", "x", 0, 4, "", ""), ("a", "y", 5, 5, "", ""), ("a", "z", 5, 6, "", "")], SCHEMA)
    assert {r.row_id for r in key(two).collect()} == {4}


def test_prefixes_grow_with_the_index(spark, monkeypatch):
    monkeypatch.setattr(delivery, "IDS_PER_ARRAY", 4)
    index = delivery.DeliveryIndex(spark, merge_every=9)
    rng = random.Random(2)
    ids = [(rng.randrange(-(2**63), 2**63), k, 1, k) for k in range(300)]
    for k in range(3):
        index.add(batch(spark, ids[k * 100 : k * 100 + 100]))
    assert index.bits > 4 and index.ids == 300
    index.add(batch(spark, [(h, lo, 0, 1000 + r) for h, lo, _, r in ids]))
    assert sorted(r.row_id for r in index.kept().collect()) == list(range(300))


def test_parts_of_a_feed_with_undated_rows_are_even(spark, monkeypatch):
    sizes = []
    add = delivery.DeliveryIndex.add
    monkeypatch.setattr(delivery.DeliveryIndex, "add", lambda self, b: (sizes.append(b.count()), add(self, b))[1])
    rows = [("a", f"i{k}", 1 + k // 100 if k else None, k, "", "") for k in range(2000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == set()
    assert sizes[0] == 1 and len(sizes) == 5 and max(sizes[1:]) <= 600


def test_intermediate_tables_can_be_dropped(spark, tmp_path):
    from threadloom import shared

    df = shared.materialise(spark.range(3), "numbers")
    assert df.count() == 3 and spark.sparkContext.applicationId in df.inputFiles()[0]
    path = shared.new_path(spark, "gone")
    spark.range(2).write.parquet(path)
    shared.drop_path(spark, path)
    import pytest

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
