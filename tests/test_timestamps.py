import itertools
import random

import pytest

from threadloom.operators import timestamps as ts

STATED = {"slash": "mdy", "dot": "dmy", "overlap": "earlier", "unit": "size"}


def one(value, zone="Europe/Berlin", conventions=STATED):
    got = ts.interpretations(value, zone, conventions)
    best = min(got, key=lambda x: x[2]) if got else None
    return best[0] if best and best[2] < ts.AGAINST else None


@pytest.mark.parametrize(
    ("value", "us"),
    [
        ("2025-09-01T10:00:00.5Z", 1756720800500000), ("2025-09-01t12:00:00,250+02:00", 1756720800250000), ("2025-09-01 12:00", 1756720800000000), ("20250901T100000Z", 1756720800000000),
        ("01.09.2025 12:00:00", 1756720800000000), ("09/01/2025 12:00:00 PM", 1756720800000000), ("09/01/2025 12:00:00 AM", 1756677600000000), ("Mon, 01 Sep 2025 12:00:00 +0200", 1756720800000000),
        ("Mon Sep 01 2025 12:00:00 GMT+0200 (Central European Time)", 1756720800000000), ("2025-09-01T12:00:00+02:00[Europe/Berlin]", 1756720800000000), ("1756720800", 1756720800000000),
        ("1756720800123", 1756720800123000), ("1756720800123456", 1756720800123456), ("1756720800123456789", 1756720800123456), ("1756720800.0000019", 1756720800000001), ("2025-09-01T10:00:00.123456789Z", 1756720800123456),
        ("2025-09-01 10:00:00 UTC", 1756720800000000), ("2025-09-01", 1756677600000000),
    ],
)
def test_forms(value, us):
    assert one(value) == us


@pytest.mark.parametrize(
    "value",
    [
        None,
        "",
        "  ",
        "0",
        "N/A",
        "Invalid Date",
        "0000-00-00T00:00:00Z",
        "2025-13-40T00:00:00Z",
        "31/31/2025 1:00:00 AM",
        "13/01/2025 1:00:00 AM",
        "x" * 100_000,
    ],
)
def test_no_times(value):
    assert one(value) is None


def test_overlap_gives_both_and_the_stated_one_wins():
    both = ts.interpretations("2025-10-26 02:30:00", "Europe/Berlin", {})
    assert [x[0] for x in both] == [1761438600000000, 1761442200000000] and both[0][2] == both[1][2]
    assert one("2025-10-26 02:30:00") == 1761438600000000
    assert one("2025-10-26 02:30:00", conventions={"overlap": "later"}) == 1761442200000000
    assert one("2025-09-01 10:00", None) is None


def cost(cands, path):
    total = sum(c[k]["cost"] for c, k in zip(cands, path))
    for a, b, i, j in zip(cands, cands[1:], path, path[1:]):
        total += ts.SWITCH * (a[i]["fmt"] != b[j]["fmt"]) + ts.BACKWARD * (a[i]["us"] > b[j]["us"])
    return total


def random_chain(rng, n):
    return [[{"us": rng.randrange(50), "fmt": rng.choice("ab"), "cost": float(rng.choice([0, 0, 1]))} for _ in range(rng.choice([1, 2, 3]))] for _ in range(n)]


def test_viterbi_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        chain = random_chain(rng, rng.randrange(1, 7))
        best = min(cost(chain, p) for p in itertools.product(*[range(len(c)) for c in chain]))
        assert cost(chain, ts.best_path(chain)) == best


SCHEMA = "row_id bigint, chain string, pos bigint, value string, zone string, plain_us bigint, cands string"


def resolve(spark, rows, conventions, **kw):
    out = ts.resolve(spark.createDataFrame(rows, SCHEMA), conventions, **kw).collect()
    return {r.row_id: (r.us, r.fmt) for r in out}


def ambiguous_rows(n, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        day = 1 + k % 12
        value = f"{day:02d}/{1 + k // 12 % 12:02d}/2025 1:{k % 60:02d}:00 AM" if rng.random() < 0.8 else f"2025-{1 + k // 12 % 12:02d}-{day:02d} 01:{k % 60:02d}:00"
        rows.append((k, "s", k, value, "UTC", None, "x"))
    return rows


def test_blocks_give_the_path_of_the_whole(spark):
    rows = ambiguous_rows(90)
    whole, cut = resolve(spark, rows, {}), resolve(spark, rows, {}, block=8)
    chain = [[{"us": u, "fmt": f, "cost": c} for u, f, c in ts.interpretations(r[3], "UTC", {})] for r in rows]
    pick = lambda got: [next(k for k, x in enumerate(c) if (x["us"], x["fmt"]) == got[i]) for i, c in enumerate(chain)]
    assert cost(chain, pick(cut)) == cost(chain, pick(whole)) == cost(chain, ts.best_path(chain))


def test_order_of_days_is_inferred_from_the_source(spark):
    rows = [(k, "d", k, f"{k:02d}/03/2025 10:00:00 AM", "UTC", None, "") for k in range(1, 29)]
    got = resolve(spark, rows, {})
    assert all(f == "dmy/" for _, f in got.values())
    assert resolve(spark, rows[:12], STATED)[5][1] == "mdy/"


def test_plain_null_and_repeated_rows(spark):
    rows = [
        (1, None, None, "2025-09-01T10:00:00.000Z", None, 1756720800000000, ""),
        (2, None, 2, None, "UTC", None, ""),
        (3, "a", 1, "nonsense", "UTC", None, ""),
        (4, "a", 1, "1756720800", None, None, ""),
        (5, "a", 1, "1756720800", None, None, ""),
        (6, "a", 2, "2025-09-01 10:00", "No/Where", None, ""),
    ]
    assert resolve(spark, rows, STATED) == {
        1: (1756720800000000, "plain"), 4: (1756720800000000, "epoch_s"), 5: (1756720800000000, "epoch_s")
    }
    assert resolve(spark, [], STATED) == {}


def test_readings_that_no_path_could_choose_are_left_out():
    rng = random.Random(11)
    for _ in range(60):
        chain = [[{"us": rng.randrange(50), "fmt": rng.choice("ab"), "cost": float(rng.choice([0, 1, 4, 6, 9]))} for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        kept = [[x for x in c if (x["us"], x["fmt"], x["cost"]) in ts.choosable([(y["us"], y["fmt"], y["cost"]) for y in c])] for c in chain]
        assert cost(chain, ts.best_path(chain)) == cost(kept, ts.best_path(kept))


def test_the_order_of_the_source_settles_units_and_the_path_matters(spark):
    """Numbers beside records of 1970 are milliseconds although their size implies seconds; without the path they are not."""
    rows = [(k, "s", k, str(10_000_000_000 + k * 1000) if k % 2 else None, None, None if k % 2 else 10_000_000_000_000 + k * 1_000_000, "") for k in range(21)]
    got = resolve(spark, rows, {})
    assert {f for k, (_, f) in got.items() if k % 2} == {"epoch_ms"} and got[3][0] == 10_000_003_000_000
    assert {f for k, (_, f) in resolve(spark, rows, STATED).items() if k % 2} == {"epoch_s"}


def test_lone_rows_and_copies(spark):
    """Rows without a source or place have no neighbours; copies of a record share what is chosen."""
    march = [(k, "d", k, f"{k:02d}/03/2025 10:00:00 AM", "UTC", None, "") for k in range(1, 29)]
    copies = [(100 + k, "d", 5, "05/03/2025 10:00:00 AM", "UTC", None, "") for k in range(50)]
    lone = [(200, None, 5, "05/03/2025 10:00:00 AM", "UTC", None, ""), (201, "d", None, "05/03/2025 10:00:00 AM", "UTC", None, "")]
    got = resolve(spark, march + copies + lone, {})
    assert {got[k] for k in range(100, 150)} == {got[5]} and got[5][1] == "dmy/"
    assert got[200] == got[201] == (1746266400000000, "mdy/")
