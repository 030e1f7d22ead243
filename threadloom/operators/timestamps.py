"""Mixed timestamp formats and zones normalised to one UTC instant per row.

Every value gets the array of all its valid interpretations (format, instant, cost).  Where
a source has values with more than one, a Viterbi path over the source's record order picks
among them: format switches and backward jumps in time cost, readings that are unlikely by
themselves (a number in another unit than its size implies) cost a little, readings against a
stated convention more than any path can win back.  Readings that cost more than the cheapest one
by what a path can win at most are left out of it: no path could choose them.  A source without
a value that is then ambiguous has a single path and is not moved.  A row whose chosen reading is
against a stated convention has no time.

Sources are cut into blocks of ``BLOCK`` records.  Where a source has several blocks, each
block is first reduced to the least costs from every interpretation of its first record to
every one of its last ((min,+) matrix), the blocks of a source are chained over these few
numbers, and the blocks are then traced back independently.  No source is held in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.shared import materialise

PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
BLOCK = 4096
#: Costs of the path; AGAINST exceeds what a whole block's path can win.
SWITCH, BACKWARD, AGAINST = 1.0, 1.5, 1e7
#: Cost of a unit for each step from the one that the size of a number implies, and what choosing one reading instead of another can win at most: two steps of the path.
UNIT = 1.25
MOST_WON = 2 * (SWITCH + BACKWARD)
#: Units of numbers with the digits that they add to those of whole seconds.
UNITS = (("s", 0), ("ms", 3), ("us", 6), ("ns", 9))
#: End of the time that numbers may mean: the year 10000.
LATEST = 253_402_300_800_000_000
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

_ISO = re.compile(
    r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*"
    r"(Z|z|UTC|GMT|utc|gmt|[+-]\d{2}(?::?\d{2})?)?\s*(?:\[([A-Za-z_/+-]+)\])?"
)
_BASIC = re.compile(r"(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|z|[+-]\d{2}:?\d{2})?")
_DAYS = re.compile(r"(\d{1,2})([./])(\d{1,2})\2(\d{4}),?(?:\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*([AaPp][Mm])?")
_MAIL = re.compile(
    r"(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})?",
)
_CLOCK = re.compile(
    r"[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{4})\s+(\d{2}):(\d{2}):(\d{2})\s*(?:GMT|UTC)?([+-]\d{4})?(?:\s*\(.*\))?"
)
_NUMBER = re.compile(r"\d+(?:\.\d+)?")

CANDIDATES = T.ArrayType(
    T.StructType([T.StructField("us", T.LongType()), T.StructField("fmt", T.StringType()), T.StructField("cost", T.DoubleType())])
)

SUMMARY = T.StructType(
    [
        T.StructField("chain", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("first", CANDIDATES),
        T.StructField("last", CANDIDATES),
        T.StructField("costs", T.ArrayType(T.DoubleType())),
    ],
)


def micros(digits: str | None) -> int:
    """Fraction digits as microseconds; finer digits are cut off."""
    return int((digits or "0")[:6].ljust(6, "0"))


def _offset(text: str) -> int | None:
    if text.upper() in ("Z", "UTC", "GMT"):
        return 0
    digits = text[1:].replace(":", "").ljust(4, "0")
    seconds = int(digits[:2]) * 3600 + int(digits[2:]) * 60
    return -seconds if text[0] == "-" else seconds


def _instants(parts: tuple[int, ...], us: int, offset: str | None, zone: str | None) -> list[tuple[int, bool]]:
    """(instant, is the later of two) for each reading of a wall clock time; none if there is no such date."""
    try:
        wall = datetime(*parts, microsecond=us)
    except ValueError:
        return []
    if offset is not None:
        return [
            (round((wall.replace(tzinfo=timezone.utc) - EPOCH) / timedelta(microseconds=1)) - _offset(offset) * 1_000_000, False)
        ]
    if zone is None:
        return []
    tz = _zone(zone)
    if tz is None:
        return []
    got = []
    for fold in (0, 1):
        shift = wall.replace(tzinfo=tz, fold=fold).utcoffset()
        got.append((wall.replace(tzinfo=timezone.utc) - EPOCH - shift) // timedelta(microseconds=1))
    return [(got[0], False)] + [(got[1], True)] * (got[1] > got[0])


_ZONES: dict[str, ZoneInfo | None] = {}


def _zone(name: str) -> ZoneInfo | None:
    if name not in _ZONES:
        try:
            _ZONES[name] = ZoneInfo(name)
        except Exception:
            _ZONES[name] = None
    return _ZONES[name]


def interpretations(value: str | None, zone: str | None, conventions: dict[str, str]) -> list[tuple[int, str, float]]:
    """All valid readings (microseconds since 1970 UTC, format, cost) of ``value``; none if it is no time.

    ``conventions``: ``slash`` and ``dot`` ("mdy" or "dmy"), ``overlap`` ("earlier" or "later") and ``unit``
    ("size") state how such values are meant; without an entry the readings cost the same (units: nearly).  A time that
    the clock skipped is read with the offset before the jump.
    """
    s = (value or "").strip()
    out: list[tuple[int, str, float]] = []

    def add(parts: tuple[int, ...], us: int, offset: str | None, zone: str | None, fmt: str, cost: float = 0.0) -> None:
        for instant, later in _instants(parts, us, offset, zone):
            wrong = "overlap" in conventions and (conventions["overlap"] == "later") != later and len(_instants(parts, us, offset, zone)) > 1
            out.append((instant, fmt, cost + AGAINST * wrong))

    if not s:
        return out
    if _NUMBER.fullmatch(s):
        whole, _, frac = s.partition(".")
        if int(whole) == 0:
            return out
        # up to 11 digits imply seconds, each three more the next unit
        implied = max(0, min(3, (len(whole.lstrip("0")) - 9) // 3))
        for k, (unit, digits) in enumerate(UNITS):
            us = int(whole) * 10 ** (6 - digits) + int(frac[: 6 - digits].ljust(6 - digits, "0") or 0) if digits <= 6 else int(whole) // 1000
            if 0 < us < LATEST:
                out.append((us, f"epoch_{unit}", (AGAINST if "unit" in conventions else UNIT * abs(k - implied)) if k != implied else 0.0))
        return out
    if m := _ISO.fullmatch(s):
        y, mo, d, h, mi, sec, frac, off, name = m.groups()
        if int(y):
            add(
                (int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(sec or 0)),
                micros(frac),
                off,
                name or zone,
                "iso" + "_zoned" * (off is not None),
            )
    elif m := _BASIC.fullmatch(s):
        *p, frac, off = m.groups()
        if int(p[0]):
            add(tuple(map(int, p)), micros(frac), off, zone, "basic")
    elif m := _DAYS.fullmatch(s):
        a, mark, b, y, h, mi, sec, frac, half = m.groups()
        hour = int(h or 0)
        if half:
            if not 1 <= hour <= 12:
                return out
            hour = hour % 12 + 12 * (half.lower() == "pm")
        if int(y):
            meant = conventions.get("slash" if mark == "/" else "dot")
            for order, (mo, d) in (("mdy", (int(a), int(b))), ("dmy", (int(b), int(a)))):
                add(
                    (int(y), mo, d, hour, int(mi or 0), int(sec or 0)),
                    micros(frac),
                    None,
                    zone,
                    order + mark,
                    AGAINST * (meant is not None and meant != order),
                )
    elif m := _MAIL.fullmatch(s):
        d, name, y, h, mi, sec, off = m.groups()
        if name.lower() in MONTHS and int(y):
            add((int(y), MONTHS[name.lower()], int(d), int(h), int(mi), int(sec or 0)), 0, off, zone, "mail")
    elif m := _CLOCK.fullmatch(s):
        name, d, y, h, mi, sec, off = m.groups()
        if name.lower() in MONTHS and int(y):
            add((int(y), MONTHS[name.lower()], int(d), int(h), int(mi), int(sec)), 0, off, zone, "clock")
    return out


def choosable(readings: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """The readings that some path could choose."""
    least = min((cost for *_, cost in readings), default=0.0)
    return [r for r in readings if r[2] <= least + MOST_WON]


def _reader(conventions: dict[str, str]):
    @F.pandas_udf(CANDIDATES)
    def read(value: pd.Series, zone: pd.Series) -> pd.Series:
        return pd.Series([choosable(interpretations(v, z, conventions)) for v, z in zip(value, zone)])

    return read


def _step(us_a: np.ndarray, fmt_a: list[str], us_b: np.ndarray, fmt_b: list[str]) -> np.ndarray:
    return SWITCH * np.array([[x != y for y in fmt_b] for x in fmt_a]) + BACKWARD * (us_a[:, None] > us_b[None, :])


def _forward(cands: list[list[dict]], start: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Least costs to each reading of the last record from ``start`` (costs of those of the first), and the way back.

    Records have a few readings, most have one: plain loops are faster than arrays here.
    """
    cost, back = [float(c) for c in start], []
    before = [(x["us"], x["fmt"]) for x in cands[0]]
    for record in cands[1:]:
        after, total, pointers = [], [], []
        for x in record:
            us, fmt = x["us"], x["fmt"]
            best, at = np.inf, 0
            for k, (u, f) in enumerate(before):
                c = cost[k] + (SWITCH if f != fmt else 0.0) + (BACKWARD if u > us else 0.0)
                if c < best:
                    best, at = c, k
            after.append((us, fmt))
            total.append(best + x["cost"])
            pointers.append(at)
        back.append(pointers)
        cost, before = total, after
    return np.array(cost), back


def best_path(cands: list[list[dict]], first: int | None = None, last: int | None = None) -> list[int]:
    """The index of the reading chosen for each record; of equally good paths that with earlier readings."""
    start = np.array([x["cost"] for x in cands[0]])
    if first is not None:
        start = np.where(np.arange(len(start)) == first, start, np.inf)
    cost, back = _forward(cands, start)
    at = [int(cost.argmin()) if last is None else last]
    for pointers in reversed(back):
        at.append(pointers[at[-1]])
    return at[::-1]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a sorted stream, whole even where a batch ends within one."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        change[0] = not held or tuple(held[-1][keys].iloc[-1]) != tuple(pdf[keys].iloc[0])
        cuts = np.flatnonzero(change)
        if len(cuts) == 0:
            held.append(pdf)
            continue
        if cuts[0] > 0:
            held.append(pdf.iloc[: cuts[0]])
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]
        for a, b in zip(cuts, cuts[1:]):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[cuts[-1] :]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _runs(batches, ["chain", "block"]):
        cands = list(pdf.cands)
        rows = []
        for i in range(len(cands[0])):
            start = np.full(len(cands[0]), np.inf)
            start[i] = 0.0
            rows.append(_forward(cands, start)[0])
        yield pd.DataFrame(
            {
                "chain": [pdf.chain.iloc[0]],
                "block": [pdf.block.iloc[0]],
                "first": [cands[0]],
                "last": [cands[-1]],
                "costs": [np.concatenate(rows)],
            },
        )


def _join_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain the blocks of one source: which reading each block starts and ends with."""
    for pdf in _runs(batches, ["chain"]):
        firsts, lasts = list(pdf["first"]), list(pdf["last"])
        mats = [np.asarray(c, dtype=float).reshape(len(a), len(b)) for c, a, b in zip(pdf.costs, firsts, lasts)]
        cost = np.array([x["cost"] for x in firsts[0]])
        back = []
        for k, mat in enumerate(mats):
            if k:
                a, b = lasts[k - 1], firsts[k]
                step = _step(
                    np.array([x["us"] for x in a]), [x["fmt"] for x in a], np.array([x["us"] for x in b]), [x["fmt"] for x in b]
                )
                total = cost[:, None] + step + np.array([x["cost"] for x in b])[None, :]
                back.append(total.argmin(axis=0))
                cost = total.min(axis=0)
            total = cost[:, None] + mat
            back.append(total.argmin(axis=0))
            cost = total.min(axis=0)
        state, ends = int(cost.argmin()), []
        for k in range(len(mats) - 1, -1, -1):
            last = state
            first = int(back[2 * k][last])
            ends.append((first, last))
            if k:
                state = int(back[2 * k - 1][first])
        ends.reverse()
        yield pd.DataFrame(
            {
                "chain": pdf.chain.to_numpy(),
                "block": pdf.block.to_numpy(),
                "start": [a for a, _ in ends],
                "end": [b for _, b in ends],
            },
        )


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _runs(batches, ["chain", "block"]):
        start, end = pdf.start.iloc[0], pdf.end.iloc[0]
        path = best_path(list(pdf.cands), None if pd.isna(start) else int(start), None if pd.isna(end) else int(end))
        chosen = [(key, c[k]["us"], c[k]["fmt"], c[k]["cost"]) for key, c, k in zip(pdf.key, pdf.cands, path) if len(c) > 1]
        yield pd.DataFrame(chosen, columns=["key", "us", "fmt", "cost"])


def resolve(rows: DataFrame, conventions: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """One UTC instant per readable row.

    ``rows``: ``row_id`` (unique), ``chain`` (the source, any type), ``pos`` (place in the source's
    order), ``value`` (string, numbers as text), ``zone`` (IANA name or null) and ``plain_us``
    (the instant of a value in the plain form, else null); other columns are ignored.  Returns
    ``row_id, us, fmt, plain``.  Null, empty and unreadable values give no row; a wall clock time
    without a known zone neither.  Rows with equal ``pos`` and equal readings (copies of a record) count
    once in the path and share what is chosen; different ones are taken by ``row_id``.  A row with a null
    chain or ``pos`` has no neighbours: its cheapest reading counts, of several the earliest.
    """
    lone = F.col("chain").isNull() | F.col("pos").isNull()
    base = rows.select(
        "row_id",
        F.when(lone, F.concat(F.lit("\u0000"), F.col("row_id").cast("string"))).otherwise(F.col("chain").cast("string")).alias("chain"),
        F.coalesce(F.col("pos"), F.lit(0)).cast("bigint").alias("pos"),
        "value",
        "zone",
        "plain_us",
    )
    plain = base.where("plain_us is not null").select(
        "row_id", "chain", "pos", F.col("plain_us").alias("us"), F.lit("plain").alias("fmt")
    )
    other = base.where("plain_us is null and length(trim(value)) > 0")
    other = other.withColumn(
        "cands", _reader(conventions or {})("value", "zone")
    ).select("row_id", "chain", "pos", "cands").where("size(cands) > 0")
    other = materialise(other, "readings")
    single = other.where("size(cands) = 1").where(F.col("cands")[0]["cost"] < AGAINST).select(
        "row_id", "chain", "pos", F.col("cands")[0]["us"].alias("us"), F.col("cands")[0]["fmt"].alias("fmt")
    )
    known = plain.withColumn("plain", F.lit(True)).unionByName(
        single.withColumn("plain", F.lit(False))
    ).select("row_id", "us", "fmt", "plain")
    several = F.size("cands") > 1
    unclear = other.where(several).select("chain").distinct()
    if unclear.isEmpty():
        return known
    # copies are told apart by a key of place and readings, and join what was chosen for it
    key = F.struct("chain", "pos", F.xxhash64(F.to_json("cands")).alias("readings"))
    keyed = other.withColumn("key", key)
    one = plain.select("row_id", "chain", "pos", F.array(F.struct("us", "fmt", F.lit(0.0).alias("cost"))).alias("cands"))
    chained = one.withColumn("key", key).unionByName(keyed).join(unclear, "chain", "left_semi").groupBy("key").agg(
        F.first("cands").alias("cands"), F.min("row_id").alias("row_id")
    )
    chained = chained.select("key", "key.chain", "key.pos", "row_id", "cands").withColumn("block", F.floor(F.col("pos") / block))
    chained = materialise(chained, "chains")
    longer = chained.groupBy("chain").agg((F.max("block") > F.min("block")).alias("longer")).where("longer").select("chain")
    if longer.isEmpty():
        ends = None
    else:
        summed = _sorted(chained.join(longer, "chain", "left_semi")).mapInPandas(_summaries, SUMMARY)
        ends = summed.repartition("chain").sortWithinPartitions("chain", "block").mapInPandas(
            _join_blocks, "chain string, block long, start int, end int"
        )
    chained = chained.join(ends, ["chain", "block"], "left") if ends is not None else chained.withColumns(
        {"start": F.lit(None).cast("int"), "end": F.lit(None).cast("int")}
    )
    decided = _sorted(chained).withColumn("key", F.to_json("key")).mapInPandas(_decide, "key string, us bigint, fmt string, cost double")
    rows = keyed.where(several).select("row_id", F.to_json("key").alias("key")).join(decided.where(F.col("cost") < AGAINST), "key")
    return known.unionByName(rows.select("row_id", "us", "fmt", F.lit(False).alias("plain")))


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("chain", "block").sortWithinPartitions("chain", "block", "pos", "row_id")
