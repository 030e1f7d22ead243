"""Exactly one copy of messages that were delivered at least once.

An index of every identifier seen so far is kept as immutable runs in a named folder, with a manifest
that says which runs count; it can be opened again by a later session.  A run has one row per hash prefix
with parallel arrays sorted by identifier hash (two 64-bit halves, the rank and the row of the copy that is kept).
An incoming batch is first reduced to one row per identifier (with map-side combine, so that an identifier with a
third of all rows costs one row per map task), then binary-searched against the arrays of its prefixes;
identifiers found nowhere, and those of which a later copy came, become a new run, whose entries stand before
those of older runs.  Every ``merge_every`` runs are merged into one.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.shared import drop_path, materialise, names_in, new_path, read_text, write_text

RUN_SCHEMA = "prefix int, hi array<bigint>, lo array<bigint>, rank array<bigint>, kept array<bigint>"
ARRAYS = ("hi", "lo", "rank", "kept")
IDS_PER_ARRAY = 250_000
#: A batch with fewer prefixes than this reads only the rows of these from the runs.
FEW_PREFIXES = 256
#: The rank of a copy without a batch.
UNRANKED = -(2**62)


def prefix_of(hi: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hi, 64 - bits).cast("int")


def find_sorted(hi: np.ndarray, lo: np.ndarray, q_hi: np.ndarray, q_lo: np.ndarray) -> np.ndarray:
    """Where each (q_hi, q_lo) stands in the arrays sorted by (hi, lo); -1 if it does not."""
    left, right = np.searchsorted(hi, q_hi, "left"), np.searchsorted(hi, q_hi, "right")
    where = np.full(len(q_hi), -1, dtype=np.int64)
    one = np.flatnonzero(right - left == 1)
    hit = one[lo[left[one]] == q_lo[one]]
    where[hit] = left[hit]
    for k in np.flatnonzero(right - left > 1):
        at = left[k] + np.searchsorted(lo[left[k] : right[k]], q_lo[k])
        if at < right[k] and lo[at] == q_lo[k]:
            where[k] = at
    return where


def _row(prefix: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"prefix": [prefix], **{c: [columns[c]] for c in ARRAYS}})


def _best(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted by identifier, of several entries of one that with the largest (rank, kept)."""
    order = np.lexsort((columns["kept"], columns["rank"], columns["lo"], columns["hi"]))
    columns = {c: columns[c][order] for c in ARRAYS}
    last = np.ones(len(order), dtype=bool)
    last[:-1] = (columns["hi"][1:] != columns["hi"][:-1]) | (columns["lo"][1:] != columns["lo"][:-1])
    return {c: columns[c][last] for c in ARRAYS}


class DeliveryIndex:
    """Persisted index of delivered identifiers: sorted arrays by hash prefix in the folder ``path``.

    Opening a folder that has an index goes on with it.  There is one writer at a time: a second one that commits
    from the same state gets an error and has changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected_ids: int = 0, merge_every: int = 4):
        self.spark, self.merge_every = spark, merge_every
        self.path = path or new_path(spark, "delivery-index")
        versions = [int(n[9:-5]) for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        self.version = max(versions, default=0)
        if self.version:
            held = json.loads(read_text(spark, self._manifest(self.version)))
            self.bits, self.runs, self.ids = held["bits"], held["runs"], held["ids"]
        else:
            self.bits, self.runs, self.ids = self._bits_for(expected_ids), [], 0

    @staticmethod
    def _bits_for(ids: int) -> int:
        return max(4, math.ceil(math.log2(max(1.0, ids / IDS_PER_ARRAY))))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def _commit(self, runs: list[str], ids: int, bits: int) -> None:
        """The next manifest; runs that it leaves out go afterwards, with the manifest before the last."""
        write_text(self.spark, self._manifest(self.version + 1), json.dumps({"bits": bits, "runs": runs, "ids": ids}))
        gone = [r for r in self.runs if r not in runs]
        self.version, self.runs, self.ids, self.bits = self.version + 1, runs, ids, bits
        for run in gone:
            drop_path(self.spark, f"{self.path}/{run}")
        drop_path(self.spark, self._manifest(self.version - 2))

    def _write(self, df: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def read(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.path}/{r}" for r in self.runs])

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (hi, lo, rank, row_id); of several copies that with the largest (rank, row_id) is kept.

        Batches may come in any order: an entry is replaced if a later copy comes, and stays if an earlier one does.
        """
        local = batch.groupBy("hi", "lo").agg(F.max(F.struct("rank", "row_id")).alias("best"))
        local = local.select(
            prefix_of(F.col("hi"), self.bits).alias("prefix"), "hi", "lo", F.col("best.rank").alias("rank"), F.col("best.row_id").alias("kept")
        )
        if self.runs:
            old = self.read()
            local = materialise(local, "delivery-batch")
            few = [r.prefix for r in local.select("prefix").distinct().limit(FEW_PREFIXES + 1).collect()]
            if len(few) <= FEW_PREFIXES < 2**self.bits:
                old = old.where(F.col("prefix").isin(few))
            fresh = local.groupBy("prefix").cogroup(old.groupBy("prefix")).applyInPandas(_probe, RUN_SCHEMA)
        else:
            fresh = local.groupBy("prefix").applyInPandas(_first_run, RUN_SCHEMA)
        run = self._write(fresh)
        n = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{run}").agg(F.coalesce(F.sum(F.size("hi")), F.lit(0))).first()[0]
        self._commit([*self.runs, run], self.ids + n, self.bits)
        if len(self.runs) >= self.merge_every or self._bits_for(self.ids) > self.bits:
            self.merge()

    def merge(self) -> None:
        """Merge all runs into one, with longer prefixes if the arrays have grown; the old runs are dropped afterwards."""
        bits = max(self.bits, self._bits_for(self.ids))
        if len(self.runs) < 2 and bits == self.bits:
            return
        run = self._write(self.read().groupBy("prefix").applyInPandas(_merge(bits), RUN_SCHEMA))
        n = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{run}").agg(F.coalesce(F.sum(F.size("hi")), F.lit(0))).first()[0]
        self._commit([run], n, bits)

    def kept(self) -> DataFrame:
        """The row that is kept of each identifier."""
        rows = self.read()
        if len(self.runs) > 1:
            rows = rows.groupBy("prefix").applyInPandas(_merge(self.bits), RUN_SCHEMA)
        return rows.select(F.explode("kept").alias("row_id"))


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in ARRAYS}


def _first_run(pdf: pd.DataFrame) -> pd.DataFrame:
    return _row(int(pdf.prefix.iloc[0]), _best(_columns(pdf)))


def _probe(local: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    if local.empty:
        return _row(0, {c: np.array([], dtype="int64") for c in ARRAYS}).iloc[:0]
    own = _best(_columns(local))
    fresh = np.ones(len(own["hi"]), dtype=bool)
    for run in zip(*[runs[c] for c in ARRAYS]):
        hi, lo, rank, kept = map(np.asarray, run)
        where = find_sorted(hi, lo, own["hi"], own["lo"])
        known = np.flatnonzero(where >= 0)
        at = where[known]
        later = (own["rank"][known] > rank[at]) | ((own["rank"][known] == rank[at]) & (own["kept"][known] > kept[at]))
        fresh[known] &= later
    return _row(int(local.prefix.iloc[0]), {c: own[c][fresh] for c in ARRAYS})


def _merge(bits: int):
    def run(runs: pd.DataFrame) -> pd.DataFrame:
        own = _best({c: np.concatenate([np.asarray(x, dtype="int64") for x in runs[c]]) for c in ARRAYS})
        prefix = (own["hi"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        parts = [(int(p), prefix == p) for p in np.unique(prefix)]
        return pd.concat([_row(p, {c: own[c][at] for c in ARRAYS}) for p, at in parts]) if parts else _row(0, own).iloc[:0]

    return run


def identified(rows: DataFrame, key: Iterable[Column], batch: Column, row_id: Column) -> DataFrame:
    """(hi, lo, rank, row_id) of the rows that have an identifier, the last of the ``key`` columns."""
    *scope, ident = list(key)
    ident = F.lower(F.regexp_replace(ident, r"^\s+|\s+$", ""))
    scope = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in scope]
    ids = rows.select(
        *[c.alias(f"s{k}") for k, c in enumerate(scope)],
        ident.alias("ident"),
        F.coalesce(batch.cast("bigint"), F.lit(UNRANKED)).alias("rank"),
        row_id.cast("bigint").alias("row_id"),
    )
    parts = [F.col(f"s{k}") for k in range(len(scope))]
    return ids.where(F.length("ident") > 0).select(
        F.xxhash64(*parts, "ident").alias("hi"), F.xxhash64(F.lit("low half"), "ident", *parts).alias("lo"), "rank", "row_id"
    )


def surplus_copies(
    rows: DataFrame, key: Iterable[Column], batch: Column, row_id: Column, ingest_batches: int = 4, merge_every: int = 3, index_path: str | None = None
) -> DataFrame:
    """Rows (``row_id``) that are surplus copies.

    Rows are copies if all ``key`` columns are equal; the last key column is the identifier.
    Rows without an identifier (null or blank) are never copies.  Of copies the one with the
    largest (``batch``, ``row_id``) is kept, also where copies tie in ``batch``; a null batch
    counts as the oldest.  ``row_id`` must be unique and not null.  No rows in, no rows out.
    Other columns are not read, whatever their names.  The rows go into the index in the order of their batches,
    in about ``ingest_batches`` even parts, those without a batch first; with ``index_path`` the index
    that earlier calls left there is gone on with, and rows are surplus also to what it holds.
    """
    spark = rows.sparkSession
    ids = materialise(identified(rows, key, batch, row_id), "delivery-ids")
    dated = F.col("rank") > UNRANKED
    quantiles = [k / ingest_batches for k in range(1, ingest_batches)] or [0.5]
    n, undated, cuts = ids.agg(
        F.count("*"), F.count(F.when(~dated, 1)), F.percentile_approx(F.when(dated, F.col("rank")), F.lit(quantiles))
    ).first()
    if not n:
        return ids.select("row_id")
    index = DeliveryIndex(spark, index_path, n, merge_every)
    if undated:
        index.add(ids.where(~dated))
    bounds = sorted(set(cuts or [])) if ingest_batches > 1 else []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = ids.where(dated)
        part = part.where(F.col("rank") > low) if low is not None else part
        index.add(part.where(F.col("rank") <= high) if high is not None else part)
    index.merge()
    return ids.select("row_id").join(index.kept(), "row_id", "left_anti")
