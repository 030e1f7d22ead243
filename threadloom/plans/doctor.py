"""Health checks of the tables: each gives (name, ok, detail) as one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import Dataset

CHECK = "name string, ok boolean, n bigint"


def _row(df: DataFrame, name: str, n: Column, ok: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), ok.alias("ok"), n.cast("bigint").alias("n"))


def orphan_sessions(data: Dataset) -> DataFrame:
    lone = data.sessions.join(
        data.messages.select(F.col("session_uuid").alias("uuid")), "uuid", "left_anti"
    ).agg(F.count("*").alias("n"))
    return _row(lone, "orphan sessions", F.col("n"), F.col("n") == 0)


def usage_coverage(data: Dataset) -> DataFrame:
    used = data.session_usage.agg(F.countDistinct("session_uuid").alias("used"))
    both = used.withColumn("total", data.sessions.agg(F.count("*")).scalar())
    return _row(both, "usage coverage", F.col("used"), (F.col("total") == 0) | (F.col("used") > 0))


def stale_usage(data: Dataset) -> DataFrame:
    n = data.ingest_state.agg(F.coalesce(F.sum((F.col("usage_stale") != 0).cast("bigint")), F.lit(0)).alias("n"))
    return _row(n, "usage diagnostics", F.col("n"), F.col("n") == 0)


def unparsed_lines(landed: DataFrame) -> DataFrame:
    n = landed.agg(F.count(F.when(F.expr("try_parse_json(raw_line) is null"), 1)).alias("n"))
    return _row(n, "unparsed lines", F.col("n"), F.col("n") == 0)


def repeated_messages(data: Dataset) -> DataFrame:
    n = data.messages.groupBy("session_uuid", "seq").agg(F.count("*").alias("k")).agg(
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n")
    )
    return _row(n, "repeated messages", F.col("n"), F.col("n") == 0)


def reconcile(listing: DataFrame, state: DataFrame, roots: list[str]) -> DataFrame:
    """Files as missing, preserved (their root is not there), truncated, rewritten, lagging or current: (status, n)."""
    rows = state.select(
        "source_file", "last_size", "last_byte_offset", F.col("tail_fingerprint").alias("old_tail")
    ).join(listing, "source_file", "left")
    inside = reduce(Column.__or__, [F.col("source_file").startswith(r.rstrip("/") + "/") for r in roots], F.lit(False))
    changed = F.col("tail_fingerprint") != F.col("old_tail") if "tail_fingerprint" in listing.columns else F.lit(False)
    status = F.when(~inside, "preserved").when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("last_byte_offset"), "truncated").when(
        (F.col("size") == F.col("last_size")) & changed, "rewritten"
    ).when(F.col("size") > F.col("last_byte_offset"), "lagging").otherwise("current")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def coverage_by_source(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(source, on_disk, tracked, ok) per format, so that none hides a gap in another."""
    from threadloom.sources.files import source_of

    disk = listing.select("source_file").withColumn("tracked", F.lit(0)).unionByName(
        state.select("source_file").withColumn("tracked", F.lit(1))
    )
    per = disk.groupBy(source_of(F.col("source_file")).alias("source")).agg(
        F.countDistinct(F.when(F.col("tracked") == 0, F.col("source_file"))).alias("on_disk"),
        F.countDistinct(F.when(F.col("tracked") == 1, F.col("source_file"))).alias("tracked"),
    )
    return per.withColumn("ok", F.col("tracked") >= F.col("on_disk"))


def conflicts(source_conflicts: DataFrame) -> DataFrame:
    n = source_conflicts.agg(F.count("*").alias("n"))
    return _row(n, "source conflicts", F.col("n"), F.col("n") == 0)


def size_ratio(index_bytes: int, source_bytes: int) -> tuple[bool, float]:
    ratio = index_bytes / source_bytes if source_bytes else 0.0
    return ratio < 3.0, ratio


def checks(data: Dataset) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [orphan_sessions(data), usage_coverage(data), stale_usage(data), repeated_messages(data)]
    )


def state_checks(state: DataFrame) -> DataFrame:
    """What the passes have counted: unparsed lines, usage that lacks, counters of unknown names (these alone are fine)."""
    sums = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unparsed_lines", "usage_skipped", "usage_unmapped")])
    named = (("unparsed lines", "unparsed_lines", False), ("usage skipped", "usage_skipped", False), ("usage unmapped", "usage_unmapped", True))
    return reduce(DataFrame.unionByName, [_row(sums, n, F.col(c), F.lit(True) if fine else F.col(c) == 0) for n, c, fine in named])


def file_checks(listing: DataFrame, state: DataFrame, roots: list[str]) -> DataFrame:
    """Files on disk against the state: (name, ok, n) of each status and of the coverage of each format."""
    status = reconcile(listing, state, roots).select(F.concat(F.lit("files "), "status").alias("name"), F.col("status").isin("current", "preserved").alias("ok"), "n")
    cover = coverage_by_source(listing, state).select(F.concat(F.lit("coverage of "), "source").alias("name"), "ok", (F.col("on_disk") - F.col("tracked")).alias("n"))
    return status.unionByName(cover)
