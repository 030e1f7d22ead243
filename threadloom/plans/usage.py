"""Token usage per session, project, model and source; rate-limit snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.catalog import Dataset
from threadloom.functions import expr

TOKENS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "reasoning", "tool", "total_tokens")


def _scope(data: Dataset, since: int = 0, project: str = "", source: str = "", model: str = "") -> DataFrame:
    """Usage rows with their session; no source means every source here.  The model is filtered before any sum."""
    s = data.sessions.select(
        "uuid",
        F.coalesce("source", F.lit(schema.DEFAULT_SOURCE)).alias("source"),
        "project_path",
        "title",
        "agent_type",
        "source_file",
        "started_at",
        "ended_at",
    )
    if since > 0:
        s = s.where(F.coalesce("ended_at", "started_at", F.lit(0)) >= since)
    if project:
        s = s.where(expr.starts_with(F.col("project_path"), project))
    if source not in ("", schema.ALL_SOURCES):
        s = s.where(F.col("source") == source)
    u = data.session_usage.drop("source", "categories_json")
    if model:
        u = u.where(F.col("model") == model)
    state = data.ingest_state.select("source_file", (F.coalesce("usage_stale", F.lit(0)) != 0).alias("stale"))
    rows = u.join(s, u.session_uuid == s.uuid).join(state, "source_file", "left")
    return rows.withColumn("stale", F.coalesce("stale", F.lit(False)))


def _top(rows: DataFrame, key: str, limit: int) -> DataFrame:
    rank = Window.partitionBy("source").orderBy(F.desc("total_tokens"), key)
    return rows.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= (limit if limit > 0 else 20)).drop("rn")


def by_session(data: Dataset, since: int = 0, project: str = "", source: str = "", model: str = "", limit: int = 20) -> DataFrame:
    """The sessions with most tokens, at most ``limit`` of each source."""
    own = [
        "session_uuid",
        "source",
        F.coalesce("project_path", F.lit("")).alias("project_path"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("agent_type", F.lit("")).alias("agent_type"),
        "stale",
    ]
    sums = [F.sum(c).cast("bigint").alias(c) for c in TOKENS]
    rows = _scope(data, since, project, source, model).groupBy(*own).agg(
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), *sums
    )
    return _top(rows, "session_uuid", limit)


def _counts() -> list[Column]:
    return [
        F.countDistinct("session_uuid").alias("sessions"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
        F.countDistinct(F.when(F.col("stale"), F.col("session_uuid"))).alias("stale_sessions"),
    ]


def grouped(data: Dataset, by: str, since: int = 0, project: str = "", source: str = "", limit: int = 20) -> DataFrame:
    """Tokens by project or model within each source, at most ``limit`` of each source."""
    if by not in ("project", "model"):
        raise ValueError(f"no such grouping: {by}")
    key = F.coalesce("project_path", F.lit("")) if by == "project" else F.col("model")
    rows = _scope(data, since, project, source).groupBy("source", key.alias("key")).agg(*_counts())
    return _top(rows, "key", limit)


def source_totals(data: Dataset, since: int = 0, project: str = "", source: str = "", model: str = "") -> DataFrame:
    """Totals of each source over all its sessions; sources are never added up."""
    return _scope(data, since, project, source, model).groupBy("source").agg(*_counts())


def session_totals(data: Dataset, uuids: DataFrame) -> DataFrame:
    """Total tokens of the sessions in ``uuids`` (column uuid); sessions without usage have no row."""
    rows = _scope(data).join(
        uuids.select(F.col("uuid").alias("wanted")).distinct(), F.col("session_uuid") == F.col("wanted"), "left_semi"
    )
    return rows.groupBy("session_uuid", "stale").agg(F.sum("total_tokens").cast("bigint").alias("total_tokens"))


def with_quota_age(quota: DataFrame, as_of: int) -> DataFrame:
    """Snapshots with whether they are older than their own window or that has been reset since."""
    old = (F.col("window_minutes") > 0) & (F.lit(as_of) - F.col("observed_at") > F.col("window_minutes") * 60)
    reset = (F.col("resets_at") > 0) & (F.col("resets_at") < as_of)
    return quota.withColumn("stale", F.coalesce(old, F.lit(False)) | F.coalesce(reset, F.lit(False)))
