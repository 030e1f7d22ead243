"""Listing, reading and summarising sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.catalog import Dataset
from threadloom.functions import expr


@dataclass(frozen=True)
class SessionFilter:
    since: int = 0
    project: str = ""
    min_turns: int = 0
    touched: str = ""
    tool: str = ""
    ran: str = ""
    target: tuple[str, str] | None = None
    parent: str = ""
    include_subagents: bool = False
    source: str = ""
    limit: int = 50


def acted_sessions(
    targets: DataFrame, touched: str = "", tool: str = "", ran: str = "", exact: tuple[str, str] | None = None
) -> list[DataFrame]:
    """For each given condition the sessions with a fact that meets it."""
    kind, value = F.col("kind"), F.col("value")
    wanted: list[Column] = []
    if touched:
        wanted.append((kind == "file") & expr.starts_with(value, touched))
    if tool:
        wanted.append((kind == "tool") & (value == tool))
    if ran:
        wanted.append((kind == "command") & expr.contains_short(value, ran))
    if exact and all(exact):
        wanted.append((kind == exact[0]) & (value == exact[1]))
    return [targets.where(w).select(F.col("session_uuid").alias("acted")).distinct() for w in wanted]


def _filtered(data: Dataset, f: SessionFilter) -> DataFrame:
    rows = data.sessions.where(expr.of_source(F.col("source"), f.source))
    if f.since > 0:
        rows = rows.where(F.col("ended_at") >= f.since)
    if f.project:
        rows = rows.where(expr.starts_with(F.col("project_path"), f.project))
    if f.min_turns > 0:
        rows = rows.where(F.col("turn_count") >= f.min_turns)
    for acted in acted_sessions(data.tool_targets, f.touched, f.tool, f.ran, f.target):
        rows = rows.join(acted, rows.uuid == acted.acted, "left_semi")
    return rows


def _page(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("ended_at"), F.desc("uuid")).limit(limit)


def list_sessions(data: Dataset, f: SessionFilter = SessionFilter()) -> DataFrame:
    """The most recent sessions.  A child is left out where its parent is on the same page."""
    limit = f.limit if f.limit > 0 else 50
    rows = _filtered(data, f)
    if f.parent:
        rows = rows.where(F.col("parent_session") == f.parent)
    elif not f.include_subagents:
        page = _page(rows, limit).select(F.col("uuid").alias("shown"))  # at most ``limit`` uuids
        rows = rows.join(F.broadcast(page), rows.parent_session == page.shown, "left_anti")
    rows = _page(rows, limit)
    children = data.sessions.where("parent_session <> ''").groupBy(F.col("parent_session").alias("of")).agg(F.count("*").alias("subagents"))
    children = children.join(F.broadcast(rows.select("uuid")), F.col("of") == F.col("uuid"), "left_semi")
    out = rows.join(F.broadcast(children), F.col("uuid") == F.col("of"), "left")
    return out.select(
        "uuid", _or_empty("project_path"), _or_empty("title"), _or_zero("started_at"), _or_zero("ended_at"), "turn_count", _or_empty("parent_session"), _or_empty("agent_type"),
        F.coalesce("source", F.lit(schema.DEFAULT_SOURCE)).alias("source"), F.coalesce("subagents", F.lit(0)).cast("bigint").alias("subagents")
    )


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def resolve(data: Dataset, prefix: str, source: str = "") -> DataFrame:
    """At most two sessions: an exact uuid of any source alone, else those of the source that start so.

    One row is the answer, none means not found, two mean that the prefix is ambiguous.
    """
    exact = data.sessions.where(F.col("uuid") == prefix).limit(1)
    alike = data.sessions.where(
        expr.starts_with(F.col("uuid"), prefix) & expr.of_source(F.col("source"), source)
    ).orderBy("uuid").limit(2)
    both = exact.withColumn("exact", F.lit(1)).unionByName(alike.withColumn("exact", F.lit(0)))  # three rows at most
    best = Window.partitionBy(F.lit(1))
    return both.withColumn("best", F.max("exact").over(best)).where("exact = best").drop("exact", "best")


def read_messages(
    data: Dataset, uuid: str, offset: int = 0, limit: int = 50, tool_output: bool = False, raw: bool = False
) -> DataFrame:
    """A page of a session by sequence number; ``has_more`` tells whether rows follow it."""
    limit = limit if limit > 0 else 50
    rows = data.messages.where(F.col("session_uuid") == uuid)
    if not tool_output:
        rows = rows.where(F.col("role").isin(*schema.DIALOGUE))
    rows = rows.select(
        "seq", "id", _or_zero("ts"), "role", "content", (F.col("raw_json") if raw else F.lit("")).alias("raw_json")
    )
    page = rows.orderBy("seq", "id").offset(offset).limit(limit + 1)  # bounded by the page
    numbered = page.withColumn(
        "rn", F.row_number().over(Window.orderBy("seq", "id"))
    ).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.where(F.col("rn") <= limit).select(
        "seq", "id", "ts", "role", "content", "raw_json", (F.col("n") > limit).alias("has_more")
    )


STRETCH = 1024


def windows(messages: DataFrame, hits: DataFrame, before: int, after: int, tool_output: bool = False) -> DataFrame:
    """For each hit (session_uuid, hit_seq) the rows around it, counted among the rows shown.

    Up to ``before`` rows before the hit and the hit itself (or, if it isn't shown, ``before`` + 1
    rows up to it) and up to ``after`` rows behind.  All hits are answered by one join.  Sessions are
    counted by stretches of sequence numbers first, and only the stretches near a hit that are
    needed are ranked: a session of any length costs a few of them.
    """
    shown = messages if tool_output else messages.where(F.col("role").isin(*schema.DIALOGUE))
    hits = hits.select("session_uuid", "hit_seq").distinct()
    rows = shown.join(
        F.broadcast(hits.select("session_uuid").distinct()), "session_uuid", "left_semi"
    ).withColumn("stretch", F.floor(F.col("seq") / STRETCH))
    counts = rows.groupBy("session_uuid", "stretch").agg(F.count("*").alias("n")).join(F.broadcast(hits), "session_uuid")
    side = F.signum(F.col("stretch") - F.floor(F.col("hit_seq") / STRETCH))
    nearest = Window.partitionBy("session_uuid", "hit_seq", "side").orderBy(
        F.abs(F.col("stretch") - F.floor(F.col("hit_seq") / STRETCH))
    )
    reached = counts.withColumn("side", side).withColumn("closer", F.sum("n").over(nearest) - F.col("n"))
    needed = reached.where(
        (F.col("side") == 0) | ((F.col("side") < 0) & (F.col("closer") <= before)) | ((F.col("side") > 0) & (F.col("closer") < after)),
    )
    rows = rows.join(
        F.broadcast(needed.select("session_uuid", "stretch", "hit_seq")), ["session_uuid", "stretch"]
    )  # a few stretches for each hit
    up, down = Window.partitionBy("session_uuid", "hit_seq", "upto").orderBy(F.desc("seq"), F.desc("id")), Window.partitionBy("session_uuid", "hit_seq", "upto").orderBy("seq", "id")
    rows = rows.withColumn("upto", F.col("seq") <= F.col("hit_seq"))
    rows = rows.withColumn("above", F.row_number().over(up)).withColumn("below", F.row_number().over(down))
    return rows.where(
        F.when(F.col("upto"), F.col("above") <= before + 1).otherwise(F.col("below") <= after)
    ).drop("above", "below", "upto", "stretch")


def get_window(data: Dataset, uuid: str, hit_seq: int, before: int = 2, after: int = 2, tool_output: bool = False) -> DataFrame:
    hits = data.messages.sparkSession.createDataFrame([(uuid, hit_seq)], "session_uuid string, hit_seq int")
    own = data.messages.where(F.col("session_uuid") == uuid)
    return windows(own, hits, max(before, 0), max(after, 0), tool_output).select("seq", "id", _or_zero("ts"), "role", "content")


def activity_by_kind(data: Dataset, kind: str, since: int = 0, project: str = "", source: str = "", limit: int = 50) -> DataFrame:
    """The most frequent values of a kind.  Facts without a session count only where nothing asks for one."""
    rows = data.tool_targets.where(F.col("kind") == kind)
    if since > 0:
        rows = rows.where(F.col("ts") >= since)
    if project or source != schema.ALL_SOURCES:
        own = data.sessions.where(expr.of_source(F.col("source"), source))
        if project:
            own = own.where(expr.starts_with(F.col("project_path"), project))
        rows = rows.join(own.select(F.col("uuid").alias("session_uuid")), "session_uuid")
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit if limit > 0 else 50)


def activity_summary(data: Dataset, group_by: str = "day", since: int = 0, project: str = "", source: str = "") -> DataFrame:
    """Sessions and messages by day of the last activity or by project; a child counts with its parent if that exists."""
    if group_by not in ("day", "project"):
        raise ValueError(f"no such grouping: {group_by}")
    s = data.sessions.where((F.col("ended_at") >= since) & expr.of_source(F.col("source"), source))
    if project:
        s = s.where(expr.starts_with(F.col("project_path"), project))
    # messages are counted before the join: sessions, not messages, are what fans out
    counts = data.messages.groupBy(F.col("session_uuid").alias("uuid")).agg(F.count("*").alias("messages"))
    parents = data.sessions.select(F.col("uuid").alias("parent_session"), F.col("uuid").alias("parent"))
    key = F.date_format(
        F.timestamp_seconds("ended_at"), "yyyy-MM-dd"
    ) if group_by == "day" else F.coalesce("project_path", F.lit("(unknown)"))
    rows = s.join(counts, "uuid", "left").join(parents, "parent_session", "left")
    return rows.groupBy(key.alias("key")).agg(
        F.countDistinct(F.coalesce("parent", "uuid")).alias("sessions"),
        F.coalesce(F.sum("messages"), F.lit(0)).cast("bigint").alias("messages"),
    ).orderBy(F.desc("key"))


def recall(
    data: Dataset, project: str, since: int, sessions: int = 5, activity: int = 5, no_commands: bool = False
) -> dict[str, DataFrame]:
    """A project's recent sessions, files and (unless left out) commands, of the default source."""
    out = {
        "sessions": list_sessions(data, SessionFilter(since=since, project=project, limit=sessions)),
        "files": activity_by_kind(data, "file", since, project, "", activity),
    }
    if not no_commands:
        out["commands"] = activity_by_kind(data, "command", since, project, "", activity)
    return out
