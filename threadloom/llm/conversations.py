"""Conversations rebuilt from message rows.

Rows are grouped by their channel (the session), ordered by their sequence number, given one
of the known roles and checked for reciprocal replies.  Sessions are cut into blocks of
``BLOCK`` sequence numbers; each block is reduced to a few values (its first and last
speaker, whether its turns alternate, how many rows it has), and only these are chained per
session, so a session with a third of all rows is spread over many tasks.  Inactivity gaps
above a threshold that is calibrated on all gaps split a conversation into segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: Known roles and the spellings that mean them.
ROLES = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "model": "assistant",
    "gemini": "assistant",
    "system": "system",
    "thinking": "thinking",
    "tool_use": "tool_use",
    "tool_result": "tool_result",
}
#: A gap longer than this quantile of all gaps, times GAP_FACTOR, starts a new segment.
GAP_QUANTILE, GAP_FACTOR = 0.99, 4


def known_role(role: Column) -> Column:
    """One of the six roles, null for anything else; letter case and surrounding spaces don't matter."""
    spelt = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.try_element_at(spelt, F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", "")))


def is_blank(content: Column) -> Column:
    return content.isNull() | content.rlike("(?U)^[\\s ​]*$")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time in seconds, milli-, micro- or nanoseconds; null without one."""
    return F.when(ts <= 0, None).when(ts < 100_000_000_000, ts).when(ts < 100_000_000_000_000, F.floor(ts / 1000)).when(
        ts < 100_000_000_000_000_000, F.floor(ts / 1_000_000)
    ).otherwise(F.floor(ts / 1_000_000_000))


def first_copies(messages: DataFrame) -> DataFrame:
    """One row per (session_uuid, seq), that with the smallest id: (session_uuid, seq, id, role, dialogue, at)."""
    role = known_role(F.col("role"))
    rows = messages.where("session_uuid is not null").select(
        "session_uuid",
        "seq",
        "id",
        F.struct(
            role.alias("role"),
            (role.isin("user", "assistant") & ~is_blank(F.col("content"))).alias("dialogue"),
            epoch_seconds(F.col("ts")).alias("at"),
        ).alias("v"),
    )
    kept = rows.groupBy("session_uuid", "seq").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    return kept.select("session_uuid", "seq", "id", "v.role", F.coalesce("v.dialogue", F.lit(False)).alias("dialogue"), "v.at")


def _blocks(copies: DataFrame) -> DataFrame:
    """Each block of a session as a few values; its turns are at most ``BLOCK`` short codes."""
    turn = F.when(F.col("dialogue"), F.struct("seq", (F.col("role") == "user").alias("user")))
    rows = copies.withColumn("block", F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / BLOCK))
    got = rows.groupBy("session_uuid", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.max(F.col("seq").isNull()).alias("unplaced"), F.max(F.col("role").isNull()).alias("stranger"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    unanswered = F.exists(
        F.sequence(F.lit(2), F.size("turns")), lambda k: F.element_at("turns", k - 1)["user"] & F.element_at("turns", k)["user"]
    )
    some = F.size("turns") > 0
    return got.select(
        "session_uuid", "block", "n", "low", "high", "unplaced", "stranger",
        F.when(F.size("turns") > 1, unanswered).otherwise(F.lit(False)).alias("unanswered"),
        F.when(some, F.element_at("turns", 1)["user"]).alias("first"),
        F.when(some, F.element_at("turns", -1)["user"]).alias("last"),
    )


def judge(messages: DataFrame, sessions: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(session_uuid, broken, empty, unanswered) for every uuid in ``sessions`` or ``messages``.

    broken: sequence numbers that are not exactly 0..n-1, or a row without a known role; empty: no
    turn of user or assistant that says something; unanswered: the dialogue starts with the
    assistant, or a user turn is not directly followed by one of the assistant.  Null uuids are no
    conversation; repeated (session, seq) count once, by the smallest id; a null seq is broken.
    """
    blocks = _blocks(first_copies(messages) if copies is None else copies)
    # across blocks without turns: the next block that has some
    order = Window.partitionBy("session_uuid").orderBy("block")
    spoken = blocks.where("first is not null").select(
        "session_uuid",
        "block",
        "first",
        "last",
        F.lead("first").over(order).alias("next"),
        F.lag("last").over(order).alias("before"),
    )
    cross = spoken.groupBy("session_uuid").agg(
        F.max(
            F.col("last") & F.coalesce("next", F.lit(True))
        ).alias("open"), F.max(F.col("before").isNull() & ~F.col("first")).alias("late")
    )
    whole = blocks.groupBy("session_uuid").agg(
        ((F.max("unplaced")) | (F.min("low") != 0) | (F.max("high") != F.sum("n") - 1) | F.max("stranger")).alias("broken"), F.max("unanswered").alias("inner")
    )
    found = whole.join(cross, "session_uuid", "left").select(
        "session_uuid",
        F.coalesce("broken", F.lit(True)).alias("broken"),
        F.col("open").isNull().alias("empty"),
        (F.col("inner") | F.coalesce(F.col("open") | F.col("late"), F.lit(False))).alias("unanswered"),
    )
    silent = sessions.select(F.col("uuid").alias("session_uuid")).where("session_uuid is not null").distinct().join(
        found.select("session_uuid"), "session_uuid", "left_anti"
    )
    return found.unionByName(
        silent.select("session_uuid", F.lit(False).alias("broken"), F.lit(True).alias("empty"), F.lit(False).alias("unanswered"))
    )


def to_drop(messages: DataFrame, sessions: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """The conversations to drop; ``copies``: ``first_copies`` of the messages, if they are there already."""
    return judge(messages, sessions, copies).where("broken or empty or unanswered").select("session_uuid")


def rebuild(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of the conversations that are kept: (session_uuid, seq, segment, role, content).

    ``segment`` counts from 0 and grows where the time since the previous row exceeds the
    calibrated gap; rows without a time never start a segment.
    """
    from threadloom.shared import materialise

    # read by several steps each: short codes without the texts
    every = materialise(first_copies(messages), "copies")
    copies = every.join(to_drop(messages, sessions, every), "session_uuid", "left_anti").withColumn("block", F.floor(F.col("seq") / BLOCK))
    inner, outer = Window.partitionBy("session_uuid", "block").orderBy("seq"), Window.partitionBy("session_uuid").orderBy("block")
    ends = copies.groupBy("session_uuid", "block").agg(F.max_by("at", "seq").alias("end")).withColumn("carried", F.lag("end").over(outer)).drop("end")
    timed = copies.join(ends, ["session_uuid", "block"]).withColumn(
        "gap", F.col("at") - F.coalesce(F.lag("at").over(inner), F.when(F.row_number().over(inner) == 1, F.col("carried")))
    )
    timed = materialise(timed.select("session_uuid", "block", "seq", "id", "role", "gap"), "gaps")
    limit = timed.where("gap > 0").agg(
        F.coalesce(F.percentile_approx("gap", GAP_QUANTILE) * GAP_FACTOR, F.lit(2**62)).alias("limit")
    )
    cut = timed.withColumn("cut", F.coalesce((F.col("gap") > limit.scalar()).cast("int"), F.lit(0)))
    before = cut.groupBy("session_uuid", "block").agg(F.sum("cut").alias("cuts")).withColumn(
        "before", F.sum("cuts").over(outer) - F.col("cuts")
    ).drop("cuts")
    placed = cut.join(before, ["session_uuid", "block"]).select(
        "id", "session_uuid", "seq", "role", (F.col("before") + F.sum("cut").over(inner)).alias("segment")
    )
    return placed.join(messages.select("id", "content"), "id").select("session_uuid", "seq", "segment", "role", "content")


#: Seconds of a block of a channel's rows in the order of their times.
SPAN = 3600


def sessionise(messages: DataFrame) -> DataFrame:
    """(session_uuid, segment, n_rows, n_turns, n_replies, first_at, last_at, kept): sessions by time alone.

    The rows of a channel are sorted by their times (in whatever unit; ties by ``seq`` and ``id``) and split where
    the time since the row before exceeds the calibrated gap.  A row that says something but has no known role is
    given the speaker who didn't speak last in its block; the first is a user.  A segment is kept if some turn of the assistant
    directly follows one of the user.  Nothing is asked of ``seq``.  Repeated (session, seq) count once, rows without
    ``seq`` each; null uuids and rows without a time are left out, blank rows are no turns.  Channels are cut into
    blocks of ``SPAN`` seconds, of which only the last row's time and speaker are chained.
    """
    role = known_role(F.col("role"))
    at = epoch_seconds(F.col("ts"))
    said = ~is_blank(F.col("content"))
    rows = messages.where("session_uuid is not null").select(
        "session_uuid", "id", "seq", F.struct(at.alias("at"), role.alias("role"), said.alias("said")).alias("v")
    )
    copy = F.when(F.col("seq").isNull(), F.col("id"))
    rows = rows.groupBy("session_uuid", "seq", copy.alias("copy")).agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    rows = rows.select("session_uuid", "id", "seq", "v.*").where("at is not null").withColumn("block", F.floor(F.col("at") / SPAN))
    inner, outer = Window.partitionBy("session_uuid", "block").orderBy("at", "seq", "id"), Window.partitionBy("session_uuid").orderBy("block")
    # whether the speaker is the user; unknown ones alternate from the last known one of the block
    known = F.when(F.col("said") & F.col("role").isin("user", "assistant"), F.col("role") == "user")
    open_ = F.col("said") & F.col("role").isNull()
    rows = rows.withColumn("known", known).withColumn("part", F.count("known").over(inner))
    part = Window.partitionBy("session_uuid", "block", "part").orderBy("at", "seq", "id")
    turn = F.sum(open_.cast("int")).over(part)
    start = F.first("known").over(part)
    user = F.when(F.col("known").isNotNull(), F.col("known")).when(open_, F.coalesce(start, F.lit(False)) == (turn % 2 == 0))
    rows = rows.withColumn("user", user)
    ends = rows.groupBy("session_uuid", "block").agg(
        F.max("at").alias("end"), F.max_by(F.col("user"), F.when(F.col("user").isNotNull(), F.struct("at", "seq", "id"))).alias("last")
    ).select("session_uuid", "block", F.lag("end").over(outer).alias("carried"), F.last("last", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("before_user"))
    rows = rows.join(ends, ["session_uuid", "block"])
    gap = F.col("at") - F.coalesce(F.lag("at").over(inner), F.col("carried"))
    prior = F.coalesce(F.last("user", True).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("before_user"))
    rows = rows.withColumns({"gap": gap, "prior": prior})
    limit = rows.where("gap > 0").agg(F.coalesce(F.percentile_approx("gap", GAP_QUANTILE) * GAP_FACTOR, F.lit(2**62)).alias("limit"))
    rows = rows.withColumn("cut", F.coalesce((F.col("gap") > limit.scalar()).cast("int"), F.lit(0)))
    cuts = rows.groupBy("session_uuid", "block").agg(F.sum("cut").alias("cuts"))
    cuts = cuts.select("session_uuid", "block", (F.sum("cuts").over(outer) - F.col("cuts")).alias("before"))
    rows = rows.join(cuts, ["session_uuid", "block"]).withColumn("segment", F.col("before") + F.sum("cut").over(inner))
    reply = ~F.col("user") & F.col("prior") & (F.col("cut") == 0)
    got = rows.groupBy("session_uuid", "segment").agg(
        F.count("*").alias("n_rows"), F.count("user").alias("n_turns"), F.count(F.when(reply, 1)).alias("n_replies"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return got.withColumn("kept", F.col("n_replies") > 0)
