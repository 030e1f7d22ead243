"""Incremental ingestion as keyed merges of tables: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import expr
from threadloom.operators.sequence import number_in_runs

STATE = ("source_file", "last_size", "last_mtime", "last_byte_offset", "head_fingerprint", "tail_fingerprint", "last_ingested_at", "unparsed_lines", "usage_skipped", "usage_unmapped", "usage_stale")


def classify(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(source_file, change): full, incremental or skip, from sizes and times (source_file, size, modified_ns).

    A changed head or tail of a file that grew means that it was rewritten: full.
    """
    old = state.select("source_file", "last_size", "last_mtime", F.col("head_fingerprint").alias("old_head"))
    rows = listing.join(old, "source_file", "left")
    rewritten = (F.col("old_head") != "") & (F.col("head_fingerprint") != F.col("old_head")) & (F.col("last_size") >= 512) if "head_fingerprint" in listing.columns else F.lit(False)
    change = (
        F.when(F.col("last_size").isNull() | (F.col("size") < F.col("last_size")), "full")
        .when(F.col("size") > F.col("last_size"), F.when(rewritten, "full").otherwise("incremental"))
        .when(F.col("modified_ns") != F.col("last_mtime"), "full")
        .otherwise("skip")
    )
    return rows.select("source_file", change.alias("change"))


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and the new ones whose key is not there; of new rows with one key any is taken."""
    return existing.unionByName(
        new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True
    )


def replace_sessions(existing: DataFrame, new: DataFrame, key: str = "session_uuid") -> DataFrame:
    """Rows of every session that is in ``new`` are replaced as a whole."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _fill(name: str) -> Column:
    return F.coalesce(F.when(F.col(f"o.{name}") != "", F.col(f"o.{name}")), F.col(f"n.{name}")).alias(name)


def merge_sessions(existing: DataFrame, new: DataFrame, full: bool) -> DataFrame:
    """Sessions after a pass.  A full pass replaces; an incremental one raises the end, takes the recounted turns and fills what was empty."""
    both = existing.alias("o").join(new.alias("n"), F.col("o.uuid") == F.col("n.uuid"), "full_outer")
    old, added = F.col("o.uuid").isNotNull(), F.col("n.uuid").isNotNull()
    names = [
        "project_path", "source_file", "started_at", "ended_at", "turn_count", "title", "parent_session", "agent_type", "source"
    ]
    if full:
        return both.select(
            F.coalesce("n.uuid", "o.uuid").alias("uuid"),
            *[F.when(added, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in names],
        )
    end = F.when(
        old & added, F.greatest(F.coalesce("o.ended_at", F.lit(0)), F.col("n.ended_at"))
    ).otherwise(F.coalesce("n.ended_at", "o.ended_at"))
    own = {"ended_at": end.alias("ended_at"), "turn_count": F.coalesce("n.turn_count", "o.turn_count").alias("turn_count")}
    own |= {c: F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("source_file",)}
    own["started_at"] = F.when(old, F.col("o.started_at")).otherwise(F.col("n.started_at")).alias("started_at")
    return both.select(F.coalesce("o.uuid", "n.uuid").alias("uuid"), *[own.get(c, _fill(c)) for c in names])


def merge_state(existing: DataFrame, new: DataFrame, monotonic: bool, counters: str = "replace") -> DataFrame:
    """File states after a pass.  A monotonic pass never moves an offset back and adds its unparsed
    lines only where the offset advanced; usage counters are replaced, accumulated or preserved.
    """
    both = existing.alias("o").join(new.alias("n"), F.col("o.source_file") == F.col("n.source_file"), "full_outer")
    old, added = F.col("o.source_file").isNotNull(), F.col("n.source_file").isNotNull()
    taken = added & (~old | F.lit(not monotonic) | (F.col("n.last_byte_offset") >= F.col("o.last_byte_offset")))
    advanced = F.col("n.last_byte_offset") > F.col("o.last_byte_offset")
    gathered = lambda c: F.when(~old, F.col(f"n.{c}")).when(advanced, F.col(f"o.{c}") + F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    own: dict[str, Column] = {}
    if monotonic:
        own["unparsed_lines"] = gathered("unparsed_lines")
    if counters == "accumulate":
        own |= {c: gathered(c) for c in ("usage_skipped", "usage_unmapped")}
    elif counters == "preserve":
        own |= {c: F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in ("usage_skipped", "usage_unmapped")}
        own["usage_stale"] = F.when(old, F.greatest("o.usage_stale", "n.usage_stale")).otherwise(F.col("n.usage_stale"))
    return both.select(
        F.coalesce("n.source_file", "o.source_file").alias("source_file"),
        *[F.when(taken, own.get(c, F.col(f"n.{c}"))).otherwise(F.col(f"o.{c}")).alias(c) for c in STATE[1:]],
    )


def split_conflicts(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions to take, sessions whose uuid another source owns); no source is the default one."""
    owner = existing.select("uuid", expr.source_or_default(F.col("source")).alias("owner"))
    rows = new.join(owner, "uuid", "left")
    clash = F.col("owner").isNotNull() & (F.col("owner") != expr.source_or_default(F.col("source")))
    return rows.where(~clash).drop("owner"), rows.where(clash).select(
        "source_file",
        "uuid",
        F.col("owner").alias("seen_source"),
        expr.source_or_default(F.col("source")).alias("conflicting_source"),
    )


def merge_conflicts(existing: DataFrame, clashes: DataFrame, clean_files: DataFrame, now: int) -> DataFrame:
    """Conflicts with their first and last time; those of files that were taken since are cleared."""
    both = existing.select(
        "source_file", "uuid", "seen_source", "conflicting_source", "first_seen_at", "last_seen_at"
    ).unionByName(clashes.withColumns({"first_seen_at": F.lit(now), "last_seen_at": F.lit(now)}))
    newest = F.max_by(F.struct("uuid", "seen_source", "conflicting_source"), "last_seen_at").alias("c")
    rows = both.groupBy("source_file").agg(
        newest, F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )
    return rows.select("source_file", "c.*", "first_seen_at", "last_seen_at").join(
        clean_files.select("source_file"), "source_file", "left_anti"
    )


def merge_quota(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Of each (source, limit_id) the observation with the latest time; the stored one wins a tie."""
    cols = [c for c in new.columns if c not in ("source", "limit_id")]
    both = existing.select(*new.columns).withColumn("__stored", F.lit(1)).unionByName(new.withColumn("__stored", F.lit(0)))
    best = both.groupBy("source", "limit_id").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "__stored")).alias("q"))
    return best.select("source", "limit_id", *[F.col(f"q.{c}").alias(c) for c in cols])


def tracked_files(state: DataFrame, sessions: DataFrame) -> DataFrame:
    return state.select("source_file").union(sessions.where("source_file <> ''").select("source_file")).distinct()


def missing_files(tracked: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Tracked files under an available root that are no longer there; files of other roots are kept."""
    inside = expr.any_of([F.col("source_file").startswith(r.rstrip("/") + "/") for r in roots])
    return tracked.where(inside).join(listing.select("source_file"), "source_file", "left_anti")


def purge(sessions: DataFrame, messages: DataFrame, missing: DataFrame, candidates: int) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) without those of missing files; refused where more than ten and half of all would go.

    Only the session that a missing file still owns goes with it.
    """
    n = missing.count()
    if n > 10 and 2 * n > candidates:
        raise ValueError(f"refusing to purge {n} of {candidates} files")
    kept = sessions.join(missing, "source_file", "left_anti")
    gone = sessions.join(missing, "source_file", "left_semi").select(F.col("uuid").alias("session_uuid"))
    return kept, messages.join(gone, "session_uuid", "left_anti")


def drop_repeated_messages(messages: DataFrame) -> DataFrame:
    """Of rows with one (session_uuid, seq) the one with the smallest id."""
    best = messages.groupBy("session_uuid", "seq").agg(F.min("id").alias("id"))
    return messages.join(best.select("id"), "id", "left_semi")


def drop_orphans(calls: DataFrame, messages: DataFrame) -> DataFrame:
    return calls.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")


def reset_subagents(state: DataFrame) -> DataFrame:
    """States without those of child transcripts, so that these are read again."""
    return state.where(~F.col("source_file").contains("/subagents/") & ~F.col("source_file").contains("\\subagents\\"))


def turn_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_uuid").agg(F.count(F.when(F.col("role") == "user", 1)).alias("turn_count"))


def next_seq(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_uuid").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def default_source(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("source", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(schema.DEFAULT_SOURCE)))


def backfill_targets(messages: DataFrame, targets: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Facts of tool_use messages of the default format that have none, derived from their raw lines.

    A line with n calls made n messages in a row: the i-th message of a run of equal raw lines stands for the
    line's (i mod n)-th call.  Messages that have facts, and lines that are no JSON, count in their run all the
    same; a null line is an empty one.  With ``sessions`` only those of the default source (or none) are filled.
    """
    from threadloom.sources.transcripts import _acted

    calls = messages.where((F.col("role") == "tool_use") & F.col("session_uuid").isNotNull())
    if sessions is not None:
        own = sessions.where(F.col("source").isNull() | (F.col("source") == schema.DEFAULT_SOURCE))
        calls = calls.join(own.select(F.col("uuid").alias("session_uuid")), "session_uuid", "left_semi")
    line = F.coalesce("raw_json", F.lit(""))
    marked = calls.select("id", "session_uuid", "seq", F.struct(F.xxhash64(line), F.md5(line)).alias("line"))
    places = number_in_runs(marked, ["session_uuid"], ["seq", "id"], "line").select("id", "at")
    lacking = calls.where("raw_json is not null").join(targets.select(F.col("message_id").alias("id")).distinct(), "id", "left_anti")
    blocks = F.expr(
        "filter(try_variant_get(try_parse_json(raw_json), '$.message.content', 'array<variant>'), b -> try_variant_get(b, '$.type', 'string') = 'tool_use' "
        f"and not startswith(coalesce(try_variant_get(b, '$.name', 'string'), ''), '{schema.OWN_TOOLS}'))",
    )
    rows = lacking.select("id", "session_uuid", "ts", blocks.alias("blocks")).where("size(blocks) > 0").join(places, "id")
    rows = rows.withColumn("b", F.get("blocks", F.pmod("at", F.size("blocks")).cast("int")))
    name = F.expr("try_variant_get(b, '$.name', 'string')")
    facts = F.filter(
        F.array(F.struct(F.lit("tool").alias("kind"), name.alias("value")), _acted("variant_get(b, '$.input', 'variant')", name)),
        lambda x: x["kind"].isNotNull() & (x["value"] != ""),
    )
    return rows.where(name != "").select(
        F.col("id").alias("message_id"), "session_uuid", "ts", F.inline(facts)
    ).withColumn("value", expr.cap_bytes(F.col("value"), schema.TARGET_BYTES))
