"""A store of tables in a folder, and the ingestion of transcript files into it.

A pass writes new folders and then one manifest, which names the folders of every table: all tables change
together or not at all, and readers of an older manifest keep what they read.  The tables that hold a session's rows
are cut into buckets by the session; a pass rewrites the buckets of replaced sessions alone and appends
what a grown file added.  One writer at a time holds the lease.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import Dataset
from threadloom.functions import expr
from threadloom.operators import change_feed, ingest
from threadloom.operators.text_index import TextIndex
from threadloom.plans import doctor
from threadloom.shared import drop_path, materialise, names_in, read_text, size_of, write_text
from threadloom.sources import files, transcripts

TABLES = {
    "sessions": "uuid string, project_path string, source_file string, started_at bigint, ended_at bigint, turn_count int, title string, parent_session string, agent_type string, source string",
    "messages": "id bigint, session_uuid string, seq int, ts bigint, role string, content string, raw_json string",
    "tool_targets": "message_id bigint, session_uuid string, ts bigint, kind string, value string",
    "session_usage": "session_uuid string, model string, source string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, reasoning bigint, tool bigint, total_tokens bigint, categories_json string",
    "quota_snapshots": "source string, limit_id string, observed_at bigint, used_percent double, window_minutes bigint, resets_at bigint, plan_type string",
    "ingest_state": "source_file string, last_size bigint, last_mtime bigint, last_byte_offset bigint, head_fingerprint string, tail_fingerprint string, last_ingested_at bigint, unparsed_lines bigint, usage_skipped bigint, usage_unmapped bigint, usage_stale int",
    "source_conflicts": "source_file string, uuid string, seen_source string, conflicting_source string, first_seen_at bigint, last_seen_at bigint",
}


@dataclass(frozen=True)
class Stats:
    scanned: int
    ingested: int
    skipped: int
    sessions: int


#: Tables whose rows belong to a session, with the column that says to which.
OWNED = {"messages": "session_uuid", "tool_targets": "session_uuid", "session_usage": "session_uuid"}
#: Seconds after which a lease that nobody gave back may be taken.
LEASE = 1800
#: Manifests that are kept, and with them the folders they name.
KEPT = 2


class Busy(RuntimeError):
    """Another writer holds the store."""


class Store:
    """Tables below one folder, all of one version: that of the newest manifest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, indexed: bool = True):
        self.spark, self.path, self.buckets, self.indexed = spark, path.rstrip("/"), buckets, indexed

    # --- versions

    def versions(self) -> list[int]:
        names = names_in(self.spark, f"{self.path}/manifests")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{table: {bucket: [folders]}} of a version, by default the newest; with ``buckets`` of the store."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        return json.loads(read_text(self.spark, self._at(known[-1] if version is None else version)))

    def _at(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def read(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        held = (manifest or self.manifest())["tables"].get(name, {})
        folders = sorted({f for b, own in held.items() if buckets is None or int(b) in buckets for f in own})
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def dataset(self) -> Dataset:
        m = self.manifest()
        tables = [self.read(n, m) for n in ("sessions", "messages", "tool_targets", "session_usage", "ingest_state")]
        return Dataset(*tables, self.text() if self.indexed else None)

    def text(self) -> TextIndex:
        """The full-text index of the messages."""
        return TextIndex(self.spark, f"{self.path}/text")

    def follow_text(self, changed: DataFrame | None = None) -> None:
        """Bring the full-text index to the messages: those in ``changed`` (id) are taken anew, then what is missing or too much is mended."""
        if not self.indexed:
            return
        text, messages = self.text(), self.read("messages").select("id", "content")
        if changed is not None:
            text.remove(changed)
        if text.n != messages.count() or changed is not None:
            have = materialise(text.ids(), "indexed")
            text.remove(have.join(messages.select("id"), "id", "left_anti"))
            text.add(messages.join(have, "id", "left_anti"))

    # --- writing

    @contextmanager
    def lease(self) -> Iterator[None]:
        """The right to write; ``Busy`` if another writer has it."""
        path, own = f"{self.path}/lease.json", uuid.uuid4().hex
        held = read_text(self.spark, path)
        if held is not None and time.time() - json.loads(held)["at"] < LEASE:
            raise Busy(path)
        try:
            write_text(self.spark, path, json.dumps({"owner": own, "at": time.time()}), overwrite=held is not None)
        except FileExistsError:
            raise Busy(path) from None
        if json.loads(read_text(self.spark, path))["owner"] != own:
            raise Busy(path)
        try:
            yield
        finally:
            now = read_text(self.spark, path)
            if now is not None and json.loads(now)["owner"] == own:
                drop_path(self.spark, path)

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        typed = self.spark.createDataFrame([], TABLES[name]).schema
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in typed])

    def _bucket(self, name: str, manifest: dict):
        return F.pmod(F.xxhash64(OWNED[name]), F.lit(manifest["buckets"])).cast("int")

    def _put(self, name: str, df: DataFrame, manifest: dict) -> dict[str, list[str]]:
        """Write rows in a new folder: {bucket: [folder]}."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows = self._typed(name, df)
        if name not in OWNED:
            rows.write.parquet(f"{self.path}/{folder}")
            return {"0": [folder]}
        rows.withColumn("bucket", self._bucket(name, manifest)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        parts = [n for n in names_in(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")]
        return {n[7:]: [f"{folder}/{n}"] for n in parts}

    def commit(self, replace: dict[str, DataFrame], append: dict[str, DataFrame], gone: dict[str, DataFrame]) -> int:
        """One new version of all tables.

        ``replace``: whole tables that no session owns.  ``append``: rows of the others; sessions in ``gone`` of a table
        (session_uuid) lose the rows that they have there, in their buckets alone.  If another writer has committed
        since this one began nothing changes and an error is raised.
        """
        old = self.manifest()
        new = {"version": old["version"] + 1, "buckets": old["buckets"], "tables": {n: dict(b) for n, b in old["tables"].items()}}
        for name, df in replace.items():
            new["tables"][name] = self._put(name, df, new)
        for name in OWNED:
            rows, held, touched = append.get(name), new["tables"].setdefault(name, {}), []
            if name in gone:
                lost = materialise(gone[name].select("session_uuid").distinct(), "gone")
                bucket = F.pmod(F.xxhash64("session_uuid"), F.lit(old["buckets"])).cast("int")
                touched = [r.b for r in lost.select(bucket.alias("b")).distinct().collect()]  # at most one per bucket
                touched = [b for b in touched if str(b) in held]
            if touched:
                stay = self._typed(name, self.read(name, old, touched).join(lost, "session_uuid", "left_anti"))
                rows = stay if rows is None else stay.unionByName(self._typed(name, rows))
            if rows is None:
                continue
            fresh = self._put(name, rows, new)
            for b in touched:
                held.pop(str(b), None)
            for b, folders in fresh.items():
                held[b] = held.get(b, []) + folders
        write_text(self.spark, self._at(new["version"]), json.dumps(new))
        self._drop_unused()
        return new["version"]

    def compact(self, most: int = 8) -> None:
        """Join the folders of buckets that have more than ``most``."""
        old = self.manifest()
        new = {**old, "version": old["version"] + 1, "tables": {n: dict(b) for n, b in old["tables"].items()}}
        for name in OWNED:
            many = [int(b) for b, own in old["tables"].get(name, {}).items() if len(own) > most]
            if many:
                fresh = self._put(name, self.read(name, old, many), new)
                new["tables"][name].update({str(b): fresh.get(str(b), []) for b in many})
        if new["tables"] != old["tables"]:
            write_text(self.spark, self._at(new["version"]), json.dumps(new))
            self._drop_unused()

    def _drop_unused(self) -> None:
        versions = self.versions()
        kept = {f for v in versions[-KEPT:] for t in self.manifest(v)["tables"].values() for own in t.values() for f in own}
        for version in versions[:-KEPT]:
            for f in {f for t in self.manifest(version)["tables"].values() for own in t.values() for f in own} - kept:
                drop_path(self.spark, f"{self.path}/{f}")
            drop_path(self.spark, self._at(version))


def _landed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"line_id": F.col("line_no"), "batch_no": F.lit(0)})


def _parse(lines: DataFrame, source: str, projects: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(messages, sessions, usage, usage counters) of the lines of one source, all with their file."""
    own = lines.where((files.source_of(F.col("source_file")) == source) & ~F.col("too_long"))
    adapter = transcripts.REGISTRY[source]
    rows = _landed(own) if adapter.whole_file else own
    sessions = adapter.sessions(rows)
    if projects is not None and source == "gemini":
        by_id = projects.select(F.col("project_id").alias("project_path"), F.col("project_path").alias("named"))
        sessions = sessions.join(by_id, "project_path", "left").withColumn(
            "project_path", F.coalesce("named", "project_path")
        ).drop("named")
    return adapter.messages(rows), sessions, adapter.usage(rows), adapter.counters(rows)


def ingest_all(store: Store, roots: list[str], now: int, full: bool = False, projects: DataFrame | None = None) -> Stats:
    """Bring the store up to date with the transcript files below ``roots``.

    Only the listing is read of files that did not change.  A new or rewritten file replaces its sessions; one
    that grew appends the messages that it added and gets its sessions, usage and state brought up to date.  A chat is
    replayed as a whole.  A file whose session another source owns is refused and recorded.  Lines that are no JSON or too
    long are counted, a last line without an end waits.  A file that changed while it was read is left for the
    next pass.  Running it again without changes writes nothing.  ``Busy`` is raised where another writer is at work.
    """
    with store.lease():
        return _ingest(store, roots, now, full, projects)


def index(store: Store, roots: list[str], now: int, full: bool = False, projects: DataFrame | None = None) -> Stats:
    """A pass, and then the facts of messages that have none from their stored lines."""
    stats = ingest_all(store, roots, now, full, projects)
    backfill(store)
    return stats


def _ingest(store: Store, roots: list[str], now: int, full: bool, projects: DataFrame | None) -> Stats:
    spark = store.spark
    before = store.manifest()
    listing = materialise(files.listing(spark, roots), "listing")
    state = store.read("ingest_state", before)
    old_state = state.select("source_file", "last_size", "last_mtime")
    stale = listing.join(old_state, "source_file", "left")
    same = (F.col("size") == F.col("last_size")) & (F.col("modified_ns") == F.col("last_mtime"))
    moved = stale if full else stale.where(~F.coalesce(same, F.lit(False)))
    moved = materialise(files.fingerprints(moved.select("source_file", "uri", "size", "modified_ns")), "moved")
    scanned, changed = listing.count(), moved.count()
    if not changed:
        return Stats(scanned, 0, scanned, 0)
    change = ingest.classify(moved, state)
    # a file that grew behind an end that is no longer what it was has been rewritten
    ends = state.where("last_byte_offset > 0").select("source_file", "last_byte_offset", F.col("tail_fingerprint").alias("old_tail"))
    grown = moved.select("source_file", "uri", "size").join(ends, "source_file").where("size > last_byte_offset")
    retold = files.fingerprints(grown, "last_byte_offset").where("tail_fingerprint <> old_tail").select("source_file", F.lit("full").alias("retold"))
    change = change.join(retold, "source_file", "left").select("source_file", F.coalesce("retold", "change").alias("change"))
    todo = moved.join(change, "source_file")
    todo = todo if full else todo.where("change <> 'skip'")
    lines = files.lines(todo)
    # a chat file with an unusable replacement keeps what it had; the pass is counted and tried again
    broken = materialise(
        change_feed.unusable_files(_landed(lines.where(files.source_of(F.col("source_file")) == "gemini"))), "broken"
    )
    # looked at again: what changed meanwhile waits for the next pass
    todo = materialise(files.unchanged(todo).join(broken, "source_file", "left_anti"), "todo")
    lines = materialise(lines.join(todo.select("source_file"), "source_file", "left_semi"), "lines")
    there = {r.source for r in todo.select(files.source_of(F.col("source_file")).alias("source")).distinct().collect()}
    parsed = [_parse(lines, name, projects) for name in transcripts.REGISTRY if name in there or not there]
    columns = [
        "source_file", "session_uuid", "seq", "ts", "role", "content", "raw_line", "tool_name", "acted_kind", "acted_value"
    ]
    every = lambda k: _union([p[k] for p in parsed])
    old_sessions = store.read("sessions", before)
    fresh = materialise(every(1), "sessions")
    # a file's former session must not count as another owner of its uuid
    taken, clash = ingest.split_conflicts(fresh, old_sessions)
    whole = [name for name, adapter in transcripts.REGISTRY.items() if adapter.whole_file]
    grew = (F.col("change") == "incremental") & ~files.source_of(F.col("source_file")).isin(whole) & F.lit(not full)
    known = old_sessions.select(F.col("uuid").alias("known"))
    owner = taken.select("source_file", F.col("uuid").alias("session_uuid"), "source").join(todo.select("source_file", grew.alias("grew")), "source_file")
    owner = owner.join(known, F.col("session_uuid") == F.col("known"), "left")
    owner = materialise(owner.select("source_file", "session_uuid", "source", (F.col("grew") & F.col("known").isNotNull()).alias("grew")), "owners")
    messages = materialise(every(0).drop("session_uuid").join(owner.select("source_file", "session_uuid", "grew"), "source_file").select(*columns, "grew"), "messages")
    messages = messages.withColumn("id", F.xxhash64("session_uuid", "seq"))
    turns = ingest.turn_counts(messages)
    sessions = taken.join(turns, F.col("uuid") == F.col("session_uuid"), "left").drop("session_uuid").withColumn(
        "turn_count", F.coalesce("turn_count", F.lit(0)).cast("int")
    )
    # of a session that grew only what stands behind its last message is new
    upto = ingest.next_seq(store.read("messages", before).join(owner.where("grew").select("session_uuid"), "session_uuid", "left_semi"))
    added = messages.join(upto, "session_uuid", "left").where(~F.col("grew") | (F.col("seq") >= F.coalesce("next_seq", F.lit(0))))
    added = materialise(added.drop("next_seq"), "added")
    tool = added.where("tool_name is not null").select(
        F.col("id").alias("message_id"), "session_uuid", "ts", F.lit("tool").alias("kind"), F.col("tool_name").alias("value")
    )
    acted = added.where("acted_kind is not null").select(
        F.col("id").alias("message_id"),
        "session_uuid",
        "ts",
        F.col("acted_kind").alias("kind"),
        F.col("acted_value").alias("value"),
    )
    usage = every(2).join(owner.drop("grew"), "source_file").drop("source_file")
    bad = lines.groupBy("source_file").agg(
        F.count(F.when(F.col("too_long") | F.expr("try_parse_json(raw_line) is null"), 1)).alias("unparsed_lines"),
        F.count(F.when(F.col("too_long"), 1)).alias("long_lines"),
    )
    counters = _union([p[3] for p in parsed])
    pass_state = todo.join(bad, "source_file", "left").join(counters, "source_file", "left").select(
        "source_file", F.col("size").alias("last_size"), F.col("modified_ns").alias("last_mtime"), F.col("size").alias("last_byte_offset"), "head_fingerprint", "tail_fingerprint", F.lit(now).alias("last_ingested_at"),
        F.coalesce("unparsed_lines", F.lit(0)).alias("unparsed_lines"), (F.coalesce("usage_skipped", F.lit(0)) + F.coalesce("long_lines", F.lit(0))).alias("usage_skipped"),
        F.coalesce("usage_unmapped", F.lit(0)).alias("usage_unmapped"), F.lit(0).alias("usage_stale"),
    ).join(clash.select("source_file"), "source_file", "left_anti")
    quota = transcripts.quota_snapshots(lines.where((files.source_of(F.col("source_file")) == "codex") & ~F.col("too_long")))
    replaced = owner.where("not grew").select("session_uuid")
    # usage is summed over the whole file, so its rows are replaced where messages are only added
    store.commit(
        {
            "sessions": ingest.merge_sessions(old_sessions, sessions, full=True),
            "quota_snapshots": ingest.merge_quota(store.read("quota_snapshots", before), quota),
            "ingest_state": _count_aborts(ingest.merge_state(state, pass_state, monotonic=False), broken),
            "source_conflicts": ingest.merge_conflicts(store.read("source_conflicts", before), clash, taken.select("source_file"), now),
        },
        {
            "messages": added.select("id", "session_uuid", "seq", "ts", "role", "content", F.col("raw_line").alias("raw_json")),
            "tool_targets": tool.unionByName(acted),
            "session_usage": usage,
        },
        {"messages": replaced, "tool_targets": replaced, "session_usage": owner.select("session_uuid")},
    )
    store.compact()
    store.follow_text(added.select("id"))
    return Stats(scanned, changed, scanned - changed, sessions.count())


def backfill(store: Store) -> int:
    """Facts of tool calls that have none, from the stored lines; returns the new version, 0 if nothing lacked."""
    with store.lease():
        m = store.manifest()
        targets = store.read("tool_targets", m)
        rows = materialise(ingest.backfill_targets(store.read("messages", m), targets, store.read("sessions", m)), "backfill")
        return 0 if rows.isEmpty() else store.commit({}, {"tool_targets": rows}, {})


def _count_aborts(state: DataFrame, broken: DataFrame) -> DataFrame:
    """One more unparsed line for each broken file; its offset stays where it was."""
    new = broken.join(state, "source_file", "left_anti").select(
        "source_file", *[F.lit("" if c.endswith("fingerprint") else 0).alias(c) for c in ingest.STATE[1:]]
    )
    hit = broken.withColumn("aborted", F.lit(1))
    rows = state.unionByName(new).join(hit, "source_file", "left")
    return rows.withColumn("unparsed_lines", F.col("unparsed_lines") + F.coalesce("aborted", F.lit(0))).drop("aborted")


def purge_missing(store: Store, roots: list[str]) -> int:
    """Remove the sessions of files that are gone from available roots; returns how many files."""
    with store.lease():
        spark = store.spark
        m = store.manifest()
        there = [r for r in roots if files.exists(spark, r)]
        if not there:
            return 0
        sessions, state = store.read("sessions", m), store.read("ingest_state", m)
        listing = files.listing(spark, there).select("source_file")
        tracked = ingest.tracked_files(state, sessions)
        missing = materialise(ingest.missing_files(tracked, listing, there), "missing")
        n = missing.count()
        if not n:
            return 0
        inside = expr.any_of([F.col("source_file").startswith(r.rstrip("/") + "/") for r in there])
        kept, _ = ingest.purge(sessions, store.read("messages", m), missing, tracked.where(inside).count())
        gone = sessions.join(missing, "source_file", "left_semi").select(F.col("uuid").alias("session_uuid"))
        store.commit(
            {
                "sessions": kept,
                "ingest_state": state.join(missing, "source_file", "left_anti"),
                "source_conflicts": store.read("source_conflicts", m).join(missing, "source_file", "left_anti"),
            },
            {},
            {name: gone for name in OWNED},
        )
        store.follow_text()
        return n


def reconcile(store: Store, roots: list[str], now: int) -> Stats:
    """The backstop of a watcher that may have missed something: a pass over all files, and the purge of those that are gone."""
    stats = ingest_all(store, roots, now)
    purge_missing(store, roots)
    return stats


def store_checks(store: Store, roots: list[str]) -> DataFrame:
    """Checks of files, state, conflicts and sizes: (name, ok, n)."""
    spark, m = store.spark, store.manifest()
    state = store.read("ingest_state", m)
    missing = [r for r in roots if not files.exists(spark, r)]
    listing = materialise(files.fingerprints(files.listing(spark, roots)), "listing")
    source = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    folders = [f for t in m["tables"].values() for own in t.values() for f in own]
    ok, ratio = doctor.size_ratio(sum(size_of(spark, f"{store.path}/{f}") for f in folders), source)
    facts = [("roots missing", not missing, len(missing)), ("size ratio, percent", ok, round(100 * ratio))]
    return _union(
        [
            spark.createDataFrame(facts, doctor.CHECK),
            doctor.state_checks(state),
            doctor.conflicts(store.read("source_conflicts", m)),
            doctor.file_checks(listing, state, roots),
        ]
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def drop(store: Store) -> None:
    drop_path(store.spark, store.path)


