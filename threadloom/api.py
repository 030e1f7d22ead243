"""The engine's calls with their defaults and ranges, over a dataset or a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.catalog import Dataset
from threadloom.functions.text import parse_since
from threadloom.plans import ask as ask_plan
from threadloom.plans import doctor as doctor_plan
from threadloom.plans import search as search_plan
from threadloom.plans import sessions as session_plan
from threadloom.plans import usage as usage_plan
from threadloom.plans.search import SearchFilter
from threadloom.plans.sessions import SessionFilter
from threadloom.store import Busy, Store, ingest_all, purge_missing, store_checks


class Engine:
    """All queries at one point in time; ``zone`` is that of dates without one."""

    def __init__(self, data: Dataset, as_of: int, zone: str = "UTC"):
        self.data, self.as_of, self.zone = data, as_of, zone

    @classmethod
    def fresh(cls, store: Store, roots: list[str], as_of: int, zone: str = "UTC") -> Engine:
        """Over a store that is brought up to date first; if another writer is at work, over what it has committed."""
        try:
            ingest_all(store, roots, as_of)
            purge_missing(store, roots)
        except Busy:
            pass
        return cls(store.dataset(), as_of, zone)

    def _since(self, text: str) -> int:
        return parse_since(text, self.as_of, self.zone)

    @staticmethod
    def _source(source: str) -> str:
        if not schema.valid_source(source):
            raise ValueError(f"no such source: {source}")
        return source

    def search(
        self,
        query: str,
        since: str = "",
        project: str = "",
        role: str = "",
        limit: int = 0,
        tool_output: bool = False,
        touched: str = "",
        tool: str = "",
        ran: str = "",
        source: str = "",
    ) -> DataFrame:
        f = SearchFilter(self._since(since), project, role, tool_output, touched, tool, ran, self._source(source))
        return search_plan.search(self.data, query, self.as_of, f, schema.clamp(limit, *schema.LIMITS["search"]))

    def ask(
        self,
        question: str,
        since: str = "",
        project: str = "",
        sessions: int = 0,
        window: int = 2,
        tokens: int = 0,
        source: str = "",
    ) -> DataFrame:
        return ask_plan.ask(
            self.data,
            question,
            self.as_of,
            self._since(since),
            project,
            self._source(source),
            schema.clamp(sessions, *schema.LIMITS["ask_sessions"]),
            window,
            schema.clamp(tokens, *schema.LIMITS["ask_tokens"], schema.LEAST_ASK_TOKENS),
        )

    def list(
        self,
        since: str = "",
        project: str = "",
        min_turns: int = 0,
        limit: int = 0,
        touched: str = "",
        tool: str = "",
        ran: str = "",
        include_subagents: bool = False,
        source: str = "",
    ) -> DataFrame:
        """Sessions with their tokens; a session without usage has none, not zero."""
        f = SessionFilter(
            self._since(since),
            project,
            min_turns,
            touched,
            tool,
            ran,
            None,
            "",
            include_subagents,
            self._source(source),
            schema.clamp(limit, *schema.LIMITS["list"]),
        )
        rows = session_plan.list_sessions(self.data, f)
        tokens = usage_plan.session_totals(self.data, rows).select(F.col("session_uuid").alias("uuid"), "total_tokens", "stale")
        return rows.join(tokens, "uuid", "left").orderBy(F.desc("ended_at"), F.desc("uuid"))

    def show(
        self, prefix: str, offset: int = 0, limit: int = 0, tool_output: bool = False, raw: bool = False, source: str = ""
    ) -> DataFrame:
        """A page of the session that the prefix names; LookupError if none or several do."""
        found = session_plan.resolve(self.data, prefix, self._source(source)).select("uuid").collect()  # two rows at most
        if len(found) != 1:
            raise LookupError("ambiguous session id prefix" if found else "no session matches that id")
        return session_plan.read_messages(
            self.data, found[0].uuid, max(offset, 0), schema.clamp(limit, *schema.LIMITS["read"]), tool_output, raw
        )

    def children(self, uuid: str, source: str = "all") -> DataFrame:
        return session_plan.list_sessions(self.data, SessionFilter(parent=uuid, source=self._source(source), limit=1000))

    def window(self, uuid: str, seq: int, before: int = 2, after: int = 2, tool_output: bool = False) -> DataFrame:
        return session_plan.get_window(self.data, uuid, seq, before, after, tool_output)

    def activity(self, by: str = "file", since: str = "", project: str = "", limit: int = 0, source: str = "") -> DataFrame:
        if by not in schema.KINDS:
            raise ValueError(f"no such kind: {by}")
        return session_plan.activity_by_kind(
            self.data, by, self._since(since), project, self._source(source), schema.clamp(limit, *schema.LIMITS["activity"])
        )

    def drill_down(self, kind: str, value: str, limit: int = 50, source: str = "") -> DataFrame:
        """The sessions behind an activity value."""
        return session_plan.list_sessions(
            self.data, SessionFilter(target=(kind, value), include_subagents=True, source=self._source(source), limit=limit)
        )

    def activity_summary(self, group_by: str = "day", since: str = "7d", project: str = "", source: str = "") -> DataFrame:
        if group_by in schema.KINDS:
            return self.activity(group_by, since, project, 0, source)
        if group_by == "usage":
            return usage_plan.source_totals(self.data, self._since(since), project, source or schema.DEFAULT_SOURCE)
        return session_plan.activity_summary(self.data, group_by, self._since(since), project, self._source(source))

    def usage(
        self,
        by: str = "session",
        since: str = "",
        project: str = "",
        model: str = "",
        limit: int = 0,
        source: str = schema.DEFAULT_SOURCE,
    ) -> DataFrame:
        limit = schema.clamp(limit, 20, 1000)
        if by == "session":
            return usage_plan.by_session(self.data, self._since(since), project, self._source(source), model, limit)
        if by == "source":
            return usage_plan.source_totals(self.data, self._since(since), project, self._source(source), model)
        return usage_plan.grouped(self.data, by, self._since(since), project, self._source(source), limit)

    def quota(self, snapshots: DataFrame) -> DataFrame:
        return usage_plan.with_quota_age(snapshots, self.as_of).orderBy(F.desc("observed_at"), "source", "limit_id")

    def recall(self, project: str, since: str = "14d", limit: int = 5, no_commands: bool = False) -> dict[str, DataFrame]:
        return session_plan.recall(self.data, project, self._since(since), limit, limit, no_commands)

    def doctor(self, store: Store | None = None, roots: list[str] | None = None) -> DataFrame:
        """(name, ok, n) of every check; those of files, state and conflicts need the store and the roots."""
        rows = doctor_plan.checks(self.data)
        return rows if store is None else rows.unionByName(store_checks(store, roots or []))
