"""Queries of the engine's own operators over the normalised tables, each with SQL that gives the same rows.

Where SQL cannot express an operator there is none, and the tests compare it with brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import catalog, schema
from threadloom.functions import display, expr, redact, text
from threadloom.operators import ingest
from threadloom.operators.sequence import drop_repeats, number_rows
from threadloom.operators.text_index import TextIndex, scored
from threadloom.plans import ask, doctor, search, sessions, usage
from threadloom.plans.search import SearchFilter
from threadloom.plans.sessions import SessionFilter
from threadloom.sources import files, transcripts
from threadloom.tables import table

#: The point in time that ages are counted from.
AS_OF = 1_782_864_000
SINCE = text.parse_since("60d", AS_OF)
#: The same as the SQL has it.
SINCE_SQL = 1_777_680_000
PROJECT = "/home/"
WORD, PHRASE, SHORT, WIDE = "lockfile", "permission denied", "ms", "位移值"
QUESTION = "why did the tokenizer fail with permission denied 位移值"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DEFAULT = "(source IS NULL OR source = '' OR source = 'claude-code')"
ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KIND = "CASE c.tool_name " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in schema.TOOL_FIELDS.items()) + " END"
TARGETS = f"""
tt AS (
  SELECT c.message_id, m.session_uuid, m.ts, 'tool' AS kind, c.tool_name AS value FROM tool_calls c JOIN messages m ON m.id = c.message_id
  WHERE c.tool_name <> '' AND NOT starts_with(c.tool_name, '{schema.OWN_TOOLS}')
  UNION ALL
  SELECT c.message_id, m.session_uuid, m.ts, {_KIND} AS kind, c.params_summary AS value FROM tool_calls c JOIN messages m ON m.id = c.message_id
  WHERE {_KIND} IS NOT NULL AND trim(c.params_summary) <> '')
"""
STATE = "st AS (SELECT source_file, max(CASE WHEN started_at % 11 = 0 THEN 1 ELSE 0 END) AS usage_stale FROM sessions GROUP BY source_file)"
LISTED = """coalesce(project_path, '') AS project_path, coalesce(title, '') AS title, coalesce(started_at, 0) AS started_at, coalesce(ended_at, 0) AS ended_at, turn_count,
  coalesce(parent_session, '') AS parent_session, coalesce(agent_type, '') AS agent_type, coalesce(source, 'claude-code') AS source,
  (SELECT count(*) FROM sessions sub WHERE sub.parent_session = s.uuid) AS subagents"""


def _redacted(value: str) -> str:
    """The chain of shapes in SQL, whose pattern engine has word boundaries of ASCII."""
    for pattern, mark in redact.RULES:
        plain = pattern.replace(redact._Z, r"\b").replace(redact._A, r"\b").replace("'", "''")
        value = f"regexp_replace({value}, '{plain}', '{mark.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return value


def _capped(value: str, size: int) -> str:
    """At most so many bytes of UTF-8 in SQL: the longest prefix of whole characters."""
    return f"CASE WHEN strlen({value}) <= {size} THEN {value} ELSE substr({value}, 1, list_aggregate(list_filter(range(0, {size + 1}), lambda k: strlen(substr({value}, 1, k)) <= {size}), 'max')) END"


def query(name: str, sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _data(spark: SparkSession, sf_dir: str) -> catalog.Dataset:
    return catalog.load(spark, sf_dir)


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the messages of a folder, made by the first search of an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        index = TextIndex(spark)
        index.add(table(spark, sf_dir, "messages").select("id", "content"))
        _INDEXES[key] = index
    return _INDEXES[key]


def _searched(spark: SparkSession, sf_dir: str) -> catalog.Dataset:
    return replace(_data(spark, sf_dir), text=text_index(spark, sf_dir))


# --- activity -----------------------------------------------------------------------------------


def _activity(name: str, kind: str, since: int = 0, project: str = "", source: str = "", limit: int = 50) -> None:
    joined = bool(project) or source != "all"
    where = f"tt.kind = '{kind}'" + (f" AND tt.ts >= {SINCE_SQL}" if since else "") + (f" AND starts_with({ASCII.format('s.project_path')}, '{project.lower()}')" if project else "")
    where += f" AND {DEFAULT.replace('source', 's.source')}" if source == "" else f" AND s.source = '{source}'" if source != "all" else ""
    sql = f"WITH {TARGETS} SELECT tt.value, count(*) AS n FROM tt {'JOIN sessions s ON s.uuid = tt.session_uuid' if joined else ''} WHERE {where} GROUP BY tt.value ORDER BY n DESC, tt.value LIMIT {limit}"
    query(name, sql)(lambda spark, d: sessions.activity_by_kind(_data(spark, d), kind, since, project, source, limit))


for _k in schema.KINDS:
    _activity(f"activity_by_kind_{_k}", _k)
_activity("activity_by_kind_all_sources", "command", source="all")
_activity("activity_by_kind_project_since", "file", SINCE, PROJECT)
_activity("activity_by_kind_codex", "tool", source="codex")


def _summary(name: str, group_by: str, since: int, source: str = "", project: str = "") -> None:
    key = "strftime(to_timestamp(s.ended_at) AT TIME ZONE 'UTC', '%Y-%m-%d')" if group_by == "day" else "coalesce(s.project_path, '(unknown)')"
    scope = "" if source == "all" else f" AND {DEFAULT.replace('source', 's.source')}"
    scope += f" AND starts_with({ASCII.format('s.project_path')}, '{project}')" if project else ""
    sql = f"""SELECT {key} AS key, count(DISTINCT coalesce(p.uuid, s.uuid)) AS sessions, count(m.id) AS messages FROM sessions s
      LEFT JOIN messages m ON m.session_uuid = s.uuid LEFT JOIN sessions p ON p.uuid = s.parent_session WHERE s.ended_at >= {SINCE_SQL if since else 0}{scope} GROUP BY 1 ORDER BY 1 DESC"""
    query(name, sql)(lambda spark, d: sessions.activity_summary(_data(spark, d), group_by, since, project, source))


_summary("activity_summary_day", "day", 0)
_summary("activity_summary_project", "project", SINCE)
_summary("activity_summary_day_all", "day", SINCE, "all", PROJECT)


# --- listing ------------------------------------------------------------------------------------


def _listing(name: str, f: SessionFilter, where: str = "") -> None:
    base = f"{DEFAULT}" if f.source == "" else "true" if f.source == "all" else f"source = '{f.source}'"
    base += f" AND ended_at >= {SINCE_SQL}" * (f.since > 0) + f" AND turn_count >= {f.min_turns}" * (f.min_turns > 0) + f" AND starts_with({ASCII.format('project_path')}, '{f.project}')" * bool(f.project) + where
    nest = "" if f.include_subagents else f" AND (parent_session IS NULL OR parent_session = '' OR parent_session NOT IN (SELECT uuid FROM sessions s WHERE {base} ORDER BY ended_at DESC NULLS LAST, uuid DESC LIMIT {f.limit}))"
    sql = f"WITH {TARGETS} SELECT uuid, {LISTED} FROM sessions s WHERE {base}{nest} ORDER BY s.ended_at DESC NULLS LAST, uuid DESC LIMIT {f.limit}"
    query(name, sql)(lambda spark, d: sessions.list_sessions(_data(spark, d), f))


_listing("list_sessions_default", SessionFilter())
_listing("list_sessions_include_subagents", SessionFilter(include_subagents=True))
_listing("list_sessions_all_sources", SessionFilter(source="all", limit=80))
_listing("list_sessions_min_turns", SessionFilter(min_turns=8))
_listing("list_sessions_project_since", SessionFilter(project=PROJECT, since=SINCE))
_listing(
    "list_sessions_touched",
    SessionFilter(touched="src/"),
    f" AND uuid IN (SELECT session_uuid FROM tt WHERE kind = 'file' AND starts_with({ASCII.format('value')}, 'src/'))",
)
_listing(
    "list_sessions_tool",
    SessionFilter(tool="Grep"),
    " AND uuid IN (SELECT session_uuid FROM tt WHERE kind = 'tool' AND value = 'Grep')",
)
_listing(
    "list_sessions_ran",
    SessionFilter(ran="go test"),
    f" AND uuid IN (SELECT session_uuid FROM tt WHERE kind = 'command' AND contains({ASCII.format('value')}, 'go test'))",
)
_listing(
    "list_sessions_exact_target",
    SessionFilter(target=("pattern", "**/*.py")),
    " AND uuid IN (SELECT session_uuid FROM tt WHERE kind = 'pattern' AND value = '**/*.py')",
)


_MOST_CHILDREN = "(SELECT parent_session FROM sessions WHERE parent_session <> '' GROUP BY 1 ORDER BY count(*) DESC, parent_session LIMIT 1)"


@query("list_sessions_children", f"SELECT uuid, {LISTED} FROM sessions s WHERE parent_session = {_MOST_CHILDREN} ORDER BY s.ended_at DESC NULLS LAST, uuid DESC LIMIT 1000")
def list_children(spark: SparkSession, d: str) -> DataFrame:
    """The children of the session that has most."""
    most = table(spark, d, "sessions").where("parent_session <> ''").groupBy("parent_session").count().orderBy(F.desc("count"), "parent_session").first()
    return sessions.list_sessions(_data(spark, d), SessionFilter(parent=most[0], source="all", limit=1000))


_LONGEST = "(SELECT session_uuid FROM messages WHERE session_uuid IN (SELECT uuid FROM sessions) GROUP BY 1 ORDER BY count(*) DESC, session_uuid LIMIT 1)"


def _longest(spark: SparkSession, d: str) -> str:
    counts = table(spark, d, "messages").join(
        table(spark, d, "sessions").select(F.col("uuid").alias("session_uuid")), "session_uuid", "left_semi"
    ).groupBy("session_uuid").count()
    return counts.orderBy(F.desc("count"), "session_uuid").first()[0]


@query("resolve_prefix", f"SELECT uuid, project_path FROM sessions WHERE uuid LIKE '1%' AND {DEFAULT} ORDER BY uuid LIMIT 2")
def resolve_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sessions.resolve(_data(spark, d), "1").select("uuid", "project_path")


@query("resolve_exact", f"SELECT uuid, project_path FROM sessions WHERE uuid = {_LONGEST}")
def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    return sessions.resolve(_data(spark, d), _longest(spark, d)).select("uuid", "project_path")


@query(
    "get_messages_page",
    f"SELECT seq, id, coalesce(ts, 0) AS ts, role, content, '' AS raw_json, true AS has_more FROM messages WHERE session_uuid = {_LONGEST} AND role IN ('user', 'assistant') ORDER BY seq, id LIMIT 50 OFFSET 20",
)
def get_messages_page(spark: SparkSession, d: str) -> DataFrame:
    return sessions.read_messages(_data(spark, d), _longest(spark, d), 20, 50)


@query(
    "get_messages_with_tools",
    f"SELECT seq, id, coalesce(ts, 0) AS ts, role, content, raw_json, true AS has_more FROM messages WHERE session_uuid = {_LONGEST} ORDER BY seq, id LIMIT 50",
)
def get_messages_with_tools(spark: SparkSession, d: str) -> DataFrame:
    return sessions.read_messages(_data(spark, d), _longest(spark, d), 0, 50, True, True)


@query("get_window", f"""
WITH m AS (SELECT seq, id, coalesce(ts, 0) AS ts, role, content FROM messages WHERE session_uuid = {_LONGEST} AND role IN ('user', 'assistant'))
SELECT * FROM (SELECT * FROM m WHERE seq <= 30 ORDER BY seq DESC, id DESC LIMIT 4) UNION ALL SELECT * FROM (SELECT * FROM m WHERE seq > 30 ORDER BY seq, id LIMIT 5)""")
def get_window(spark: SparkSession, d: str) -> DataFrame:
    return sessions.get_window(_data(spark, d), _longest(spark, d), 30, 3, 5)


_listing("recall_sessions", SessionFilter(since=SINCE, project=PROJECT, limit=5))
QUERIES["recall_sessions"] = lambda spark, d: sessions.recall(_data(spark, d), PROJECT, SINCE)["sessions"]
_activity("recall_files", "file", SINCE, PROJECT, "", 5)
QUERIES["recall_files"] = lambda spark, d: sessions.recall(_data(spark, d), PROJECT, SINCE)["files"]
_activity("recall_commands", "command", SINCE, PROJECT, "", 5)
QUERIES["recall_commands"] = lambda spark, d: sessions.recall(_data(spark, d), PROJECT, SINCE)["commands"]


# --- usage --------------------------------------------------------------------------------------

_SCOPE = "FROM session_usage u JOIN sessions s ON s.uuid = u.session_uuid LEFT JOIN st ON st.source_file = s.source_file"
_COUNTS = "count(DISTINCT u.session_uuid) AS sessions, cast(sum(u.total_tokens) AS BIGINT) AS total_tokens, count(DISTINCT CASE WHEN coalesce(st.usage_stale, 0) <> 0 THEN u.session_uuid END) AS stale_sessions"


def _usage_sessions(name: str, since: int = 0, model: str = "", limit: int = 20) -> None:
    where = (f" AND coalesce(s.ended_at, s.started_at, 0) >= {SINCE_SQL}" if since else "") + (f" AND u.model = '{model}'" if model else "")
    sums = ", ".join(f"cast(sum(u.{c}) AS BIGINT) AS {c}" for c in usage.TOKENS)
    sql = f"""WITH {STATE}, p AS (SELECT u.session_uuid, coalesce(s.source, 'claude-code') AS source, coalesce(s.project_path, '') AS project_path, coalesce(s.title, '') AS title, coalesce(s.agent_type, '') AS agent_type,
        coalesce(st.usage_stale, 0) <> 0 AS stale, string_agg(DISTINCT u.model, ',' ORDER BY u.model) AS models, {sums} {_SCOPE} WHERE true{where} GROUP BY 1, 2, 3, 4, 5, 6)
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total_tokens DESC, session_uuid) AS rn FROM p) WHERE rn <= {limit}"""
    query(name, sql)(lambda spark, d: usage.by_session(_data(spark, d), since, "", "", model, limit))


_usage_sessions("usage_by_session")
_usage_sessions("usage_model_filtered", SINCE, "alto-4")
for _by, _expr in (("project", "coalesce(s.project_path, '')"), ("model", "u.model")):
    query(f"usage_by_{_by}", f"""WITH {STATE}, g AS (SELECT coalesce(s.source, 'claude-code') AS source, {_expr} AS key, {_COUNTS} {_SCOPE} GROUP BY 1, 2)
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total_tokens DESC, key) AS rn FROM g) WHERE rn <= 20""")(lambda spark, d, by=_by: usage.grouped(_data(spark, d), by))


@query("usage_source_totals", f"WITH {STATE} SELECT coalesce(s.source, 'claude-code') AS source, {_COUNTS} {_SCOPE} GROUP BY 1")
def usage_source_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.source_totals(_data(spark, d))


@query(
    "session_total_tokens",
    f"WITH {STATE} SELECT u.session_uuid, coalesce(st.usage_stale, 0) <> 0 AS stale, cast(sum(u.total_tokens) AS BIGINT) AS total_tokens {_SCOPE} WHERE s.source = 'codex' GROUP BY 1, 2",
)
def session_total_tokens(spark: SparkSession, d: str) -> DataFrame:
    data = _data(spark, d)
    return usage.session_totals(data, data.sessions.where("source = 'codex'"))


_CURRENT = "SELECT source_file, line_no, arg_max(line_id, (batch_no, line_id)) AS line_id, arg_max(raw_line, (batch_no, line_id)) AS raw_line FROM {} GROUP BY 1, 2"
_JSON = "(SELECT source_file, line_no, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM ({}))"
_TS = r"CASE WHEN regexp_matches(j->>'$.timestamp', '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') THEN coalesce(cast(floor(epoch(try_cast(regexp_replace(j->>'$.timestamp', '\.\d+', '') AS TIMESTAMPTZ))) AS BIGINT), 0) ELSE 0 END"
_QUOTA = f"""
WITH r AS (SELECT source_file, line_no, {_TS} AS ts, j->'$.payload.rate_limits' AS l FROM {_JSON.format(_CURRENT.format('rollout_lines'))} WHERE j->>'$.type' = 'event_msg' AND j->>'$.payload.type' = 'token_count'),
w AS (SELECT source_file, line_no, ts, l, unnest(['primary', 'secondary']) AS w FROM r WHERE ts > 0 AND l->>'$.limit_id' <> ''),
q AS (SELECT (l->>'$.limit_id') || ':' || w AS limit_id, ts AS observed_at, coalesce(cast(json_extract_string(l, '$.' || w || '.used_percent') AS DOUBLE), 0) AS used_percent, coalesce(cast(json_extract_string(l, '$.' || w || '.window_minutes') AS BIGINT), 0) AS window_minutes,
  coalesce(cast(json_extract_string(l, '$.' || w || '.resets_at') AS BIGINT), 0) AS resets_at, coalesce(l->>'$.plan_type', '') AS plan_type, row_number() OVER (PARTITION BY (l->>'$.limit_id') || ':' || w ORDER BY ts DESC, source_file, line_no) AS rn
  FROM w WHERE json_type(l, '$.' || w) = 'OBJECT')
SELECT 'codex' AS source, limit_id, observed_at, used_percent, window_minutes, resets_at, plan_type<more> FROM q WHERE rn = 1"""


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    return files.current_lines(table(spark, d, "rollout_lines"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return files.current_lines(table(spark, d, "event_lines"))


@query("quota_latest", _QUOTA.replace("<more>", ""))
def quota_latest(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.quota_snapshots(_rollouts(spark, d))


@query(
    "quota_stale",
    _QUOTA.replace(
        "<more>",
        f", (window_minutes > 0 AND {AS_OF} - observed_at > window_minutes * 60) OR (resets_at > 0 AND resets_at < {AS_OF}) AS stale",
    ),
)
def quota_stale(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_quota_age(transcripts.quota_snapshots(_rollouts(spark, d)), AS_OF)


# --- search -------------------------------------------------------------------------------------


def _weight(role: str) -> str:
    return f"CASE {role} " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in expr.ROLE_WEIGHTS.items()) + f" ELSE {expr.OTHER_WEIGHT} END"


_RECENCY = f"CASE WHEN coalesce(ts, 0) <= 0 THEN 0.0 ELSE 0.5 / (1 + greatest(({AS_OF} - ts) / 86400.0, 0.0) / 30.0) END"
_D = "greatest(length({c}) - 2, 0)"


def _bm25_ctes(terms: list[str]) -> str:
    dfs = ", ".join(f"sum(CASE WHEN contains(lower(coalesce(content, '')), '{t.lower()}') THEN 1 ELSE 0 END)::DOUBLE AS df{k}" for k, t in enumerate(terms))
    return f"stats AS (SELECT count(*)::DOUBLE AS n, greatest(avg(greatest(length(coalesce(content, '')) - 2, 0)), 1e-9) AS average, {dfs} FROM messages)"


def _bm25(terms: list[str]) -> str:
    size = "1.2 * (1 - 0.75 + 0.75 * greatest(length(content) - 2, 0) / average)"
    parts = []
    for k, t in enumerate(terms):
        f = f"((length(lower(content)) - length(replace(lower(content), '{t.lower()}', ''))) / {len(t)}.0)"
        idf = f"CASE WHEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{k} + 0.5) / (df{k} + 0.5)) END"
        parts.append(f"({idf}) * {f} * 2.2 / ({f} + {size})")
    return "-(" + " + ".join(parts) + ")"


_MS = "(SELECT m.*, s.uuid AS suid, s.project_path, s.parent_session, s.agent_type, s.source FROM messages m LEFT JOIN sessions s ON s.uuid = m.session_uuid)"


def _search(name: str, q: str, f: SearchFilter = SearchFilter(), where: str = "", limit: int = 20, long: tuple[str, ...] = (WORD,), short: tuple[str, ...] = ()) -> None:
    """``long`` and ``short``: the terms of ``q`` as the SQL has them."""
    conds = [f"contains(lower(content), '{t.lower()}')" for t in long] + [f"contains({ASCII.format('content')}, '{t.lower()}')" for t in short]
    conds.append(f"role = '{f.role}'" if f.role else "true" if f.tool_output else "role IN ('user', 'assistant')")
    conds += [f"ts >= {SINCE_SQL}"] * (f.since > 0) + [
        f"starts_with({ASCII.format('project_path')}, '{f.project}')"
    ] * bool(f.project)
    conds.append(DEFAULT if f.source == "" else "true" if f.source == "all" else f"source = '{f.source}'")
    score = _bm25(long) if long else "0.0"
    order = "bm, id" if long else "ts DESC NULLS LAST, id"
    stats = f"{_bm25_ctes(long)}, " if long else ""
    sql = f"""WITH {TARGETS}, {stats} pool AS (SELECT id, seq, session_uuid, role, coalesce(ts, 0) AS ts0, ts, {score} AS bm FROM {_MS} {', stats' if long else ''} WHERE {' AND '.join(conds)}{where} ORDER BY {order} LIMIT {limit * 12}),
      scored AS (SELECT *, -bm * ({_weight('role')}) + {_RECENCY} AS score FROM pool)
      SELECT id, seq, session_uuid, role, ts0 AS ts, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, bm, id LIMIT {limit}"""
    query(name, sql)(
        lambda spark, d: search.search(_searched(spark, d), q, AS_OF, f, limit).select(
            "id", "seq", "session_uuid", "role", "ts", F.round("score", 6).alias("score")
        ),
    )


_search("search_long_and", f'{WORD} "{PHRASE}"', long=("lockfile", "permission denied"))
_search("search_short_only", f"{SHORT} 10", long=(), short=("ms", "10"))
_search("search_hybrid", f"{WORD} {SHORT}", short=("ms",))
_search("search_role", WORD, SearchFilter(role="thinking"))
_search("search_tool_output", WORD, SearchFilter(tool_output=True, source="all"))
_search("search_project_since", WORD, SearchFilter(project=PROJECT, since=SINCE))
_search(
    "search_touched",
    WORD,
    SearchFilter(touched="src/"),
    f" AND session_uuid IN (SELECT session_uuid FROM tt WHERE kind = 'file' AND starts_with({ASCII.format('value')}, 'src/'))",
)
_search("search_wide", WIDE, SearchFilter(source="all"), long=("位移值",))


@query(
    "bm25_scores",
    f"WITH {_bm25_ctes([WORD, PHRASE])} SELECT id, round({_bm25([WORD, PHRASE])}, 6) AS bm25 FROM messages, stats WHERE contains(lower(content), '{WORD}') OR contains(lower(content), '{PHRASE}')",
)
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(text_index(spark, d), [WORD, PHRASE], False).select("id", F.round("bm25", 6).alias("bm25"))


@query("snippet_window", f"""
WITH p AS (SELECT id, content, length(content) AS n, strpos({ASCII.format('content')}, '{WORD}') AS pos FROM messages WHERE contains({ASCII.format('content')}, '{WORD}')),
a AS (SELECT *, CASE WHEN greatest(pos - 61, 0) + 160 > n THEN greatest(n - 160, 0) ELSE greatest(pos - 61, 0) END AS st FROM p)
SELECT id, CASE WHEN n <= 160 THEN content ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || substr(content, st + 1, 160) || (CASE WHEN st + 160 < n THEN '…' ELSE '' END) END AS snippet FROM a""")
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where(expr.contains_short(F.col("content"), WORD))
    return m.select("id", expr.window_snippet(F.col("content"), [WORD]).alias("snippet"))


@query("snippet_marked", f"""
WITH p AS (SELECT id, content AS c, length(content) AS n, strpos({ASCII.format('content')}, '{WORD}') AS pos FROM messages WHERE contains(lower(content), '{WORD}')),
w AS (SELECT *, greatest(pos - 22, 1) AS st, least(greatest(pos - 22, 1) + 66, n + 1) AS en FROM p)
SELECT id, (CASE WHEN st > 1 THEN '…' ELSE '' END) || substr(c, st, pos - st) || '[' || substr(c, pos, {len(WORD)}) || ']' || substr(c, pos + {len(WORD)}, greatest(en - pos - {len(WORD)}, 0)) || (CASE WHEN en <= n THEN '…' ELSE '' END) AS snippet FROM w""")
def snippet_marked(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where(expr.contains_long(F.col("content"), WORD))
    return m.select("id", expr.marked_snippet(F.col("content"), [WORD]).alias("snippet"))


def _retrieve_ctes(terms: list[str], limit: int) -> str:
    long, short = text.by_length(terms)
    scope = f"role IN ('user', 'assistant') AND {DEFAULT}"
    mc = " + ".join(f"(CASE WHEN contains({ASCII.format('content')}, '{t}') THEN 1 ELSE 0 END)" for t in short)
    anyof = " OR ".join(f"contains(lower(content), '{t.lower()}')" for t in long)
    return f"""{_bm25_ctes(long)},
      a AS (SELECT session_uuid, seq, id, role, ts, true AS f, {_bm25(long)} AS bm FROM {_MS}, stats WHERE ({anyof}) AND {scope} ORDER BY bm, id LIMIT {limit * 12}),
      b AS (SELECT session_uuid, seq, id, role, ts, false AS f, -mc::DOUBLE AS bm FROM (SELECT *, {mc} AS mc FROM {_MS} WHERE {scope}) WHERE mc > 0 ORDER BY mc DESC, ts DESC NULLS LAST, id LIMIT {limit * 12}),
      c AS (SELECT *, -bm * ({_weight('role')}) + {_RECENCY} AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
      k AS (SELECT *, row_number() OVER (PARTITION BY session_uuid, seq ORDER BY f DESC, score DESC, id) AS rn, count(DISTINCT f) OVER (PARTITION BY session_uuid, seq) AS kinds FROM c),
      best AS (SELECT session_uuid, seq, id, role, coalesce(ts, 0) AS ts, f AS full, score + CASE WHEN f AND kinds = 2 THEN 0.5 ELSE 0 END AS score FROM k WHERE rn = 1),
      capped AS (SELECT *, row_number() OVER (PARTITION BY session_uuid ORDER BY best.full DESC, score DESC, session_uuid, seq) AS rs FROM best)"""


_TERMS = [WORD, PHRASE, "ms", "go"]
_COLS = 'session_uuid, seq, id, role, ts, c2."full" AS "full", round(score, 6) AS score'
for _name, _cap in (("retrieve_any_term", 0), ("retrieve_capped", 3)):
    query(_name, f"""WITH {_retrieve_ctes(_TERMS, 60)} SELECT {_COLS} FROM (SELECT * FROM capped {f'WHERE rs <= {_cap}' if _cap else ''} ORDER BY capped."full" DESC, score DESC, session_uuid, seq LIMIT 60) c2""")(
        lambda spark, d, cap=_cap: search.retrieve(
            _searched(spark, d), _TERMS, AS_OF, SearchFilter(), 60, cap
        ).withColumn("score", F.round("score", 6))
    )

@query("candidate_snippets", f"""WITH {_retrieve_ctes(_TERMS, 60)} SELECT c2.id, c2.session_uuid, c2.seq, substr(coalesce(m.content, ''), 1, 160) AS snippet FROM (SELECT * FROM capped ORDER BY capped."full" DESC, score DESC, session_uuid, seq LIMIT 60) c2 JOIN messages m ON m.id = c2.id""")
def candidate_snippets(spark: SparkSession, d: str) -> DataFrame:
    data = _searched(spark, d)
    got = search.retrieve(data, _TERMS, AS_OF, SearchFilter(), 60)
    return search.with_snippets(data, got).select("id", "session_uuid", "seq", "snippet")


#: The terms of the question as the SQL has them.
_ASKED = ['tokenizer', 'fail', 'permission', 'denied', '位移值', '位移', '移值']


@query("ask_groups", f"""WITH {_retrieve_ctes(_ASKED, 240)}, hits AS (SELECT * FROM capped WHERE rs <= 3 ORDER BY capped."full" DESC, score DESC, session_uuid, seq LIMIT 240),
g AS (SELECT session_uuid, bool_or(hits."full") AS strong, coalesce(list_sum(list_reverse_sort(list(score) FILTER (WHERE hits."full"))[1:3]), 0) AS f, coalesce(list_sum(list_reverse_sort(list(score) FILTER (WHERE NOT hits."full"))[1:3]), 0) AS w, count(*) FILTER (WHERE NOT hits."full") AS short FROM hits GROUP BY 1),
s AS (SELECT session_uuid, strong, CASE WHEN strong THEN f + least(short, 3) * 0.5 ELSE w END AS score FROM g)
SELECT session_uuid, strong AS "full", round(score, 6) AS score, row_number() OVER (ORDER BY strong DESC, s.score DESC, session_uuid) - 1 AS rank FROM s ORDER BY strong DESC, s.score DESC, session_uuid LIMIT 6""")
def ask_groups(spark: SparkSession, d: str) -> DataFrame:
    return ask.groups(_searched(spark, d), QUESTION, AS_OF).select("session_uuid", "full", F.round("score", 6).alias("score"), "rank")


@query("ask_excerpts")
def ask_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return ask.ask(_searched(spark, d), QUESTION, AS_OF).withColumn("score", F.round("score", 6))


# --- ingestion ----------------------------------------------------------------------------------


@query("dedup_min_id", "SELECT min(id) AS id, session_uuid, seq FROM messages GROUP BY session_uuid, seq")
def dedup_min_id(spark: SparkSession, d: str) -> DataFrame:
    return ingest.drop_repeated_messages(table(spark, d, "messages").select("id", "session_uuid", "seq"))


@query(
    "drop_orphan_calls",
    "SELECT message_id, tool_name, params_summary FROM tool_calls WHERE message_id IN (SELECT id FROM messages WHERE role = 'tool_use')",
)
def drop_orphan_calls(spark: SparkSession, d: str) -> DataFrame:
    return ingest.drop_orphans(table(spark, d, "tool_calls"), table(spark, d, "messages").where("role = 'tool_use'"))


@query("turn_counts", "SELECT session_uuid, count(*) FILTER (WHERE role = 'user') AS turn_count FROM messages GROUP BY 1")
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.turn_counts(table(spark, d, "messages"))


@query("next_seq", "SELECT session_uuid, coalesce(max(seq), -1) + 1 AS next_seq FROM messages GROUP BY 1")
def next_seq(spark: SparkSession, d: str) -> DataFrame:
    return ingest.next_seq(table(spark, d, "messages"))


@query("default_source", "SELECT uuid, coalesce(nullif(source, ''), 'claude-code') AS source FROM sessions")
def default_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.default_source(table(spark, d, "sessions")).select("uuid", "source")


_EV = _JSON.format(_CURRENT.format("event_lines"))
_RO = _JSON.format(_CURRENT.format("rollout_lines"))
_NUM = lambda o, k: f"sum(CASE WHEN json_type({o}, '$.{k}') IN ('UBIGINT', 'BIGINT') THEN cast({o}->>'$.{k}' AS BIGINT) ELSE 0 END)"


@query("event_usage", f"""
WITH a AS (SELECT source_file, line_no, j->>'$.uuid' AS uuid, j->>'$.message.model' AS model, j->'$.message.usage' AS u FROM {_EV} WHERE j->>'$.type' = 'assistant' AND json_type(j, '$.message') = 'OBJECT' AND json_type(j, '$.uuid') = 'VARCHAR' AND j->>'$.uuid' <> ''),
l AS (SELECT *, row_number() OVER (PARTITION BY source_file, uuid ORDER BY line_no DESC) AS rn FROM a),
s AS (SELECT source_file, coalesce(nullif(model, ''), '(unknown)') AS model, {_NUM('u', 'input_tokens')} AS input_tokens, {_NUM('u', 'output_tokens')} AS output_tokens, {_NUM('u', 'cache_read_input_tokens')} AS cache_read, {_NUM('u', 'cache_creation_input_tokens')} AS cache_creation
  FROM l WHERE rn = 1 AND json_type(u) = 'OBJECT' GROUP BY 1, 2)
SELECT source_file, model, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, cache_read::BIGINT AS cache_read, cache_creation::BIGINT AS cache_creation, (input_tokens + output_tokens + cache_read + cache_creation)::BIGINT AS total_tokens FROM s WHERE input_tokens + output_tokens + cache_read + cache_creation > 0""")
def event_usage(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.event_usage(_events(spark, d)).where("total_tokens > 0").select(
        "source_file", "model", "input_tokens", "output_tokens", "cache_read", "cache_creation", "total_tokens"
    )


@query("rollout_usage", f"""
WITH a AS (SELECT source_file, line_no, j->'$.payload.info.total_token_usage' AS u FROM {_RO} WHERE j->>'$.type' = 'event_msg' AND j->>'$.payload.type' = 'token_count' AND json_type(j, '$.payload.info.total_token_usage.total_tokens') IN ('UBIGINT', 'BIGINT')),
l AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_no DESC) AS rn FROM a)
SELECT source_file, '(mixed)' AS model, cast(coalesce(u->>'$.input_tokens', '0') AS BIGINT) AS input_tokens, cast(coalesce(u->>'$.output_tokens', '0') AS BIGINT) AS output_tokens, cast(coalesce(u->>'$.cached_input_tokens', '0') AS BIGINT) AS cache_read, cast(u->>'$.total_tokens' AS BIGINT) AS total_tokens FROM l WHERE rn = 1""")
def rollout_usage(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.rollout_usage(_rollouts(spark, d)).select(
        "source_file", "model", "input_tokens", "output_tokens", "cache_read", "total_tokens"
    )


def _chat_usage_sql() -> str:
    from threadloom.plans.data_queries import ORACLES as data

    n = lambda k: f"coalesce(sum(CASE WHEN json_type(u, '$.{k}') IN ('UBIGINT', 'BIGINT') THEN cast(u->>'$.{k}' AS BIGINT) END), 0)::BIGINT"
    return f"""
WITH live AS ({data['p4_found']}), c AS (SELECT source_file, line_no, arg_max(raw_line, (batch_no, line_id)) AS raw FROM chat_lines WHERE line_no >= 2 GROUP BY 1, 2),
b AS (SELECT live.source_file, msg_id, raw::JSON AS j FROM live JOIN c ON c.source_file = live.source_file AND c.line_no = live.line_no),
m AS (SELECT source_file, CASE WHEN json_type(j, '$."$set"') IS NOT NULL THEN list_filter(json_extract(j, '$."$set".messages[*]'), lambda x: x->>'$.id' = msg_id)[-1] ELSE j END AS m FROM b),
t AS (SELECT source_file, coalesce(nullif(m->>'$.model', ''), '(unknown)') AS model, m->'$.tokens' AS u FROM m WHERE json_type(m, '$.tokens.total') IN ('UBIGINT', 'BIGINT', 'NULL'))
SELECT source_file, model, {n('input')} AS input_tokens, {n('output')} AS output_tokens, {n('cached')} AS cache_read, {n('thoughts')} AS reasoning, {n('tool')} AS tool, {n('total')} AS total_tokens FROM t GROUP BY 1, 2
HAVING greatest({n('input')}, {n('output')}, {n('cached')}, {n('thoughts')}, {n('tool')}, {n('total')}) > 0"""


@query("chat_usage", _chat_usage_sql())
def chat_usage(spark: SparkSession, d: str) -> DataFrame:
    got = transcripts.chat_usage(table(spark, d, "chat_lines"))
    return got.select("source_file", "model", "input_tokens", "output_tokens", "cache_read", "reasoning", "tool", "total_tokens")


@query("chat_messages")
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.chat_messages(table(spark, d, "chat_lines"))


@query("event_messages")
def event_messages(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.event_messages(_events(spark, d)).drop("raw_line")


@query("rollout_messages")
def rollout_messages(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.rollout_messages(_rollouts(spark, d)).drop("raw_line")


_FIELD = "CASE n " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, (_, f) in schema.TOOL_FIELDS.items()) + " END"
_TARGET = "CASE n " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in schema.TOOL_FIELDS.items()) + " END"


@query("event_targets", f"""
WITH e AS (SELECT j->'$.message.content' AS c FROM {_EV} WHERE j->>'$.type' IN ('user', 'assistant')), b AS (SELECT json_extract(c, '$[' || k || ']') AS b FROM (SELECT c, unnest(range(json_array_length(c)::BIGINT)) AS k FROM e WHERE json_type(c) = 'ARRAY')),
t AS (SELECT b->>'$.name' AS n, b FROM b WHERE b->>'$.type' = 'tool_use'), v AS (SELECT {_TARGET} AS kind, json_extract_string(b, '$.input.' || {_FIELD}) AS value, json_type(b, '$.input.' || {_FIELD}) AS kt FROM t WHERE {_FIELD} IS NOT NULL),
r AS (SELECT kind, {_redacted("value")} AS value FROM v WHERE kt = 'VARCHAR' AND trim(value) <> '')
SELECT kind, {_capped("value", 512)} AS value, count(*) AS n FROM r GROUP BY 1, 2""")
def event_targets(spark: SparkSession, d: str) -> DataFrame:
    """Everything that events acted on, commands too: redacted by shape and capped at 512 bytes."""
    rows = transcripts.event_messages(_events(spark, d)).where("acted_kind is not null")
    return rows.groupBy(F.col("acted_kind").alias("kind"), F.col("acted_value").alias("value")).agg(F.count("*").alias("n"))


@query("event_blocks", f"""
WITH e AS (SELECT source_file, line_no, j->>'$.type' AS type, j->'$.message.content' AS c FROM {_EV} WHERE j->>'$.type' IN ('user', 'assistant')),
b AS (SELECT source_file, line_no, 0 AS block_no, type, 'text' AS kind, c->>'$' AS t FROM e WHERE json_type(c) = 'VARCHAR'
  UNION ALL SELECT source_file, line_no, k AS block_no, type, json_extract_string(c, '$[' || k || '].type') AS kind, json_extract_string(c, '$[' || k || '].' || CASE json_extract_string(c, '$[' || k || '].type') WHEN 'thinking' THEN 'thinking' ELSE 'text' END) AS t
  FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS k FROM e WHERE json_type(c) = 'ARRAY'))
SELECT source_file, line_no, block_no, CASE kind WHEN 'text' THEN type ELSE 'thinking' END AS role, trim(t) AS content FROM b WHERE kind IN ('text', 'thinking') AND trim(t) <> ''""")
def event_blocks(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.event_blocks(_events(spark, d)).where("kind in ('text', 'thinking')").select(
        "source_file", "line_no", "block_no", "role", "content"
    )


_STEM = r"regexp_extract(source_file, '([^/]+)\.jsonl$', 1)"


@query("event_sessions", f"""
WITH e AS (SELECT source_file, line_no, j, {_TS} AS ts FROM {_EV} WHERE j IS NOT NULL)
SELECT {_STEM} AS uuid, source_file, min(ts) FILTER (WHERE ts > 0) AS started_at, max(ts) FILTER (WHERE ts > 0) AS ended_at,
  CASE WHEN regexp_matches(source_file, 'subagents/agent-') THEN coalesce(arg_min(j->>'$.sessionId', line_no) FILTER (WHERE json_type(j, '$.sessionId') = 'VARCHAR' AND j->>'$.sessionId' <> ''), regexp_extract(source_file, '([^/]+)/subagents/[^/]+$', 1)) END AS parent_session,
  CASE WHEN regexp_matches(source_file, 'subagents/agent-') THEN arg_min(j->>'$.attributionAgent', line_no) FILTER (WHERE json_type(j, '$.attributionAgent') = 'VARCHAR' AND j->>'$.attributionAgent' <> '') END AS agent_type
FROM e GROUP BY source_file""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.event_sessions(_events(spark, d)).select(
        "uuid", "source_file", "started_at", "ended_at", "parent_session", "agent_type"
    )


@query("rollout_sessions", f"""
SELECT source_file, min(ts) FILTER (WHERE ts > 0) AS started_at, max(ts) FILTER (WHERE ts > 0) AS ended_at, arg_min(j->>'$.payload.cwd', line_no) FILTER (WHERE j->>'$.type' IN ('session_meta', 'turn_context') AND json_type(j, '$.payload.cwd') = 'VARCHAR' AND j->>'$.payload.cwd' <> '') AS project_path
FROM (SELECT source_file, line_no, j, {_TS} AS ts FROM {_RO} WHERE j IS NOT NULL) GROUP BY source_file""")
def rollout_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.rollout_sessions(_rollouts(spark, d)).select("source_file", "started_at", "ended_at", "project_path")


@query(
    "sequence_assignment",
    "SELECT source_file, line_no, line_id, row_number() OVER (PARTITION BY source_file ORDER BY line_no, line_id) - 1 AS seq FROM event_lines",
)
def sequence_assignment(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(
        table(spark, d, "event_lines").select("source_file", "line_no", "line_id"), ["source_file"], "line_no", ["line_id"]
    )


@query(
    "consecutive_dedupe",
    "SELECT session_uuid, seq, id, raw_json FROM (SELECT *, lag(coalesce(raw_json, '')) OVER w AS p, row_number() OVER w AS rn FROM messages WINDOW w AS (PARTITION BY session_uuid ORDER BY seq NULLS FIRST, id)) WHERE rn = 1 OR coalesce(raw_json, '') <> p",
)
def consecutive_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The raw lines of every session without consecutive repeats; a missing line is an empty one."""
    rows = table(spark, d, "messages").select("session_uuid", "seq", "id", "raw_json", F.coalesce("raw_json", F.lit("")).alias("line"))
    return drop_repeats(rows, ["session_uuid"], ["seq", "id"], "line").drop("line")


@query(
    "route_sources",
    r"SELECT source_file, CASE WHEN regexp_matches(source_file, '(^|/)rollout-[^/]*\.jsonl$') THEN 'codex' WHEN regexp_matches(source_file, '/chats/session-[^/]*\.jsonl$') THEN 'gemini' ELSE 'claude-code' END AS source, count(*) AS n FROM (SELECT source_file FROM event_lines UNION ALL SELECT source_file FROM rollout_lines UNION ALL SELECT source_file FROM chat_lines) GROUP BY 1, 2",
)
def route_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_lines").select("source_file").unionByName(
        table(spark, d, "rollout_lines").select("source_file")
    ).unionByName(table(spark, d, "chat_lines").select("source_file"))
    return rows.groupBy("source_file", files.source_of(F.col("source_file")).alias("source")).agg(F.count("*").alias("n"))


_STATE_SQL = "SELECT source_file, max(line_no) AS size, count(*) AS n FROM {} WHERE {} GROUP BY 1"


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """File states before and after the second half of the deliveries."""
    lines = table(spark, d, "event_lines")
    cut = lines.agg(F.floor(F.avg("batch_no")).alias("cut"))
    make = lambda rows: rows.groupBy("source_file").agg(F.max("line_no").alias("last_byte_offset"), F.count("*").alias("unparsed_lines"))
    rows = lines.withColumn("cut", cut.scalar())
    full = lambda df: df.withColumns({"last_size": F.col("last_byte_offset"), "last_mtime": F.lit(0), "head_fingerprint": F.lit(""), "tail_fingerprint": F.lit(""), "last_ingested_at": F.lit(0), "usage_skipped": F.lit(0), "usage_unmapped": F.lit(0), "usage_stale": F.lit(0)})
    return full(make(rows.where("batch_no <= cut"))), full(make(rows.where("batch_no > cut")))


@query("merge_upsert_state", """
WITH c AS (SELECT floor(avg(batch_no)) AS cut FROM event_lines),
o AS (SELECT source_file, max(line_no) AS off, count(*) AS u FROM event_lines, c WHERE batch_no <= cut GROUP BY 1), n AS (SELECT source_file, max(line_no) AS off, count(*) AS u FROM event_lines, c WHERE batch_no > cut GROUP BY 1)
SELECT coalesce(n.source_file, o.source_file) AS source_file, CASE WHEN n.off IS NULL THEN o.off WHEN o.off IS NULL OR n.off >= o.off THEN n.off ELSE o.off END AS last_byte_offset,
  CASE WHEN o.u IS NULL THEN n.u WHEN n.off > o.off THEN o.u + n.u ELSE o.u END AS unparsed_lines FROM o FULL JOIN n ON o.source_file = n.source_file""")
def merge_upsert_state(spark: SparkSession, d: str) -> DataFrame:
    old, new = _states(spark, d)
    return ingest.merge_state(old, new, monotonic=True).select("source_file", "last_byte_offset", "unparsed_lines")


@query("classify_changes", """
WITH c AS (SELECT floor(avg(batch_no)) AS cut FROM event_lines), o AS (SELECT source_file, max(line_no) AS s FROM event_lines, c WHERE batch_no <= cut GROUP BY 1), n AS (SELECT source_file, max(line_no) AS s FROM event_lines GROUP BY 1)
SELECT n.source_file, CASE WHEN o.s IS NULL OR n.s < o.s THEN 'full' WHEN n.s > o.s THEN 'incremental' ELSE 'skip' END AS change FROM n LEFT JOIN o ON o.source_file = n.source_file""")
def classify_changes(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "event_lines").groupBy("source_file").agg(F.max("line_no").alias("size")).withColumn("modified_ns", F.lit(0))
    return ingest.classify(listing, _states(spark, d)[0])


@query(
    "union_tracked_files", "SELECT source_file FROM sessions WHERE source_file <> '' UNION SELECT source_file FROM event_lines"
)
def union_tracked_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.tracked_files(table(spark, d, "event_lines"), table(spark, d, "sessions"))


@query(
    "anti_join_purge",
    "SELECT uuid FROM sessions WHERE source_file IS NULL OR NOT (starts_with(source_file, '/var/sync/done/gemini/'))",
)
def anti_join_purge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    listing = s.where(~F.col("source_file").startswith("/var/sync/done/gemini/")).select("source_file")
    missing = ingest.missing_files(
        ingest.tracked_files(s.select("source_file").where("source_file <> ''"), s), listing, ["/var/sync/done"]
    )
    return ingest.purge(s, table(spark, d, "messages"), missing, s.count())[0].select("uuid")


@query(
    "source_conflicts",
    "SELECT source_file, uuid, coalesce(nullif(source, ''), 'claude-code') AS seen_source, 'codex' AS conflicting_source FROM sessions WHERE coalesce(nullif(source, ''), 'claude-code') <> 'codex'",
)
def source_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    return ingest.split_conflicts(s.withColumn("source", F.lit("codex")), s)[1]


@query("insert_or_ignore", "SELECT session_uuid, seq FROM messages WHERE session_uuid IS NOT NULL GROUP BY 1, 2")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("session_uuid is not null").select("session_uuid", "seq")
    return ingest.insert_or_ignore(m.where("seq % 3 = 0").dropDuplicates(), m, ["session_uuid", "seq"])


@query("merge_sessions_incremental", """
SELECT uuid, greatest(coalesce(ended_at, 0), coalesce(started_at, 0) + 5000) AS ended_at, turn_count + 1 AS turn_count, coalesce(nullif(title, ''), 'filled') AS title, coalesce(nullif(source, ''), 'filled') AS source FROM sessions""")
def merge_sessions_incremental(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    new = s.withColumns(
        {
            "ended_at": F.coalesce("started_at", F.lit(0)) + 5000,
            "turn_count": F.col("turn_count") + 1,
            "title": F.lit("filled"),
            "source": F.lit("filled"),
        },
    )
    return ingest.merge_sessions(s, new, full=False).select("uuid", "ended_at", "turn_count", "title", "source")


_BLOCK_FIELD = "CASE name " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, (_, f) in schema.TOOL_FIELDS.items()) + " END"
_BLOCK_KIND = "CASE name " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in schema.TOOL_FIELDS.items()) + " END"


@query("backfill_targets", f"""
WITH c AS (SELECT id, session_uuid, seq, ts, coalesce(raw_json, '') AS raw FROM messages WHERE role = 'tool_use' AND session_uuid IN (SELECT uuid FROM sessions WHERE source IS NULL OR source = 'claude-code')),
s AS (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) OVER w THEN 1 ELSE 0 END AS start FROM c WINDOW w AS (PARTITION BY session_uuid ORDER BY seq NULLS FIRST, id)),
r AS (SELECT *, sum(start) OVER (PARTITION BY session_uuid ORDER BY seq NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS run FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY session_uuid, run ORDER BY seq NULLS FIRST, id) - 1 AS place, CASE WHEN json_valid(raw) THEN raw::JSON->'$.message.content' END AS content FROM r),
b AS (SELECT id, session_uuid, ts, place, list_filter(json_extract(content, '$[*]'), lambda x: x->>'$.type' = 'tool_use' AND NOT starts_with(coalesce(x->>'$.name', ''), '{schema.OWN_TOOLS}')) AS blocks FROM p WHERE json_type(content) = 'ARRAY'),
k AS (SELECT id, session_uuid, ts, blocks[place % len(blocks) + 1] AS b FROM b WHERE len(blocks) > 0 AND id NOT IN (SELECT message_id FROM tool_calls JOIN messages m ON m.id = message_id WHERE message_id % 2 = 0)),
n AS (SELECT *, b->>'$.name' AS name FROM k WHERE b->>'$.name' <> ''),
v AS (SELECT id, session_uuid, ts, {_BLOCK_KIND} AS kind, CASE WHEN json_type(b, '$.input.' || {_BLOCK_FIELD}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string(b, '$.input.' || {_BLOCK_FIELD}) END AS value FROM n)
SELECT id AS message_id, session_uuid, ts, 'tool' AS kind, name AS value FROM n UNION ALL SELECT id, session_uuid, ts, kind, value FROM v WHERE kind IS NOT NULL AND trim(value) <> ''""")
def backfill_targets(spark: SparkSession, d: str) -> DataFrame:
    """Facts for every message of the default source whose call isn't recorded; here those with an even id are."""
    data, recorded = _data(spark, d), table(spark, d, "tool_calls").where("message_id % 2 = 0").select("message_id")
    return ingest.backfill_targets(data.messages, recorded, data.sessions)


@query("reset_subagents", "SELECT DISTINCT source_file FROM event_lines WHERE NOT contains(source_file, '/subagents/')")
def reset_subagents(spark: SparkSession, d: str) -> DataFrame:
    return ingest.reset_subagents(table(spark, d, "event_lines").select("source_file").distinct())


@query(
    "subagent_paths",
    r"""SELECT DISTINCT source_file, regexp_extract(source_file, '([^/]+)\.jsonl$', 1) AS stem, regexp_matches(source_file, '(^|/)subagents/agent-[^/]*\.jsonl$') AS child, regexp_extract(source_file, '([^/]+)/subagents/[^/]+$', 1) AS parent FROM event_lines""",
)
def subagent_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_file")
    return table(spark, d, "event_lines").select(
        p, files.file_stem(p).alias("stem"), files.is_subagent(p).alias("child"), files.subagent_parent(p).alias("parent")
    ).distinct()


@query(
    "rollout_ids",
    r"""SELECT DISTINCT source_file, regexp_extract(source_file, '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$', 1) AS id FROM rollout_lines""",
)
def rollout_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rollout_lines").select("source_file", files.last_uuid(F.col("source_file")).alias("id")).distinct()


@query(
    "current_lines",
    "SELECT source_file, line_no, max_by(line_id, (batch_no, line_id)) AS line_id FROM rollout_lines GROUP BY 1, 2",
)
def current_lines(spark: SparkSession, d: str) -> DataFrame:
    return _rollouts(spark, d).select("source_file", "line_no", "line_id")


@query(
    "merge_quota",
    "SELECT source, limit_id, max(observed_at) AS observed_at FROM (SELECT coalesce(nullif(source, ''), 'claude-code') AS source, coalesce(project_path, '') AS limit_id, coalesce(ended_at, 0) AS observed_at FROM sessions) GROUP BY 1, 2",
)
def merge_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.default_source(table(spark, d, "sessions")).select(
        "source", F.coalesce("project_path", F.lit("")).alias("limit_id"), F.coalesce("ended_at", F.lit(0)).alias("observed_at")
    )
    return ingest.merge_quota(rows.where("observed_at % 2 = 0"), rows.where("observed_at % 2 = 1"))


@query(
    "drill_down_sessions",
    f"WITH {TARGETS} SELECT DISTINCT s.uuid, s.title FROM sessions s WHERE {DEFAULT} AND uuid IN (SELECT session_uuid FROM tt WHERE kind = 'tool' AND value = 'WebFetch')",
)
def drill_down_sessions(spark: SparkSession, d: str) -> DataFrame:
    data = _data(spark, d)
    acted = sessions.acted_sessions(data.tool_targets, tool="WebFetch")[0]
    return data.sessions.where(expr.of_source(F.col("source"), "")).join(
        acted, F.col("uuid") == F.col("acted"), "left_semi"
    ).select("uuid", "title").distinct()


@query("tool_targets_all", f"WITH {TARGETS} SELECT message_id, session_uuid, kind, {_capped('value', 512)} AS value FROM tt")
def tool_targets_all(spark: SparkSession, d: str) -> DataFrame:
    return _data(spark, d).tool_targets.select("message_id", "session_uuid", "kind", "value")


# --- functions ----------------------------------------------------------------------------------


@query(
    "estimate_tokens",
    f"WITH m AS (SELECT id, coalesce(content, '') AS c FROM messages), k AS (SELECT id, c, length(regexp_replace(c, '[^㐀-䶿一-鿿]', '', 'g')) AS w FROM m) SELECT id, w + cast(ceil((length(c) - w) / 4.0) AS BIGINT) AS tokens FROM k",
)
def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", expr.estimate_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))


@query(
    "truncate_excerpt",
    "SELECT id, CASE WHEN length(content) > 600 THEN substr(content, 1, 600) || '…' ELSE content END AS excerpt FROM messages",
)
def truncate_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", expr.truncate(F.col("content"), schema.EXCERPT_CHARS).alias("excerpt"))


_T = f"trim(content, '{expr.WHITE_SPACE}')"


def _behind(opening: str, closing: str) -> str:
    return f"WHEN starts_with(t, '{opening}') THEN substr(CASE WHEN strpos(t, '{closing}') > 0 THEN trim(substr(t, strpos(t, '{closing}') + {len(closing)}), '{expr.WHITE_SPACE}') ELSE '' END, 1, 100)"


@query("title_from", f"""
WITH u AS (SELECT id, {_T} AS t FROM messages WHERE role = 'user' AND content IS NOT NULL)
SELECT id, CASE WHEN starts_with(t, '<command-') AND regexp_matches(t, '(?s)<command-name>.*?</command-name>') THEN trim(regexp_extract(t, '(?s)<command-name>(.*?)</command-name>', 1), '{expr.WHITE_SPACE}')
  {_behind('<local-command-caveat', '</local-command-caveat>')} {_behind('<task-notification', '</task-notification>')} {_behind('[Request interrupted', ']')} ELSE substr(t, 1, 100) END AS title FROM u""")
def title_from(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("role = 'user' and content is not null")
    return m.select("id", expr.title(F.col("content")).alias("title"))


@query("first_line", f"WITH l AS (SELECT id, split_part(content, chr(10), 1) AS l FROM messages) SELECT id, {_capped('l', 200)} AS line FROM l")
def first_line(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every message, at most 200 bytes of UTF-8."""
    return table(spark, d, "messages").select("id", expr.first_line(F.col("content")).alias("line"))


_SPAN = "(ended_at - started_at)"


@query("display_forms", f"""SELECT uuid, substr(uuid, 1, 8) AS short, CASE WHEN coalesce(project_path, '') = '' THEN '(unknown)' WHEN regexp_extract(project_path, '/([^/]+)$', 1) <> '' THEN regexp_extract(project_path, '/([^/]+)$', 1) ELSE project_path END AS project,
CASE WHEN coalesce(ended_at, 0) = 0 THEN '' ELSE strftime(to_timestamp(ended_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') END AS ended,
CASE WHEN length(replace(trim(title), chr(10), ' ')) > 40 THEN substr(replace(trim(title), chr(10), ' '), 1, 40) || '…' ELSE replace(trim(title), chr(10), ' ') END AS line,
CASE WHEN {_SPAN} < 3600 THEN floor({_SPAN} / 60)::BIGINT || 'm' WHEN {_SPAN} < 172800 THEN floor({_SPAN} / 3600)::BIGINT || 'h' ELSE floor({_SPAN} / 86400)::BIGINT || 'd' END AS span,
CASE WHEN regexp_matches(source_file, '^[A-Za-z0-9_./:=@%+,-]+$') THEN source_file ELSE chr(39) || replace(source_file, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END AS quoted FROM sessions""")
def display_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select(
        "uuid",
        display.short_id(F.col("uuid")).alias("short"),
        display.project_name(F.col("project_path")).alias("project"),
        display.minute_of(F.col("ended_at")).alias("ended"),
        display.one_line(F.col("title"), 40).alias("line"),
        display.human_span(F.col("ended_at") - F.col("started_at")).alias("span"),
        display.shell_quoted(F.col("source_file")).alias("quoted"),
    )


@query("recency_bonus", f"SELECT id, round({_RECENCY}, 9) AS bonus FROM messages")
def recency_bonus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", F.round(expr.recency(F.col("ts"), AS_OF), 9).alias("bonus"))


@query("since_window", f"SELECT id FROM messages WHERE ts >= {SINCE_SQL} AND role IN ('user', 'assistant')")
def since_window(spark: SparkSession, d: str) -> DataFrame:
    return search._scoped(_data(spark, d), SearchFilter(since=SINCE, source="all")).select("id")


@query("redact_shapes", f"SELECT id, redacted FROM (SELECT id, content, {_redacted('content')} AS redacted FROM messages) WHERE content <> redacted")
def redact_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("id", "content", redact.redact_shapes(F.col("content")).alias("redacted"))
    return m.where("content <> redacted").select("id", "redacted")


@query("redact_json_structural")
def redact_json_structural(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("raw_json is not null").select(
        "id", redact.redact_line(F.col("raw_json")).alias("redacted")
    )


@query("canonical_categories", """
SELECT session_uuid, model, '{' || coalesce(array_to_string(list_transform(list_sort(json_keys(categories_json)), lambda k: to_json(k)::VARCHAR || ':' || json_extract_string(categories_json, '$."' || k || '"')), ','), '') || '}' AS categories_json
FROM session_usage WHERE categories_json IS NOT NULL AND json_valid(categories_json) AND json_type(categories_json) = 'OBJECT'""")
def canonical_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d, F.col("m").isNotNull())


def _categories(spark: SparkSession, d: str, wanted: Column) -> DataFrame:
    u = table(spark, d, "session_usage").where("categories_json is not null").withColumn(
        "m", F.from_json("categories_json", "map<string,bigint>")
    ).where(wanted)
    return u.select(
        "session_uuid", "model", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("m")))).alias("categories_json")
    )


# --- checks -------------------------------------------------------------------------------------


@query(
    "doctor_orphans",
    "SELECT 'orphan sessions' AS name, count(*) = 0 AS ok, count(*) AS n FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.session_uuid = s.uuid)",
)
def doctor_orphans(spark: SparkSession, d: str) -> DataFrame:
    return doctor.orphan_sessions(_data(spark, d))


@query(
    "doctor_usage_coverage", "SELECT 'usage coverage' AS name, true AS ok, count(DISTINCT session_uuid) AS n FROM session_usage"
)
def doctor_usage_coverage(spark: SparkSession, d: str) -> DataFrame:
    return doctor.usage_coverage(_data(spark, d))


@query(
    "doctor_stale",
    f"WITH {STATE} SELECT 'usage diagnostics' AS name, sum(usage_stale) = 0 AS ok, sum(usage_stale)::BIGINT AS n FROM st",
)
def doctor_stale(spark: SparkSession, d: str) -> DataFrame:
    return doctor.stale_usage(_data(spark, d))


@query("doctor_reconcile", """
WITH c AS (SELECT floor(avg(batch_no)) AS cut FROM event_lines), o AS (SELECT source_file, max(line_no) AS off FROM event_lines, c WHERE batch_no <= cut GROUP BY 1), n AS (SELECT source_file, max(line_no) AS size FROM event_lines, c WHERE batch_no > cut GROUP BY 1)
SELECT CASE WHEN size IS NULL THEN 'missing' WHEN size < off THEN 'truncated' WHEN size > off THEN 'lagging' ELSE 'current' END AS status, count(*) AS n FROM o LEFT JOIN n ON o.source_file = n.source_file GROUP BY 1""")
def doctor_reconcile(spark: SparkSession, d: str) -> DataFrame:
    old, new = _states(spark, d)
    return doctor.reconcile(new.select("source_file", F.col("last_size").alias("size")), old, ["/var"])


_LANDED = ("event_lines", "rollout_lines", "chat_lines")


def _landed(spark: SparkSession, d: str, column: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, t).select(column) for t in _LANDED])


@query(
    "doctor_unparsed",
    f"SELECT 'unparsed lines' AS name, count(*) = 0 AS ok, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT raw_line FROM {t}' for t in _LANDED)}) WHERE raw_line IS NULL OR NOT json_valid(raw_line)",
)
def doctor_unparsed(spark: SparkSession, d: str) -> DataFrame:
    return doctor.unparsed_lines(_landed(spark, d, "raw_line"))


@query(
    "doctor_repeated",
    "SELECT 'repeated messages' AS name, sum(k - 1) = 0 AS ok, sum(k - 1)::BIGINT AS n FROM (SELECT count(*) AS k FROM messages GROUP BY session_uuid, seq)",
)
def doctor_repeated(spark: SparkSession, d: str) -> DataFrame:
    return doctor.repeated_messages(_data(spark, d))


@query("doctor_coverage", r"""
WITH f AS (SELECT source_file, 0 AS t FROM event_lines UNION ALL SELECT source_file, 0 FROM rollout_lines UNION ALL SELECT source_file, 0 FROM chat_lines UNION ALL SELECT source_file, 1 FROM event_lines),
c AS (SELECT source_file, t, CASE WHEN regexp_matches(source_file, '(^|/)rollout-[^/]*\.jsonl$') THEN 'codex' WHEN regexp_matches(source_file, '/chats/session-[^/]*\.jsonl$') THEN 'gemini' ELSE 'claude-code' END AS source FROM f)
SELECT source, count(DISTINCT source_file) FILTER (WHERE t = 0) AS on_disk, count(DISTINCT source_file) FILTER (WHERE t = 1) AS tracked, count(DISTINCT source_file) FILTER (WHERE t = 1) >= count(DISTINCT source_file) FILTER (WHERE t = 0) AS ok FROM c GROUP BY 1""")
def doctor_coverage(spark: SparkSession, d: str) -> DataFrame:
    return doctor.coverage_by_source(
        _landed(spark, d, "source_file").distinct(), table(spark, d, "event_lines").select("source_file").distinct()
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
