"""Adapters from transcript lines to sessions, messages, usage and rate-limit snapshots.

Each takes lines (source_file, line_no, raw_line), one copy of each, and stays in the JVM:
lines are parsed once to variants, blocks are exploded, and sequence numbers are given by
blocks of lines.  Content is redacted by its shape; the raw line by names and shapes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import expr, redact
from threadloom.operators import change_feed
from threadloom.operators.sequence import number_rows
from threadloom.sources import files

#: Counters of each format and their columns; others go to the categories.
EVENT_COUNTERS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_read_input_tokens": "cache_read",
    "cache_creation_input_tokens": "cache_creation",
}
ROLLOUT_COUNTERS = {
    "input_tokens": "input_tokens",
    "cached_input_tokens": "cache_read",
    "output_tokens": "output_tokens",
    "reasoning_output_tokens": "reasoning",
    "total_tokens": "total_tokens",
}
CHAT_COUNTERS = {
    "input": "input_tokens",
    "output": "output_tokens",
    "cached": "cache_read",
    "thoughts": "reasoning",
    "tool": "tool",
    "total": "total_tokens",
}
COUNTERS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "reasoning", "tool", "total_tokens")
#: A tool's fields in the order in which one becomes its summary.
SUMMARY_FIELDS = ("command", "file_path", "path", "pattern", "query", "url", "description")
MESSAGE = [
    "source_file",
    "session_uuid",
    "seq",
    "line_no",
    "ts",
    "role",
    "content",
    "raw_line",
    "tool_name",
    "summary",
    "acted_kind",
    "acted_value",
]


def text_at(v: str, path: str) -> Column:
    """A JSON string at a path; null for anything else."""
    return F.expr(
        f"CASE WHEN schema_of_variant(try_variant_get({v}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END",
    )


def seconds(text: Column) -> Column:
    """Unix seconds of an RFC 3339 time, its fraction cut off; 0 for anything else."""
    exact = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(F.when(exact, F.floor(F.unix_micros(F.try_to_timestamp(text)) / 1_000_000)), F.lit(0)).cast("bigint")


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select(
        "source_file", "line_no", "raw_line", F.expr("try_parse_json(raw_line)").alias("v")
    ).where("v is not null")


def _first(value: Column, order: Column) -> Column:
    """The first value by ``order`` that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value != ""), order))


def _span(ts: Column) -> list[Column]:
    return [F.min(F.when(ts > 0, ts)).alias("started_at"), F.max(F.when(ts > 0, ts)).alias("ended_at")]


def _summary(v: str) -> Column:
    return F.coalesce(*[F.nullif(text_at(v, f"$.{f}"), F.lit("")) for f in SUMMARY_FIELDS], F.lit(""))


# --- append-only events -------------------------------------------------------------------------


def event_blocks(lines: DataFrame) -> DataFrame:
    """One row per content block of user and assistant events that says something, in order.

    Results of the engine's own tools are left out with their calls, wherever in the file they stand.
    """
    v = parsed(lines).select(
        "source_file",
        "line_no",
        "raw_line",
        text_at("v", "$.type").alias("type"),
        seconds(text_at("v", "$.timestamp")).alias("ts"),
        F.expr("try_variant_get(v, '$.message.content', 'variant')").alias("c"),
    )
    v = v.where(F.col("type").isin("user", "assistant") & F.col("c").isNotNull())
    one = F.expr(
        "CASE WHEN schema_of_variant(c) = 'STRING' THEN array(to_variant_object(named_struct('type', 'text', 'text', try_variant_get(c, '$', 'string')))) END",
    )
    many = F.expr("try_variant_get(c, '$', 'array<variant>')")
    b = v.select("source_file", "line_no", "raw_line", "type", "ts", F.posexplode(F.coalesce(one, many)).alias("block_no", "b"))
    kind = text_at("b", "$.type")
    result = F.coalesce(
        text_at("b", "$.content"),
        F.expr(
            "array_join(transform(filter(try_variant_get(b, '$.content', 'array<variant>'), x -> try_variant_get(x, '$.text', 'string') <> ''), x -> try_variant_get(x, '$.text', 'string')), '\n')",
        ),
    )
    b = b.select(
        "source_file", "line_no", "block_no", "raw_line", "ts", kind.alias("kind"), text_at("b", "$.name").alias("tool_name"), F.coalesce(
            text_at("b", "$.id"), text_at("b", "$.tool_use_id")
        ).alias("tool_id"),
        F.when(kind == "text", F.col("type")).otherwise(kind).alias("role"), expr.first_line(
            _summary("variant_get(b, '$.input', 'variant')")
        ).alias("summary"),
        F.when(kind == "text", text_at("b", "$.text")).when(
            kind == "thinking", text_at("b", "$.thinking")
        ).when(kind == "tool_result", result).alias("body"),
        _acted("variant_get(b, '$.input', 'variant')", text_at("b", "$.name")).alias("acted")
    ).where(F.col("kind").isin("text", "thinking", "tool_use", "tool_result"))
    own = b.where(
        (F.col("kind") == "tool_use") & F.col("tool_name").startswith(schema.OWN_TOOLS)
    ).select("source_file", "tool_id").distinct()
    b = b.join(own, ["source_file", "tool_id"], "left_anti")
    content = F.trim(
        F.when(F.col("kind") == "tool_use", F.concat_ws(" ", "tool_name", "summary")).otherwise(F.coalesce("body", F.lit("")))
    )
    return b.withColumn("content", content).where((F.col("content") != "") | (F.col("kind") == "tool_use"))


def _acted(v: str, name: Column) -> Column:
    """What a tool acted on: (kind, value) of the field that its name calls for."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for tool, (kind, field) in schema.TOOL_FIELDS.items():
        value = text_at(v, f"$.{field}")
        out = F.when(
            (name == tool) & (F.trim(value) != ""), F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        ).otherwise(out)
    return out


def _messages(blocks: DataFrame, session: Column) -> DataFrame:
    rows = number_rows(blocks, ["source_file"], "line_no", ["block_no"])
    called = F.col("role") == "tool_use"
    return rows.select(
        "source_file", session.alias("session_uuid"), "seq", "line_no", "ts", "role", expr.clip_middle(redact.redact_content(F.col("content"))).alias("content"), "raw_line",
        F.when(called, F.col("tool_name")).alias("tool_name"), F.when(called, redact.redact_shapes(F.col("summary"))).alias("summary"), F.when(called, F.col("acted.kind")).alias("acted_kind"), F.when(
            called, expr.cap_bytes(redact.redact_shapes(F.col("acted.value")), schema.TARGET_BYTES)
        ).alias("acted_value")
    )


def event_messages(lines: DataFrame) -> DataFrame:
    return _messages(event_blocks(lines), files.file_stem(F.col("source_file")))


def event_sessions(lines: DataFrame) -> DataFrame:
    """A row per file, also for files without a message: span, project, title, parent and agent."""
    v = parsed(lines)
    ts = seconds(text_at("v", "$.timestamp"))
    heads = v.groupBy("source_file").agg(
        *_span(ts),
        _first(text_at("v", "$.cwd"), F.col("line_no")).alias("cwd"),
        _first(text_at("v", "$.sessionId"), F.col("line_no")).alias("line_session"),
        _first(text_at("v", "$.attributionAgent"), F.col("line_no")).alias("agent"),
    )
    said = event_blocks(lines).where("role = 'user' and kind = 'text'").withColumn(
        "title", expr.title(redact.redact_shapes(F.col("content")))
    )
    titles = said.groupBy("source_file").agg(_first(F.col("title"), F.struct("line_no", "block_no")).alias("title"))
    path, child = F.col("source_file"), files.is_subagent(F.col("source_file"))
    out = heads.join(titles, "source_file", "left")
    return out.select(
        files.file_stem(path).alias("uuid"), F.coalesce("cwd", files.project_of_path(path)).alias("project_path"), "source_file", "started_at", "ended_at", "title",
        F.when(
            child, F.coalesce("line_session", files.subagent_parent(path))
        ).alias("parent_session"), F.when(child, F.col("agent")).alias("agent_type"), F.lit("claude-code").alias("source")
    )


# --- rollouts -----------------------------------------------------------------------------------


def _texts(v: str, skip_wrappers: bool) -> Column:
    """The texts of an array of blocks that say something, joined by line ends."""
    drop = " AND NOT trim(t) RLIKE '^<environment_context|^<[^>]+_instructions>'" if skip_wrappers else ""
    return F.expr(
        f"trim(array_join(filter(transform(try_variant_get(payload, '$.{v}', 'array<variant>'), b -> try_variant_get(b, '$.text', 'string')), t -> trim(t) <> ''{drop}), '\n'))",
    )


def _script() -> Column:
    """The script of a shell call: the text itself, what follows the command flag of a shell, or all words."""
    return F.expr(
        """CASE WHEN schema_of_variant(try_variant_get(args, '$.command', 'variant')) = 'STRING' THEN trim(try_variant_get(args, '$.command', 'string'))
        ELSE CASE WHEN element_at(split(get(try_variant_get(args, '$.command', 'array<string>'), 0), '/'), -1) IN ('bash', 'sh', 'zsh', 'dash', 'ksh')
                   AND exists(slice(try_variant_get(args, '$.command', 'array<string>'), 2, 1000000), f -> f RLIKE '^-([^-].*)?c$')
             THEN trim(coalesce(get(try_variant_get(args, '$.command', 'array<string>'), 1 + cast(array_position(transform(slice(try_variant_get(args, '$.command', 'array<string>'), 2, 1000000), f -> f RLIKE '^-([^-].*)?c$'), true) AS int)), ''))
             ELSE trim(array_join(try_variant_get(args, '$.command', 'array<string>'), ' ')) END END"""
    )


def rollout_items(lines: DataFrame) -> DataFrame:
    v = parsed(lines).where("raw_line like '%response_item%'").select(
        "source_file",
        "line_no",
        "raw_line",
        text_at("v", "$.type").alias("type"),
        seconds(text_at("v", "$.timestamp")).alias("ts"),
        F.expr("try_variant_get(v, '$.payload', 'variant')").alias("payload"),
    )
    v = v.where("type = 'response_item'").withColumn("kind", text_at("payload", "$.type")).withColumn(
        "args", F.expr("try_parse_json(try_variant_get(payload, '$.arguments', 'string'))")
    )
    v = v.withColumn("name", text_at("payload", "$.name")).withColumn(
        "call_id", F.coalesce(text_at("payload", "$.call_id"), F.lit(""))
    )
    own = v.where(
        (F.col("kind") == "function_call") & F.col("name").startswith(schema.OWN_TOOLS)
    ).select("source_file", "call_id").distinct()
    v = v.join(own, ["source_file", "call_id"], "left_anti")
    command = F.nullif(
        F.when(F.col("name") == "exec_command", F.trim(text_at("args", "$.cmd"))).when(F.col("name") == "shell", _script()),
        F.lit(""),
    )
    image = F.nullif(F.when(F.col("name") == "view_image", F.trim(text_at("args", "$.path"))), F.lit(""))
    v = v.withColumn("command", command).withColumn("image", image)
    said = text_at("payload", "$.role")
    output = F.coalesce(
        text_at("payload", "$.output"), _texts("output", False), F.expr("try_variant_get(payload, '$.output.output', 'string')")
    )
    role = F.when(
        (F.col("kind") == "message") & said.isin("user", "assistant"), said
    ).when(F.col("kind") == "reasoning", "thinking").when(F.col("kind") == "function_call", "tool_use").when(
        F.col("kind") == "function_call_output", "tool_result"
    )
    summary = expr.first_line(F.coalesce("command", "image", F.lit("")))
    body = F.when(role == "user", _texts("content", True)).when(role == "assistant", _texts("content", False)).when(role == "thinking", _texts("summary", False)).when(
        role == "tool_use", F.concat_ws(" ", "name", summary)
    ).otherwise(output)
    rows = v.select(
        "source_file",
        "line_no",
        F.lit(0).alias("block_no"),
        "raw_line",
        "ts",
        "kind",
        role.alias("role"),
        F.trim(F.coalesce(body, F.lit(""))).alias("content"),
        F.col("name").alias("tool_name"),
        summary.alias("summary"),
        F.when(
            F.col("command").isNotNull(), F.struct(F.lit("command").alias("kind"), F.col("command").alias("value"))
        ).when(F.col("image").isNotNull(), F.struct(F.lit("file").alias("kind"), F.col("image").alias("value"))).alias("acted"),
    )
    return rows.where(F.col("role").isNotNull() & ((F.col("content") != "") | (F.col("role") == "tool_use")))


def rollout_messages(lines: DataFrame) -> DataFrame:
    return _messages(rollout_items(lines), files.last_uuid(F.col("source_file")))


def rollout_sessions(lines: DataFrame) -> DataFrame:
    v = parsed(lines)
    kind = text_at("v", "$.type")
    cwd = F.when(kind.isin("session_meta", "turn_context"), text_at("v", "$.payload.cwd"))
    heads = v.groupBy("source_file").agg(
        *_span(seconds(text_at("v", "$.timestamp"))),
        _first(cwd, F.col("line_no")).alias("project_path"),
        _first(F.when(kind == "session_meta", text_at("v", "$.payload.id")), F.col("line_no")).alias("meta_id"),
    )
    said = rollout_items(lines).where("role = 'user'").withColumn("title", expr.title(redact.redact_shapes(F.col("content"))))
    titles = said.groupBy("source_file").agg(_first(F.col("title"), F.col("line_no")).alias("title"))
    own = files.last_uuid(F.col("source_file"))
    out = heads.join(titles, "source_file", "left")
    return out.select(
        F.when(own != "", own).otherwise(F.coalesce("meta_id", F.lit(""))).alias("uuid"),
        "project_path",
        "source_file",
        "started_at",
        "ended_at",
        "title",
        F.lit(None).cast("string").alias("parent_session"),
        F.lit(None).cast("string").alias("agent_type"),
        F.lit("codex").alias("source"),
    )


# --- op-log chats -------------------------------------------------------------------------------


def chat_state(landed: DataFrame) -> DataFrame:
    """(source_file, pos, msg_id, line_no, ts, type, content, model, tokens) of the live messages."""
    live = change_feed.live_messages(landed)
    v = parsed(files.current_lines(landed))
    listed = v.select(
        "source_file", "line_no", F.expr("""posexplode(try_variant_get(v, '$["$set"].messages', 'array<variant>')) AS (at, m)""")
    )
    objects = listed.where("try_variant_get(m, '$', 'map<string,variant>') is not null")
    single = v.where("""variant_get(v, '$["$set"]', 'variant') is null""").select(
        "source_file", "line_no", F.lit(0).alias("at"), F.col("v").alias("m")
    )
    bodies = number_rows(objects, ["source_file", "line_no"], "at", [], "ord").drop("at").unionByName(
        single.select("source_file", "line_no", "m", F.lit(0).cast("bigint").alias("ord"))
    )
    rows = live.join(bodies, ["source_file", "line_no", "ord"])
    joined = F.expr(
        "trim(array_join(filter(transform(try_variant_get(m, '$.content', 'array<variant>'), b -> try_variant_get(b, '$.text', 'string')), t -> trim(t) <> ''), '\n'))",
    )
    return rows.select(
        "source_file",
        "pos",
        "msg_id",
        "line_no",
        seconds(text_at("m", "$.timestamp")).alias("ts"),
        text_at("m", "$.type").alias("type"),
        F.coalesce(joined, text_at("m", "$.content"), F.lit("")).alias("content"),
        F.coalesce(text_at("m", "$.model"), F.lit("")).alias("model"),
        F.expr("try_variant_get(m, '$.tokens', 'variant')").alias("tokens"),
    )


def chat_messages(landed: DataFrame) -> DataFrame:
    """Turns of the live messages; those of other types and without text are left out."""
    rows = chat_state(landed).where(F.col("type").isin("user", "gemini"))
    rows = rows.withColumn(
        "content", F.when(F.col("type") == "user", expr.strip_context(F.col("content"))).otherwise(F.trim("content"))
    ).where("content <> ''")
    rows = number_rows(rows, ["source_file"], "pos", [])
    return rows.select(
        "source_file",
        "seq",
        "line_no",
        "ts",
        F.when(F.col("type") == "user", "user").otherwise("assistant").alias("role"),
        expr.clip_middle(redact.redact_content(F.col("content"))).alias("content"),
    )


def chat_sessions(landed: DataFrame) -> DataFrame:
    """A row per file whose first line names a session; the project is the identifier in its path."""
    v = parsed(files.current_lines(landed.where("line_no = 1")))
    heads = v.select("source_file", text_at("v", "$.sessionId").alias("uuid")).where("uuid <> ''")
    state = chat_state(landed)
    said = F.when(F.col("type") == "user", expr.title(redact.redact_shapes(expr.strip_context(F.col("content")))))
    spans = state.groupBy("source_file").agg(*_span(F.col("ts")), _first(said, F.col("pos")).alias("title"))
    none = F.lit(None).cast("string")
    out = heads.join(spans, "source_file", "left")
    return out.select(
        "uuid",
        files.chat_project_id(F.col("source_file")).alias("project_path"),
        "source_file",
        "started_at",
        "ended_at",
        "title",
        none.alias("parent_session"),
        none.alias("agent_type"),
        F.lit("gemini").alias("source"),
    )


# --- usage --------------------------------------------------------------------------------------


def _numbers(usage: str) -> Column:
    """The whole numbers of an object by name; null counts as 0, other values are ignored."""
    keep = "CASE WHEN schema_of_variant(x) = 'BIGINT' THEN try_variant_get(x, '$', 'bigint') WHEN is_variant_null(x) THEN 0L END"
    return F.expr(
        f"map_filter(transform_values(try_variant_get({usage}, '$', 'map<string,variant>'), (k, x) -> {keep}), (k, n) -> n IS NOT NULL)",
    )


def _usage_rows(counts: DataFrame, canon: dict[str, str], derive_total: bool) -> DataFrame:
    """Sums per (source_file, model): known counters as columns, the others as sorted JSON; rows of zeros are dropped."""
    flat = counts.select(
        "source_file",
        F.when(F.col("model") == "", schema.UNKNOWN_MODEL).otherwise(
            F.coalesce("model", F.lit(schema.UNKNOWN_MODEL))
        ).alias("model"),
        F.explode("numbers").alias("name", "n"),
    )
    sums = flat.groupBy("source_file", "model", "name").agg(F.sum("n").alias("n"))
    wide = sums.groupBy("source_file", "model").agg(
        *[F.coalesce(F.sum(F.when(F.col("name").isin([k for k, v in canon.items() if v == c] or ["\u0000"]), F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS],
        F.array_sort(F.collect_list(F.when(~F.col("name").isin(list(canon)), F.struct("name", "n")))).alias("others"),
    )
    if derive_total:
        wide = wide.withColumn(
            "total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_creation")
        )
    wide = wide.withColumn("categories_json", F.when(F.size("others") > 0, F.to_json(F.map_from_entries("others"))))
    return wide.where(F.col("categories_json").isNotNull() | F.greatest(*[F.abs(c) for c in COUNTERS]).__gt__(0)).drop("others")


def event_usage(lines: DataFrame) -> DataFrame:
    """Usage per file and model: of each event uuid the last line counts, also where it carries none."""
    v = parsed(lines.where("raw_line like '%assistant%'")).where(text_at("v", "$.type") == "assistant")
    v = v.select(
        "source_file",
        "line_no",
        F.nullif(text_at("v", "$.uuid"), F.lit("")).alias("uuid"),
        text_at("v", "$.message.model").alias("model"),
        F.expr("try_variant_get(v, '$.message', 'variant')").alias("message"),
        _numbers("try_variant_get(v, '$.message.usage', 'variant')").alias("numbers"),
    )
    v = v.where("message is not null and not is_variant_null(message) and uuid is not null")
    last = v.groupBy("source_file", "uuid").agg(F.max_by(F.struct("model", "numbers"), "line_no").alias("u"))
    return _usage_rows(last.select("source_file", "u.model", "u.numbers").where("numbers is not null"), EVENT_COUNTERS, True)


def _token_counts(lines: DataFrame) -> DataFrame:
    v = parsed(lines.where("raw_line like '%token_count%'")).where(text_at("v", "$.type") == "event_msg").where(
        text_at("v", "$.payload.type") == "token_count"
    )
    return v.select(
        "source_file",
        "line_no",
        seconds(text_at("v", "$.timestamp")).alias("ts"),
        F.expr("try_variant_get(v, '$.payload.info.total_token_usage', 'variant')").alias("usage"),
        F.expr("try_variant_get(v, '$.payload.rate_limits', 'variant')").alias("limits"),
    )


def rollout_usage(lines: DataFrame) -> DataFrame:
    """The last cumulative counter of each file that has a total."""
    v = _token_counts(lines).withColumn("numbers", _numbers("usage")).where(F.map_contains_key("numbers", "total_tokens"))
    last = v.groupBy("source_file").agg(F.max_by("numbers", "line_no").alias("numbers"))
    return _usage_rows(last.withColumn("model", F.lit(schema.MIXED_MODEL)), ROLLOUT_COUNTERS, False)


def chat_usage(landed: DataFrame) -> DataFrame:
    """Tokens of the live messages that have a total, summed per file and model."""
    rows = chat_state(landed).withColumn("numbers", _numbers("tokens")).where(F.map_contains_key("numbers", "total"))
    return _usage_rows(rows.select("source_file", "model", "numbers"), CHAT_COUNTERS, False)


def _unmapped(numbers: Column, canon: dict[str, str]) -> Column:
    return F.size(F.map_filter(numbers, lambda k, _: ~k.isin(list(canon))))


def event_counters(lines: DataFrame) -> DataFrame:
    """(source_file, usage_skipped, usage_unmapped): assistant events without usage or uuid, and counters of unknown name that were summed."""
    v = parsed(lines.where("raw_line like '%assistant%'")).where(text_at("v", "$.type") == "assistant")
    v = v.select(
        "source_file", "line_no", F.nullif(text_at("v", "$.uuid"), F.lit("")).alias("uuid"),
        F.expr("try_variant_get(v, '$.message', 'map<string,variant>')").alias("message"),
        F.expr("try_variant_get(v, '$.message.usage', 'map<string,variant>')").alias("usage"), _numbers("try_variant_get(v, '$.message.usage', 'variant')").alias("numbers"),
    ).where("message is not null")
    lacks = F.col("usage").isNull() | (F.size("usage") == 0) | F.col("uuid").isNull()
    skipped = v.groupBy("source_file").agg(F.count(F.when(lacks, 1)).alias("usage_skipped"))
    last = v.where("uuid is not null").groupBy("source_file", "uuid").agg(F.max_by("numbers", "line_no").alias("numbers"))
    unmapped = last.groupBy("source_file").agg(F.coalesce(F.sum(_unmapped(F.col("numbers"), EVENT_COUNTERS)), F.lit(0)).alias("usage_unmapped"))
    return skipped.join(unmapped, "source_file", "full_outer").select("source_file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("usage_skipped", "usage_unmapped")])


def rollout_counters(lines: DataFrame) -> DataFrame:
    """The same of rollouts: token counts without a total, and the names of the last one that are unknown."""
    v = _token_counts(lines).withColumn("numbers", _numbers("usage"))
    total = F.coalesce(F.map_contains_key("numbers", "total_tokens"), F.lit(False))
    per = v.groupBy("source_file").agg(F.count(F.when(~total, 1)).alias("usage_skipped"), F.max_by("numbers", F.when(total, F.col("line_no"))).alias("numbers"))
    return per.select("source_file", "usage_skipped", F.coalesce(_unmapped(F.col("numbers"), ROLLOUT_COUNTERS), F.lit(0)).cast("bigint").alias("usage_unmapped"))


def chat_counters(landed: DataFrame) -> DataFrame:
    """The same of chats: live messages whose tokens have no total, or of the model without any."""
    rows = chat_state(landed).withColumn("numbers", _numbers("tokens"))
    total = F.coalesce(F.map_contains_key("numbers", "total"), F.lit(False))
    given = F.col("tokens").isNotNull() & ~F.coalesce(F.expr("is_variant_null(tokens)"), F.lit(False))
    skipped = F.when(given, ~total).otherwise(F.coalesce(F.col("type") == "gemini", F.lit(False)))
    return rows.groupBy("source_file").agg(
        F.count(F.when(skipped, 1)).alias("usage_skipped"),
        F.coalesce(F.sum(F.when(given & total, _unmapped(F.col("numbers"), CHAT_COUNTERS))), F.lit(0)).alias("usage_unmapped"),
    )


def quota_snapshots(lines: DataFrame) -> DataFrame:
    """The latest observation of each limit's windows; of those at one time the first in order of file and line."""
    v = _token_counts(lines).withColumn("limit", text_at("limits", "$.limit_id")).where("ts > 0 and limit <> ''")
    one = lambda w: F.when(F.expr(f"try_variant_get(limits, '$.{w}', 'map<string,variant>')").isNotNull(), F.struct(F.lit(w).alias("window"), F.expr(f"coalesce(try_variant_get(limits, '$.{w}.used_percent', 'double'), 0)").alias("used_percent"), F.expr(f"coalesce(try_variant_get(limits, '$.{w}.window_minutes', 'bigint'), 0)").alias("window_minutes"), F.expr(f"coalesce(try_variant_get(limits, '$.{w}.resets_at', 'bigint'), 0)").alias("resets_at")))
    rows = v.select(
        "source_file",
        "line_no",
        "ts",
        "limit",
        F.coalesce(text_at("limits", "$.plan_type"), F.lit("")).alias("plan_type"),
        F.explode(F.array(one("primary"), one("secondary"))).alias("w"),
    ).where("w is not null")
    key = F.concat_ws(":", "limit", "w.window")
    latest = rows.groupBy(key.alias("limit_id")).agg(
        F.min_by(F.struct("ts", "w", "plan_type"), F.struct(-F.col("ts"), "source_file", "line_no")).alias("q")
    )
    return latest.select(
        F.lit("codex").alias("source"),
        "limit_id",
        F.col("q.ts").alias("observed_at"),
        "q.w.used_percent",
        "q.w.window_minutes",
        "q.w.resets_at",
        "q.plan_type",
    )


# --- registry -----------------------------------------------------------------------------------


def no_counters(lines: DataFrame) -> DataFrame:
    """Of a format that doesn't say what its usage lacks."""
    return lines.select("source_file", F.lit(0).cast("bigint").alias("usage_skipped"), F.lit(0).cast("bigint").alias("usage_unmapped")).distinct()


@dataclass(frozen=True)
class Source:
    """A format: which files it owns and how their lines are read."""

    name: str
    messages: Callable[[DataFrame], DataFrame]
    sessions: Callable[[DataFrame], DataFrame]
    usage: Callable[[DataFrame], DataFrame]
    counters: Callable[[DataFrame], DataFrame] = no_counters
    whole_file: bool = False


REGISTRY: dict[str, Source] = {
    "codex": Source("codex", rollout_messages, rollout_sessions, rollout_usage, rollout_counters),
    "gemini": Source("gemini", chat_messages, chat_sessions, chat_usage, chat_counters, whole_file=True),
    "claude-code": Source("claude-code", event_messages, event_sessions, event_usage, event_counters),
}


def register(source: Source) -> None:
    """Add a format; the default one keeps the last place."""
    default = REGISTRY.pop(schema.DEFAULT_SOURCE)
    REGISTRY[source.name] = source
    REGISTRY[schema.DEFAULT_SOURCE] = default
