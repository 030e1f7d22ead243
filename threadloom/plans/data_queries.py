"""Queries of the general data problems (1, 3, 4, 5, 7) over the landed raw files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import change_feed, delivery, nested, schema_drift, timestamps
from threadloom.tables import table

CONVENTIONS = {"slash": "mdy", "dot": "dmy", "overlap": "earlier", "unit": "size"}


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, schema, ident in (("event_lines", "type STRING, uuid STRING, _bad STRING", "j.uuid"), ("rollout_lines", "type STRING, payload STRUCT<id: STRING>, _bad STRING", "j.payload.id")):
        rows = table(spark, sf_dir, name).select(
            "line_id", "batch_no", F.from_json("raw_line", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("j")
        )
        parts.append(
            rows.where("j._bad is null").select(
                F.lit(name).alias("src"), F.col("j.type").alias("type"), F.expr(ident).alias("ident"), "batch_no", "line_id"
            ),
        )
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _identified(spark, sf_dir)
    found = delivery.surplus_copies(rows, [F.col("src"), F.col("type"), F.col("ident")], F.col("batch_no"), F.col("line_id"))
    return found.select(F.col("row_id").alias("line_id"))


def p1_delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left: one copy of each message, with every line that has no identifier."""
    lines = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), "line_id") for t in ("event_lines", "rollout_lines")]
    return lines[0].unionByName(lines[1]).join(p1_found(spark, sf_dir), "line_id", "left_anti")


# --- 3: schemas ---------------------------------------------------------------------------------


def _variant(v: str, path: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'variant')")


def _chat_messages(lines: DataFrame) -> DataFrame:
    """(line_id, source_file, tokens): the tokens of every message of every physical line."""
    v = lines.where("line_no > 1").select(
        "line_id", "source_file", F.expr("try_parse_json(raw_line)").alias("v")
    ).where("v is not null")
    many = F.expr(
        """transform(try_variant_get(v, '$["$set"].messages', 'array<variant>'), m -> try_variant_get(m, '$.tokens', 'variant'))""",
    )
    one = F.when(_variant("v", '$["$set"]').isNull(), F.array(_variant("v", "$.tokens")))
    return v.select(
        "line_id", "source_file", F.posexplode(F.coalesce(one, many)).alias("at", "tokens")
    ).where("schema_of_variant(tokens) like 'OBJECT%'")


def _chat_versions(lines: DataFrame) -> DataFrame:
    """The version of each chat file; of several copies of its first line the last delivered that has one counts."""
    first = lines.where("line_no = 1").select(
        "source_file",
        "batch_no",
        "line_id",
        schema_drift.version_text(F.expr("try_variant_get(try_parse_json(raw_line), '$.cliVersion', 'string')")).alias("version"),
    )
    return first.where("version is not null").groupBy("source_file").agg(
        F.max_by("version", F.struct("batch_no", "line_id")).alias("version")
    )


def _records(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """(src, record, row_id, version, body) of the two sources that carry their version in the record."""
    events = table(spark, sf_dir, "event_lines").select("line_id", F.expr("try_parse_json(raw_line)").alias("v"))
    events = events.select(
        F.lit("claude-code").alias("src"),
        F.expr("try_variant_get(v, '$.type', 'string')").alias("record"),
        F.col("line_id").alias("row_id"),
        schema_drift.version_text(F.expr("try_variant_get(v, '$.version', 'string')")).alias("version"),
        F.col("v").alias("body"),
    )
    metas = table(spark, sf_dir, "rollout_lines").where("raw_line like '%session_meta%'").select(
        "line_id", F.expr("try_parse_json(raw_line)").alias("v")
    )
    metas = metas.where(
        "try_variant_get(v, '$.type', 'string') = 'session_meta'"
    ).select("line_id", _variant("v", "$.payload").alias("body"))
    metas = metas.select(
        F.lit("codex").alias("src"),
        F.lit("session_meta").alias("record"),
        F.col("line_id").alias("row_id"),
        schema_drift.version_text(
            F.expr(
                "coalesce(try_variant_get(body, '$.cli_version.semver', 'string'), try_variant_get(body, '$.cli_version', 'string'))",
            ),
        ).alias("version"),
        "body",
    )
    return [events, metas]


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [r.where("version is not null").select("src", "record", "version", F.expr("schema_of_variant(body)").alias("schema")).where("schema like 'OBJECT%'").distinct() for r in _records(spark, sf_dir)]
    chats = table(spark, sf_dir, "chat_lines")
    tokens = _chat_messages(chats).select("source_file", F.expr("schema_of_variant(tokens)").alias("schema")).distinct()
    tokens = tokens.join(_chat_versions(chats), "source_file").select(
        F.lit("gemini").alias("src"), F.lit("tokens").alias("record"), "version", "schema"
    ).distinct()
    return own[0].unionByName(own[1]).unionByName(tokens)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift_report(_schemas(spark, sf_dir), ignore=("timestamp",))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the three sources in one table with the last names and types."""
    from threadloom.shared import materialise

    chats = table(spark, sf_dir, "chat_lines")
    tokens = _chat_messages(chats).join(_chat_versions(chats), "source_file", "left")
    tokens = tokens.select(
        F.lit("gemini").alias("src"),
        F.lit("tokens").alias("record"),
        F.col("line_id").alias("row_id"),
        "version",
        F.col("tokens").alias("body"),
    )
    events, metas = _records(spark, sf_dir)
    records = events.unionByName(metas).unionByName(tokens).select(
        "src", "record", "row_id", "version", F.expr("try_variant_get(body, '$', 'map<string,variant>')").alias("fields")
    )
    return schema_drift.unify(
        records.where("fields is not null"), materialise(_schemas(spark, sf_dir), "schemas"), ignore=("timestamp",)
    )


# --- 4: change feed -----------------------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.live_messages(table(spark, sf_dir, "chat_lines")).select("source_file", "pos", "msg_id", "line_no")


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live messages with their columns, each column by its own last change."""
    return change_feed.message_rows(table(spark, sf_dir, "chat_lines"))


# --- 5: nested records --------------------------------------------------------------------------


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.holders(
        *[table(spark, sf_dir, t).select("line_id", "raw_line") for t in ("event_lines", "rollout_lines", "chat_lines")]
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.elements(_held(spark, sf_dir)).select("line_id", "child", "parent_ord", "ord")


def p5_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.descend(_held(spark, sf_dir))


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.stored(nested.descend(_held(spark, sf_dir), bodies=True))


# --- 7: timestamps ------------------------------------------------------------------------------


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "machines").select("machine", F.col("time_zone").alias("zone"))
    parts = []
    for name, field in (("event_lines", "timestamp"), ("rollout_lines", "timestamp"), ("chat_lines", "startTime")):
        rows = table(spark, sf_dir, name)
        if name == "chat_lines":
            rows = rows.where("line_no = 1")
        rows = rows.select(
            "line_id",
            "source_file",
            "line_no",
            "machine",
            F.from_json("raw_line", f"{field} STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("j"),
        ).where("j._bad is null")
        parts.append(
            rows.select(
                F.lit(name).alias("src"),
                F.col("line_id").alias("row_id"),
                "source_file",
                F.col("line_no").alias("pos"),
                "machine",
                F.col(f"j.{field}").alias("value"),
            ),
        )
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    plain = F.when(
        F.col("value").rlike(timestamps.PLAIN), F.unix_micros(F.try_to_timestamp("value", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    )
    plain = F.when(~F.col("value").startswith("0000"), plain)
    return lines.join(F.broadcast(zones), "machine", "left").select(
        "src", "row_id", F.concat_ws(":", "src", "source_file").alias("chain"), "pos", "value", "zone", plain.alias("plain_us")
    )


def _message_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").select("id", "session_uuid", "seq", "ts")
    whole = F.col("ts").between(1, 99_999_999_999)
    return rows.select(
        F.col("id").alias("row_id"),
        F.col("session_uuid").alias("chain"),
        F.col("seq").alias("pos"),
        F.col("ts").cast("string").alias("value"),
        F.lit(None).cast("string").alias("zone"),
        F.when(whole, F.col("ts") * 1_000_000).alias("plain_us"),
    )


def _resolved(spark: SparkSession, sf_dir: str, conventions: dict[str, str] = CONVENTIONS) -> DataFrame:
    lines = timestamps.resolve(_times(spark, sf_dir), conventions)
    src = F.element_at(
        F.array(F.lit("event_lines"), F.lit("rollout_lines"), F.lit("chat_lines")),
        (F.col("row_id") / 1_000_000_000_000).cast("int"),
    )
    return lines.withColumn("src", src).unionByName(
        timestamps.resolve(_message_times(spark, sf_dir), conventions).withColumn("src", F.lit("messages"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("not plain").select("src", "row_id", F.col("us").alias("utc_us"))


def p7_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant of every readable row, plain or not."""
    return _resolved(spark, sf_dir).select("src", "row_id", F.col("us").alias("utc_us"))


def p7_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that aren't plain, read without any stated convention: the order of the source alone decides."""
    return _resolved(spark, sf_dir, {}).where("not plain").select("src", "row_id", F.col("us").alias("utc_us"), "fmt")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_delivered_once, p3_found, p3_unified, p4_found, p4_messages, p5_found, p5_bridge, p5_nodes, p7_found, p7_normalised, p7_by_order)
    return {f.__name__: f for f in own}


_VALID = "(SELECT *, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM {})"
_NUMBERS = r"nullif(regexp_extract({}, '(\d+(?:\.\d+)+)', 1), '')"

_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_ISO = r"'^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([Zz]|UTC|[+-]\d{2}:?\d{2})?(?:\[([A-Za-z_/]+)\])?$'"
_BASIC = r"'^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$'"
_SLASH = r"'^(\d{2})/(\d{2})/(\d{4}) (\d{1,2}):(\d{2}):(\d{2}) ([AP]M)$'"
_DOT = r"'^(\d{2})\.(\d{2})\.(\d{4}) (\d{2}):(\d{2}):(\d{2})$'"
_MAIL = r"'^[A-Za-z]{3}, (\d{2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4})$'"
_CLOCK = r"'^[A-Za-z]{3} ([A-Za-z]{3}) (\d{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) GMT([+-]\d{4}) \(.*\)$'"
_G = "regexp_extract(v, {}, {})"


def _month(pattern: str, k: int) -> str:
    return f"lpad(cast(list_position({_MONTHS}, lower({_G.format(pattern, k)})) AS VARCHAR), 2, '0')"


def _p7_sql() -> str:
    g = lambda p, k: _G.format(p, k)
    wall = f"""CASE WHEN regexp_matches(v, {_ISO}) THEN {g(_ISO, 1)} || '-' || {g(_ISO, 2)} || '-' || {g(_ISO, 3)} || ' ' || {g(_ISO, 4)} || ':' || {g(_ISO, 5)} || ':' || CASE {g(_ISO, 6)} WHEN '' THEN '00' ELSE {g(_ISO, 6)} END
      WHEN regexp_matches(v, {_BASIC}) THEN {g(_BASIC, 1)} || '-' || {g(_BASIC, 2)} || '-' || {g(_BASIC, 3)} || ' ' || {g(_BASIC, 4)} || ':' || {g(_BASIC, 5)} || ':' || {g(_BASIC, 6)}
      WHEN regexp_matches(v, {_SLASH}) THEN {g(_SLASH, 3)} || '-' || {g(_SLASH, 1)} || '-' || {g(_SLASH, 2)} || ' ' || lpad(cast(cast({g(_SLASH, 4)} AS INT) % 12 + CASE {g(_SLASH, 7)} WHEN 'PM' THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' || {g(_SLASH, 5)} || ':' || {g(_SLASH, 6)}
      WHEN regexp_matches(v, {_DOT}) THEN {g(_DOT, 3)} || '-' || {g(_DOT, 2)} || '-' || {g(_DOT, 1)} || ' ' || {g(_DOT, 4)} || ':' || {g(_DOT, 5)} || ':' || {g(_DOT, 6)}
      WHEN regexp_matches(v, {_MAIL}) THEN {g(_MAIL, 3)} || '-' || {_month(_MAIL, 2)} || '-' || {g(_MAIL, 1)} || ' ' || {g(_MAIL, 4)}
      WHEN regexp_matches(v, {_CLOCK}) THEN {g(_CLOCK, 3)} || '-' || {_month(_CLOCK, 1)} || '-' || {g(_CLOCK, 2)} || ' ' || {g(_CLOCK, 4)} END"""
    zone = f"CASE WHEN regexp_matches(v, {_ISO}) THEN {g(_ISO, 8)} WHEN regexp_matches(v, {_BASIC}) THEN 'Z' WHEN regexp_matches(v, {_MAIL}) THEN {g(_MAIL, 5)} WHEN regexp_matches(v, {_CLOCK}) THEN {g(_CLOCK, 5)} ELSE '' END"
    line = lambda t, f, w: f"SELECT '{t}' AS src, line_id AS row_id, machine, trim(j->>'$.{f}') AS v, j->>'$.{f}' AS raw FROM {_VALID.format(t)} WHERE json_type(j, '$.{f}') IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND {w}"
    return f"""
WITH l AS ({line('event_lines', 'timestamp', 'true')} UNION ALL {line('rollout_lines', 'timestamp', 'true')} UNION ALL {line('chat_lines', 'startTime', 'line_no = 1')}),
w AS (SELECT src, row_id, v, {zone} AS off, try_strptime({wall}, '%Y-%m-%d %H:%M:%S') AS wall, CASE WHEN regexp_matches(v, {_ISO}) THEN rpad(left({g(_ISO, 7)}, 6), 6, '0')::BIGINT ELSE 0 END AS frac, m.time_zone AS tz
  FROM l LEFT JOIN machines m ON m.machine = l.machine WHERE NOT regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z$')),
n AS (SELECT src, row_id, v FROM w UNION ALL SELECT 'messages', id, cast(ts AS VARCHAR) FROM messages WHERE ts > 99999999999),
k AS (SELECT src, row_id, split_part(v, '.', 1) AS a, rpad(left(split_part(v, '.', 2), 6), 6, '0')::BIGINT AS b FROM n WHERE regexp_matches(v, '^[1-9][0-9]*([.][0-9]+)?$')),
x AS (SELECT *, epoch_us(timezone(tz, wall)) AS c FROM w WHERE wall IS NOT NULL AND year(wall) > 0)
SELECT src, row_id, CASE WHEN length(a) <= 11 THEN a::BIGINT * 1000000 + b WHEN length(a) <= 14 THEN a::BIGINT * 1000 WHEN length(a) <= 17 THEN a::BIGINT ELSE a::BIGINT // 1000 END AS utc_us FROM k WHERE length(a) <= 19
UNION ALL SELECT src, row_id, frac + CASE WHEN upper(off) IN ('Z', 'UTC') THEN epoch_us(wall)
  WHEN off <> '' THEN epoch_us(wall) - (CASE left(off, 1) WHEN '-' THEN -1 ELSE 1 END) * (left(right(off, length(off) - 1), 2)::BIGINT * 3600 + right(off, 2)::BIGINT * 60) * 1000000
  WHEN timezone(tz, make_timestamptz(c - 3600000000)) = wall THEN c - 3600000000 ELSE c END FROM x"""


ORACLES = {
    "p3_found": f"""
WITH e AS (SELECT 'claude-code' AS src, j->>'$.type' AS record, {_NUMBERS.format("j->>'$.version'")} AS version, j AS body FROM {_VALID.format('event_lines')} WHERE json_type(j) = 'OBJECT'),
m AS (SELECT 'codex' AS src, 'session_meta' AS record, {_NUMBERS.format("coalesce(j->>'$.payload.cli_version.semver', j->>'$.payload.cli_version')")} AS version, j->'$.payload' AS body FROM {_VALID.format('rollout_lines')} WHERE j->>'$.type' = 'session_meta'),
c AS (SELECT source_file, arg_max({_NUMBERS.format("j->>'$.cliVersion'")}, (batch_no, line_id)) FILTER (WHERE {_NUMBERS.format("j->>'$.cliVersion'")} IS NOT NULL) AS version FROM {_VALID.format('chat_lines')} WHERE line_no = 1 GROUP BY 1),
t AS (SELECT source_file, j->'$.tokens' AS body FROM {_VALID.format('chat_lines')} WHERE line_no > 1 AND json_type(j, '$."$set"') IS NULL
  UNION ALL SELECT source_file, json_extract(l, '$[' || k || '].tokens') FROM (SELECT source_file, j->'$."$set".messages' AS l, unnest(range(json_array_length(j->'$."$set".messages')::BIGINT)) AS k FROM {_VALID.format('chat_lines')} WHERE line_no > 1 AND json_type(j, '$."$set".messages') = 'ARRAY')),
r AS (SELECT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT 'gemini', 'tokens', version, body FROM t JOIN c USING (source_file) WHERE json_type(body) = 'OBJECT'),
n AS (SELECT src, version, row_number() OVER (PARTITION BY src ORDER BY string_split(version, '.')::INT[]) AS i FROM (SELECT DISTINCT src, version FROM r WHERE version IS NOT NULL)),
x AS (SELECT DISTINCT src, record, i, field, CASE json_type(body, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
  FROM (SELECT *, unnest(json_keys(body)) AS field FROM r) JOIN n USING (src, version)),
f AS (SELECT src, record, i, field, string_agg(kind, ',' ORDER BY kind) AS kinds FROM x WHERE kind IS NOT NULL AND field <> 'timestamp' GROUP BY 1, 2, 3, 4),
p AS (SELECT DISTINCT r.src, r.record, n.i FROM r JOIN n ON r.src = n.src AND r.version = n.version WHERE record IS NOT NULL),
gone AS (SELECT a.src, a.record, a.i + 1 AS i, a.field, a.kinds FROM f a JOIN p ON p.src = a.src AND p.record = a.record AND p.i = a.i + 1 LEFT JOIN f b ON b.src = a.src AND b.record = a.record AND b.field = a.field AND b.i = a.i + 1 WHERE b.field IS NULL),
fresh AS (SELECT a.src, a.record, a.i, a.field, a.kinds FROM f a JOIN p ON p.src = a.src AND p.record = a.record AND p.i = a.i - 1 LEFT JOIN f b ON b.src = a.src AND b.record = a.record AND b.field = a.field AND b.i = a.i - 1 WHERE b.field IS NULL),
pairs AS (SELECT g.src, g.record, g.i, min(g.field) AS field, min(h.field) AS new_field FROM gone g JOIN fresh h ON g.src = h.src AND g.record = h.record AND g.i = h.i AND g.kinds = h.kinds GROUP BY 1, 2, 3 HAVING count(*) = 1),
d AS (SELECT src, record, field, new_field, 'renamed' AS change, i FROM pairs
  UNION ALL SELECT g.src, g.record, g.field, '', 'removed', g.i FROM gone g LEFT JOIN pairs q ON q.src = g.src AND q.record = g.record AND q.i = g.i AND q.field = g.field WHERE q.field IS NULL
  UNION ALL SELECT h.src, h.record, h.field, '', 'added', h.i FROM fresh h LEFT JOIN pairs q ON q.src = h.src AND q.record = h.record AND q.i = h.i AND q.new_field = h.field WHERE q.field IS NULL
  UNION ALL SELECT a.src, a.record, a.field, '', 'retyped', a.i FROM f a JOIN f b ON b.src = a.src AND b.record = a.record AND b.field = a.field AND b.i = a.i - 1 WHERE a.kinds <> b.kinds
  UNION ALL SELECT a.src, a.record, '*', '', 'removed', a.i + 1 FROM p a LEFT JOIN p b ON b.src = a.src AND b.record = a.record AND b.i = a.i + 1 WHERE b.i IS NULL AND a.i < (SELECT max(i) FROM n WHERE n.src = a.src)
  UNION ALL SELECT a.src, a.record, '*', '', 'added', a.i FROM p a LEFT JOIN p b ON b.src = a.src AND b.record = a.record AND b.i = a.i - 1 WHERE b.i IS NULL AND a.i > 1)
SELECT d.src, d.record, d.field, d.new_field, d.change, n.version FROM d JOIN n ON n.src = d.src AND n.i = d.i""",
    "p4_found": """
WITH RECURSIVE c AS (SELECT source_file, line_no, arg_max(raw_line, (batch_no, line_id)) AS raw FROM chat_lines WHERE line_no >= 2 GROUP BY 1, 2),
j AS (SELECT source_file, line_no, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM c),
o AS (SELECT source_file, line_no, row_number() OVER (PARTITION BY source_file ORDER BY line_no) AS n,
  CASE WHEN json_type(j, '$."$set"') IS NOT NULL THEN CASE coalesce(json_type(j, '$."$set".messages'), '') WHEN '' THEN 'none' WHEN 'ARRAY' THEN 'set' ELSE 'bad' END WHEN json_type(j, '$."$rewindTo"') = 'VARCHAR' THEN 'rewind' WHEN j->>'$.id' <> '' THEN 'put' ELSE 'none' END AS kind,
  CASE WHEN json_type(j, '$."$rewindTo"') = 'VARCHAR' THEN j->>'$."$rewindTo"' ELSE j->>'$.id' END AS id, json_extract_string(j, '$."$set".messages[*].id') AS ids FROM j WHERE j IS NOT NULL),
r(source_file, n, live) AS (
  SELECT DISTINCT source_file, 0::BIGINT, []::STRUCT(id VARCHAR, line BIGINT)[] FROM o
  UNION ALL SELECT r.source_file, o.n, CASE o.kind
    WHEN 'set' THEN list_transform(o.ids, lambda x: {'id': x, 'line': o.line_no})
    WHEN 'put' THEN CASE WHEN list_contains(list_transform(live, lambda x: x.id), o.id) THEN list_transform(live, lambda x: CASE WHEN x.id = o.id THEN {'id': x.id, 'line': o.line_no} ELSE x END) ELSE list_append(live, {'id': o.id, 'line': o.line_no}) END
    WHEN 'rewind' THEN CASE WHEN list_contains(list_transform(live, lambda x: x.id), o.id) THEN live[1:list_position(list_transform(live, lambda x: x.id), o.id) - 1] ELSE live END
    ELSE live END
  FROM r JOIN o ON o.source_file = r.source_file AND o.n = r.n + 1),
z AS (SELECT source_file, arg_max(live, n) AS live FROM r WHERE source_file NOT IN (SELECT source_file FROM o WHERE kind = 'bad') GROUP BY 1)
SELECT source_file, (k - 1)::BIGINT AS pos, live[k].id AS msg_id, live[k].line::BIGINT AS line_no FROM (SELECT source_file, live, unnest(range(1, len(live) + 1)) AS k FROM z)""",
    "p1_found": """
WITH c AS (
  SELECT line_id, batch_no, 'e' AS src, j->>'$.type' AS type, j->>'$.uuid' AS ident FROM (SELECT line_id, batch_no, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM event_lines)
  UNION ALL SELECT line_id, batch_no, 'r', j->>'$.type', j->>'$.payload.id' FROM (SELECT line_id, batch_no, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM rollout_lines)),
k AS (SELECT line_id, row_number() OVER (PARTITION BY src, type, lower(trim(ident)) ORDER BY batch_no DESC, line_id DESC) AS rn FROM c WHERE trim(ident) <> '')
SELECT line_id FROM k WHERE rn > 1""",
    "p5_found": """
WITH e AS (SELECT line_id, j->'$.message.content' AS c FROM (SELECT line_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM event_lines)),
ea AS (SELECT line_id, CASE WHEN json_type(c) = 'ARRAY' THEN c WHEN json_type(c) = 'OBJECT' OR (json_type(c) = 'VARCHAR' AND c->>'$' <> '') THEN json_array(c) END AS c FROM e),
b AS (SELECT line_id, k AS ord, json_extract(c, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS k FROM ea WHERE c IS NOT NULL)),
r AS (SELECT line_id, ord AS parent_ord, x->'$.content' AS c FROM b WHERE json_type(x) = 'OBJECT' AND x->>'$.type' = 'tool_result'),
ra AS (SELECT line_id, parent_ord, CASE WHEN json_type(c) = 'ARRAY' THEN c WHEN json_type(c) = 'OBJECT' OR (json_type(c) = 'VARCHAR' AND c->>'$' <> '') THEN json_array(c) END AS c FROM r),
rb AS (SELECT line_id, parent_ord, k AS ord, json_extract(c, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS k FROM ra WHERE c IS NOT NULL)),
p AS (SELECT line_id, j->'$.payload.content' AS c FROM (SELECT line_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM rollout_lines) WHERE j->>'$.payload.type' = 'message'),
pa AS (SELECT line_id, CASE WHEN json_type(c) = 'ARRAY' THEN c WHEN json_type(c) = 'OBJECT' OR (json_type(c) = 'VARCHAR' AND c->>'$' <> '') THEN json_array(c) END AS c FROM p),
pb AS (SELECT line_id, k AS ord, json_extract(c, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS k FROM pa WHERE c IS NOT NULL)),
h AS (SELECT line_id, j FROM (SELECT line_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM chat_lines) WHERE j IS NOT NULL),
m AS (SELECT line_id, -1 AS idx, j AS m FROM h WHERE json_type(j, '$."$set"') IS NULL
  UNION ALL SELECT line_id, k, json_extract(l, '$[' || k || ']') FROM (SELECT line_id, j->'$."$set".messages' AS l, unnest(range(json_array_length(j->'$."$set".messages')::BIGINT)) AS k FROM h WHERE json_type(j, '$."$set".messages') = 'ARRAY')),
t AS (SELECT line_id, idx, 'tool_call' AS child, m->'$.toolCalls' AS c FROM m UNION ALL SELECT line_id, idx, 'thought', m->'$.thoughts' FROM m),
ta AS (SELECT line_id, idx, child, CASE WHEN json_type(c) = 'ARRAY' THEN c WHEN json_type(c) = 'OBJECT' THEN json_array(c) END AS c FROM t),
tb AS (SELECT line_id, idx, child, k AS ord, json_extract(c, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS k FROM ta WHERE c IS NOT NULL))
SELECT line_id, 'message_block' AS child, -1::BIGINT AS parent_ord, ord::BIGINT AS ord FROM b WHERE json_type(x) IN ('OBJECT', 'VARCHAR')
UNION ALL SELECT line_id, 'result_block', parent_ord, ord FROM rb WHERE json_type(x) IN ('OBJECT', 'VARCHAR')
UNION ALL SELECT line_id, 'content_block', -1, ord FROM pb WHERE json_type(x) IN ('OBJECT', 'VARCHAR')
UNION ALL SELECT line_id, child, idx, ord FROM tb WHERE json_type(x) = 'OBJECT'""",
}


def oracle_sql() -> dict[str, str]:
    once = f"SELECT src, line_id FROM (SELECT 'event_lines' AS src, line_id FROM event_lines UNION ALL SELECT 'rollout_lines', line_id FROM rollout_lines) WHERE line_id NOT IN ({ORACLES['p1_found']})"
    line = lambda t, f, w: f"SELECT '{t}' AS src, line_id AS row_id, j->>'$.{f}' AS raw FROM {_VALID.format(t)} WHERE json_type(j, '$.{f}') = 'VARCHAR' AND {w}"
    plain = f"""SELECT src, row_id, epoch_us(try_strptime(raw, '%Y-%m-%dT%H:%M:%S.%gZ')) AS utc_us FROM ({line('event_lines', 'timestamp', 'true')} UNION ALL {line('rollout_lines', 'timestamp', 'true')} UNION ALL {line('chat_lines', 'startTime', 'line_no = 1')})
WHERE regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z$') AND NOT starts_with(raw, '0000') AND try_strptime(raw, '%Y-%m-%dT%H:%M:%S.%gZ') IS NOT NULL"""
    every = f"SELECT * FROM ({_p7_sql()}) UNION ALL {plain} UNION ALL SELECT 'messages', id, ts * 1000000 FROM messages WHERE ts BETWEEN 1 AND 99999999999"
    return ORACLES | {"p7_found": _p7_sql(), "p7_normalised": every, "p1_delivered_once": once}
