"""A change feed of inserts, updates and deletes applied in order, in SQL only.

Per key and field the winner is ``max_by`` over the changes that set the field, among the
changes after the key's latest deletion or replacement.  Nothing is sorted or folded per key:
the aggregates combine on the map side, so a hot key costs one row per map task and field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadloom.shared import materialise


def apply_changes(
    changes: DataFrame,
    keys: list[str],
    seq: list[str],
    op: str,
    fields: list[str],
    deletes: tuple[str, ...] = ("delete",),
    replaces: tuple[str, ...] = ("replace",),
) -> DataFrame:
    """Current rows of a table from its change feed, column-wise last writer wins.

    ``seq``: the columns that order changes; changes may come repeated and in any order.  A null
    in a field leaves the field as it was.  A delete removes the row, a replacement starts it anew
    with only its own fields; a change after either applies to the new row.  Changes that tie in
    ``seq`` are ordered by their operation and fields, so that repeats change nothing.  Keys whose
    last delete is followed by no change have no row; a null key is a key of its own.
    """
    spark = changes.sparkSession
    key = ", ".join(f"`{k}`" for k in keys)
    at = "struct(" + ", ".join(f"`{c}`" for c in seq) + ")"
    wipes = ", ".join(f"'{x}'" for x in deletes)
    starts = ", ".join(f"'{x}'" for x in (*deletes, *replaces))
    # the wiping position is part of each aggregate's state instead of a second pass: a window over the key would hold a hot key in one task
    since = spark.sql(f"SELECT {key}, max({at}) AS __since FROM {{feed}} WHERE `{op}` IN ({starts}) GROUP BY {key}", feed=changes)
    match = " AND ".join(f"f.`{k}` <=> s.`{k}`" for k in keys)
    picked = ", ".join(f"max_by(f.`{c}`, struct({', '.join(f'f.`{x}`' for x in seq)}, f.`{c}`)) FILTER (WHERE f.`{c}` IS NOT NULL) AS `{c}`" for c in fields)
    return spark.sql(
        f"""
        SELECT {", ".join(f"f.`{k}`" for k in keys)}{"," if fields else ""} {picked}
        FROM {{feed}} f LEFT JOIN {{since}} s ON {match}
        WHERE f.`{op}` NOT IN ({wipes}) AND (s.__since IS NULL OR struct({", ".join(f"f.`{x}`" for x in seq)}) >= s.__since)
        GROUP BY {", ".join(f"f.`{k}`" for k in keys)}
        """,
        feed=changes,
        since=since,
    )


OPS = """
SELECT source_file, line_no, line_id, batch_no,
  CASE WHEN v IS NULL THEN 'none'
       WHEN has_set AND messages IS NULL THEN 'none'
       WHEN has_set AND list IS NULL THEN 'bad'
       WHEN has_set THEN 'set'
       WHEN target IS NOT NULL THEN 'rewind'
       WHEN id <> '' THEN 'put' ELSE 'none' END AS kind,
  CASE WHEN has_set THEN NULL WHEN target IS NOT NULL THEN target ELSE id END AS id,
  CASE WHEN has_set THEN transform(filter(list, m -> try_variant_get(m, '$', 'map<string,variant>') IS NOT NULL), m -> coalesce(try_variant_get(m, '$.id', 'string'), '')) END AS ids
FROM (
  SELECT source_file, line_no, line_id, batch_no, v,
    variant_get(v, '$["$set"]', 'variant') IS NOT NULL AS has_set,
    try_variant_get(v, '$["$set"].messages', 'variant') AS messages,
    try_variant_get(v, '$["$set"].messages', 'array<variant>') AS list,
    try_variant_get(v, '$["$rewindTo"]', 'string') AS target,
    try_variant_get(v, '$.id', 'string') AS id
  FROM (SELECT source_file, line_no, line_id, batch_no, try_parse_json(raw_line) AS v FROM {lines} WHERE line_no >= 2)
)
"""

#: Of one line's copies the last delivered counts.  ``max_by`` combines on the map side.
CURRENT = """
SELECT source_file, line_no, w.kind, w.id, w.ids FROM (
  SELECT source_file, line_no, max_by(struct(kind, id, ids), struct(batch_no, line_id)) AS w
  FROM {ops} GROUP BY source_file, line_no)
"""

#: Last replacement of each file; files with an unusable one have no rows.
SINCE = """
SELECT source_file, max(CASE WHEN kind = 'set' THEN line_no END) AS since
FROM {current} GROUP BY source_file HAVING max(CASE WHEN kind = 'bad' THEN 1 ELSE 0 END) = 0
"""

TOUCHES = """
SELECT c.source_file, c.line_no, 0 AS ord, c.id, c.kind
FROM {current} c JOIN {since} s ON c.source_file = s.source_file
WHERE c.kind IN ('put', 'rewind') AND (s.since IS NULL OR c.line_no > s.since)
UNION ALL
SELECT source_file, line_no, pos AS ord, CASE WHEN id = '' THEN concat('\\u0000', pos) ELSE id END AS id, 'put' AS kind
FROM (SELECT c.source_file, c.line_no, posexplode(c.ids) AS (pos, id)
      FROM {current} c JOIN {since} s ON c.source_file = s.source_file AND c.line_no = s.since WHERE c.kind = 'set')
"""

#: A rewind that finds its message live at birth b removes everything born in [b, rewind).  Only rewinds
#: and the changes of messages that some rewind names are folded, each a few numbers.  An interval takes in
#: the earlier ones that began behind its start; those that began before ended before, so all are disjoint.
INTERVALS = """
SELECT source_file, aggregate(
    array_sort(collect_list(struct(line_no, ord, kind, id))),
    named_struct('live', cast(array() AS array<struct<id string, line_no bigint, ord int>>), 'gone', cast(array() AS array<struct<line_no bigint, ord int, until bigint>>)),
    (a, o) -> CASE
      WHEN o.kind = 'put' AND exists(a.live, x -> x.id = o.id) THEN a
      WHEN o.kind = 'put' THEN named_struct('live', array_append(a.live, named_struct('id', o.id, 'line_no', o.line_no, 'ord', o.ord)), 'gone', a.gone)
      WHEN NOT exists(a.live, x -> x.id = o.id) THEN a
      ELSE named_struct(
        'live', slice(a.live, 1, cast(array_position(transform(a.live, x -> x.id), o.id) AS int) - 1),
        'gone', array_append(filter(a.gone, g -> g.line_no < element_at(filter(a.live, x -> x.id = o.id), 1).line_no OR (g.line_no = element_at(filter(a.live, x -> x.id = o.id), 1).line_no AND g.ord < element_at(filter(a.live, x -> x.id = o.id), 1).ord)), named_struct(
            'line_no', element_at(filter(a.live, x -> x.id = o.id), 1).line_no,
            'ord', element_at(filter(a.live, x -> x.id = o.id), 1).ord,
            'until', o.line_no)))
      END, a -> a.gone) AS gone
FROM (
  SELECT t.source_file, t.line_no, t.ord, t.id, t.kind FROM {touches} t
  LEFT SEMI JOIN (SELECT DISTINCT source_file, id FROM {touches} WHERE kind = 'rewind') r ON t.source_file = r.source_file AND t.id = r.id)
GROUP BY source_file
"""

#: The intervals of each stretch of 1,024 lines: as they are disjoint, no more than its lines.
COVER = """
SELECT source_file, stretch, collect_list(g) AS gone
FROM (SELECT source_file, g, explode(sequence(g.line_no DIV 1024, (g.until - 1) DIV 1024)) AS stretch
      FROM (SELECT source_file, explode(gone) AS g FROM {intervals}))
GROUP BY source_file, stretch
"""

#: The birth of a live message is its first change that no rewind removed, its content that of its last change.
LIVE = """
SELECT source_file, id, min(CASE WHEN NOT lost THEN struct(line_no, ord) END) AS birth,
  max_by(line_no, struct(line_no, ord)) AS last_line, max_by(ord, struct(line_no, ord)) AS last_ord
FROM (
  SELECT t.source_file, t.id, t.line_no, t.ord,
    coalesce(exists(c.gone, g -> (g.line_no < t.line_no OR (g.line_no = t.line_no AND g.ord <= t.ord)) AND t.line_no < g.until), false) AS lost
  FROM {touches} t LEFT JOIN {cover} c ON t.source_file = c.source_file AND t.line_no DIV 1024 = c.stretch WHERE t.kind = 'put')
GROUP BY source_file, id HAVING birth IS NOT NULL
"""

#: Places by counts of earlier blocks and the place within the block: no file is sorted in one task.
PLACES = """
SELECT l.source_file, cast(b.before + row_number() OVER (PARTITION BY l.source_file, l.block ORDER BY l.birth) - 1 AS bigint) AS pos, l.id, l.last_line, l.last_ord
FROM (SELECT *, struct(birth.line_no DIV 4096 AS a, birth.ord DIV 4096 AS b) AS block FROM {live}) l
JOIN (SELECT source_file, block, sum(n) OVER (PARTITION BY source_file ORDER BY block) - n AS before
      FROM (SELECT source_file, struct(birth.line_no DIV 4096 AS a, birth.ord DIV 4096 AS b) AS block, count(*) AS n FROM {live} GROUP BY 1, 2)) b
ON l.source_file = b.source_file AND l.block = b.block
"""


def live_messages(lines: DataFrame) -> DataFrame:
    """(source_file, pos, msg_id, line_no, ord): the live messages of each chat file at its end.

    ``lines``: source_file, line_no, line_id, batch_no, raw_line.  Lines that are no JSON change
    nothing; a message without an id inside a replacement keeps its place and has a null id; an id
    repeated inside one replacement keeps its first place and its last content.  ``ord`` is the
    index of the message in the replacement that gave it its content, 0 for a single message.
    Files with no live message have no rows; lines
    without a file or line number are ignored, a null batch counts as the oldest.
    """
    spark = lines.sparkSession
    ops = spark.sql(OPS, lines=lines)
    # what the later steps read several times is written once: operations and changes are a few short columns
    current = materialise(spark.sql(CURRENT, ops=ops), "chat-current")
    since = spark.sql(SINCE, current=current)
    touches = materialise(spark.sql(TOUCHES, current=current, since=since), "chat-touches")
    intervals = spark.sql(INTERVALS, touches=touches)
    cover = spark.sql(COVER, intervals=intervals)
    live = materialise(spark.sql(LIVE, touches=touches, cover=cover), "chat-live")
    placed = spark.sql(PLACES, live=live)
    return placed.selectExpr(
        "source_file",
        "pos",
        "CASE WHEN id NOT LIKE '\\u0000%' THEN id END AS msg_id",
        "last_line AS line_no",
        "cast(last_ord AS bigint) AS ord",
    )


#: Every message of every line as a change of its columns: a put replaces the message, whether alone or in a list.
MESSAGES = """
SELECT source_file, line_no, ord, try_variant_get(m, '$.id', 'string') AS id, 'replace' AS op,
  try_variant_get(m, '$.type', 'string') AS type, try_variant_get(m, '$.timestamp', 'string') AS timestamp, try_variant_get(m, '$.model', 'string') AS model,
  to_json(try_variant_get(m, '$.content', 'variant')) AS content, to_json(try_variant_get(m, '$.tokens', 'variant')) AS tokens
FROM (
  SELECT source_file, line_no, posexplode(CASE
      WHEN variant_get(v, '$["$set"]', 'variant') IS NULL THEN array(v) ELSE try_variant_get(v, '$["$set"].messages', 'array<variant>') END) AS (ord, m)
  FROM (SELECT source_file, line_no, try_parse_json(raw_line) AS v FROM {lines}) WHERE v IS NOT NULL)
WHERE try_variant_get(m, '$.id', 'string') <> ''
"""
LAST_COPIES = """
SELECT source_file, line_no, max_by(raw_line, struct(batch_no, line_id)) AS raw_line FROM {lines} WHERE line_no >= 2 GROUP BY source_file, line_no
"""
COLUMNS = ("type", "timestamp", "model", "content", "tokens")


def message_rows(lines: DataFrame) -> DataFrame:
    """(source_file, pos, msg_id, type, timestamp, model, content, tokens): the columns of each live message.

    The columns are rebuilt by ``apply_changes``, each by its own ``max_by`` over the changes since the message's last
    replacement, for the messages that ``live_messages`` finds; live messages without an id have no columns.
    """
    live = materialise(live_messages(lines), "chat-messages")
    named = live.where("msg_id is not null").selectExpr("source_file", "msg_id AS id")
    # of one line's copies the last delivered counts
    current = lines.sparkSession.sql(LAST_COPIES, lines=lines)
    changes = lines.sparkSession.sql(MESSAGES, lines=current).join(named, ["source_file", "id"], "left_semi")
    rows = apply_changes(changes, ["source_file", "id"], ["line_no", "ord"], "op", list(COLUMNS))
    return live.selectExpr("source_file", "pos", "msg_id").join(rows.withColumnRenamed("id", "msg_id"), ["source_file", "msg_id"], "left")


def unusable_files(lines: DataFrame) -> DataFrame:
    """Files with a replacement whose messages are no array: nothing of them may be taken."""
    spark = lines.sparkSession
    current = spark.sql(CURRENT, ops=spark.sql(OPS, lines=lines))
    return current.where("kind = 'bad'").select("source_file").distinct()
