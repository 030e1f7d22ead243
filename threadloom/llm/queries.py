"""Queries of the language-model data problems (2, 6, 8, 9, 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversations, leakage, mixing, mojibake, secrets
from threadloom.tables import table


def _secret_tables(spark: SparkSession, sf_dir: str) -> list:
    # a name may be written with escapes
    outputs = table(spark, sf_dir, "rollout_lines").where("contains(raw_line, '\"output\"') or contains(raw_line, '\\\\u00')").select(
        "line_id", "source_file", F.expr("try_variant_get(try_parse_json(raw_line), '$.payload.output', 'string')").alias("output")
    ).where("output is not null")
    return [
        (table(spark, sf_dir, "messages"), "messages", "id", {"content": "content", "raw_json": "raw_json"}),
        (outputs, "rollout_lines", "line_id", {"payload.output": "output"}, "source_file"),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_secret_tables(spark, sf_dir), with_text=False).select("src", "row_id", "field")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that hold credentials, redacted, with the number of values cut."""
    return secrets.scan(_secret_tables(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.to_drop(table(spark, sf_dir, "messages"), table(spark, sf_dir, "sessions"))


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "messages"), table(spark, sf_dir, "sessions"))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as the times of the rows alone give them, and whether they hold a reply."""
    return conversations.sessionise(table(spark, sf_dir, "messages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each leak repeats: words of the item, shares of its question and of the rest."""
    got = leakage.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.withColumns({c: F.round(c, 4) for c in ("question", "rest")})


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents"), with_text=False).select(F.col("row_id").alias("doc_id"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents")).select(F.col("row_id").alias("doc_id"), "restored", "how")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_redacted, p6_found, p6_conversations, p6_segments, p8_found, p8_overlap, p9_mix, p9_shares, p10_found, p10_restored)
    return {f.__name__: f for f in own}


ORACLES = {
    "p6_found": r"""
WITH f AS (SELECT session_uuid, seq, arg_min({'role': role, 'content': content}, id) AS v FROM messages WHERE session_uuid IS NOT NULL GROUP BY 1, 2),
r AS (SELECT session_uuid, seq, CASE lower(trim(v.role)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'gemini' THEN 'assistant'
  WHEN 'system' THEN 'system' WHEN 'thinking' THEN 'thinking' WHEN 'tool_use' THEN 'tool_use' WHEN 'tool_result' THEN 'tool_result' END AS role, regexp_replace(coalesce(v.content, ''), '[\s\x{00A0}\x{200B}\x{3000}]', '', 'g') <> '' AS said FROM f),
d AS (SELECT *, lead(role) OVER (PARTITION BY session_uuid ORDER BY seq) AS next, row_number() OVER (PARTITION BY session_uuid ORDER BY seq) AS rn FROM r WHERE said AND role IN ('user', 'assistant')),
b AS (SELECT session_uuid FROM r GROUP BY 1 HAVING min(seq) <> 0 OR max(seq) <> count(*) - 1 OR count(*) FILTER (WHERE seq IS NULL OR role IS NULL) > 0
  UNION SELECT session_uuid FROM d WHERE (rn = 1 AND role = 'assistant') OR (role = 'user' AND next IS DISTINCT FROM 'assistant'))
SELECT u AS session_uuid FROM (SELECT uuid AS u FROM sessions WHERE uuid IS NOT NULL UNION SELECT session_uuid FROM messages WHERE session_uuid IS NOT NULL) WHERE u IN (SELECT session_uuid FROM b) OR u NOT IN (SELECT session_uuid FROM d)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
