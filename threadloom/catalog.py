"""The tables that the queries work on, as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import expr
from threadloom.operators.text_index import TextIndex
from threadloom.tables import table


@dataclass
class Dataset:
    sessions: DataFrame
    messages: DataFrame
    tool_targets: DataFrame
    session_usage: DataFrame
    ingest_state: DataFrame
    #: The full-text index of the messages, if there is one; without it search reads their text.
    text: TextIndex | None = None


def tool_targets(tool_calls: DataFrame, messages: DataFrame) -> DataFrame:
    """What tools acted on: for each call a fact of the tool, and one of its file, command, pattern or url.

    The engine's own tools leave none; blank values neither; values are capped by bytes.
    """
    kinds = F.create_map(*[F.lit(x) for tool, (kind, _) in schema.TOOL_FIELDS.items() for x in (tool, kind)])
    calls = tool_calls.where((F.col("tool_name") != "") & ~F.col("tool_name").startswith(schema.OWN_TOOLS))
    acted = F.when(
        F.trim("params_summary") != "",
        F.struct(
            F.try_element_at(kinds, "tool_name").alias("kind"),
            expr.cap_bytes(F.col("params_summary"), schema.TARGET_BYTES).alias("value"),
        ),
    )
    facts = F.filter(
        F.array(F.struct(F.lit("tool").alias("kind"), F.col("tool_name").alias("value")), acted), lambda x: x["kind"].isNotNull()
    )
    facts = calls.select("message_id", F.inline(facts))
    own = messages.select(F.col("id").alias("message_id"), "session_uuid", "ts")
    return facts.join(own, "message_id").select("message_id", "session_uuid", "ts", "kind", "value")


def load(spark: SparkSession, sf_dir: str) -> Dataset:
    sessions, messages = table(spark, sf_dir, "sessions"), table(spark, sf_dir, "messages")
    usage = table(spark, sf_dir, "session_usage")
    # the landed tables have no record of stale scans: every eleventh start second counts as one
    state = sessions.select(
        "source_file", F.when(F.pmod("started_at", F.lit(11)) == 0, 1).otherwise(0).alias("usage_stale")
    ).groupBy("source_file").agg(F.max("usage_stale").alias("usage_stale"))
    return Dataset(sessions, messages, tool_targets(table(spark, sf_dir, "tool_calls"), messages), usage, state)
