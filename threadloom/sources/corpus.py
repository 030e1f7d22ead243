"""A retrieval corpus: sessions with their messages as nested JSON lines, turned into a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.catalog import Dataset
from threadloom.store import TABLES

CORPUS = "session string, project string, title string, source string, messages array<struct<seq:int,role:string,content:string,offset_days:int>>"


def dataset(spark: SparkSession, corpus: DataFrame, now: int) -> Dataset:
    """``corpus`` has the columns of ``CORPUS``; a message's time is ``now`` less its days."""
    rows = corpus.select("session", "project", "title", "source", F.explode("messages").alias("m"))
    ts = F.lit(now) - F.coalesce("m.offset_days", F.lit(0)) * 86_400
    messages = rows.select(
        F.xxhash64("session", "m.seq").alias("id"),
        F.col("session").alias("session_uuid"),
        F.col("m.seq").alias("seq"),
        ts.cast("bigint").alias("ts"),
        "m.role",
        "m.content",
        F.lit(None).cast("string").alias("raw_json"),
    )
    spans = messages.groupBy(F.col("session_uuid").alias("uuid")).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count(F.when(F.col("role") == "user", 1)).cast("int").alias("turn_count"),
    )
    sessions = corpus.select(
        F.col("session").alias("uuid"), F.col("project").alias("project_path"), "title", "source"
    ).join(spans, "uuid", "left")
    sessions = sessions.withColumns(
        {
            "source_file": F.concat(F.lit("/corpus/"), "uuid"),
            "parent_session": F.lit(None).cast("string"),
            "agent_type": F.lit(None).cast("string"),
        },
    )
    empty = {name: spark.createDataFrame([], TABLES[name]) for name in ("tool_targets", "session_usage", "ingest_state")}
    return Dataset(sessions, messages, empty["tool_targets"], empty["session_usage"], empty["ingest_state"])


def read(spark: SparkSession, path: str, now: int) -> Dataset:
    return dataset(spark, spark.read.schema(CORPUS).json(path), now)
