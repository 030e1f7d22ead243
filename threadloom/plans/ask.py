"""Evidence for a question: candidates grouped by session, windowed and packed into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.catalog import Dataset
from threadloom.functions import expr, text
from threadloom.plans.search import SearchFilter, retrieve
from threadloom.plans.sessions import windows
from threadloom.shared import materialise


def _groups(candidates: DataFrame, sessions: int) -> DataFrame:
    """(session_uuid, full, score, rank, hits) of the best sessions.

    Sessions with a full hit stand first.  Their score is the sum of the three best full hits and
    0.5 for each short one (three at most); that of others the sum of the three best short hits.
    """
    best = lambda full: F.aggregate(F.slice(F.sort_array(F.collect_list(F.when(F.col("full") == full, F.col("score"))), False), 1, schema.HITS_PER_SESSION), F.lit(0.0), lambda a, x: a + x)
    grouped = candidates.groupBy("session_uuid").agg(
        F.max("full").alias("full"),
        best(True).alias("strong"),
        best(False).alias("weak"),
        F.count(F.when(~F.col("full"), 1)).alias("short"),
        F.collect_list("seq").alias("hits"),
    )
    score = F.when(
        F.col("full"), F.col("strong") + F.least("short", F.lit(schema.HITS_PER_SESSION)) * 0.5
    ).otherwise(F.col("weak"))
    order = [F.desc("full"), F.desc("score"), "session_uuid"]
    top = grouped.withColumn("score", score).orderBy(*order).limit(sessions)
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)) - 1
    ).select("session_uuid", "full", "score", "rank", "hits")  # at most ``sessions`` rows


def groups(
    data: Dataset, question: str, as_of: int, since: int = 0, project: str = "", source: str = "", sessions: int = 6
) -> DataFrame:
    sessions = sessions if sessions > 0 else schema.LIMITS["ask_sessions"][0]
    terms = text.question_terms(question)
    found = retrieve(
        data,
        terms,
        as_of,
        SearchFilter(since=since, project=project, source=source),
        max(sessions * 40, schema.LEAST_POOL),
        schema.HITS_PER_SESSION,
    )
    return _groups(found, sessions)


def ask(
    data: Dataset,
    question: str,
    as_of: int,
    since: int = 0,
    project: str = "",
    source: str = "",
    sessions: int = 6,
    window: int = 2,
    tokens: int = 2000,
) -> DataFrame:
    """Excerpts in order: (rank, session_uuid, title, project_path, source, score, seq, role, ts, text, is_hit).

    The windows of a session's hits are merged; groups are taken in order of their rank while
    they fit the budget of tokens.  If the first group does not fit, its hits alone are given,
    cut to a floor.  One join answers all windows.
    """
    window = window if window > 0 else 2
    tokens = max(schema.LEAST_ASK_TOKENS, min(tokens if tokens > 0 else 2000, schema.LIMITS["ask_tokens"][1]))
    # a row for each of a few sessions, used twice below: written once, so that the messages are searched once
    top = materialise(groups(data, question, as_of, since, project, source, sessions), "groups")
    hits = top.select("session_uuid", F.explode("hits").alias("hit_seq"))  # at most three for each group
    rows = windows(data.messages, hits, window, window)
    merged = rows.groupBy("session_uuid", "seq").agg(
        F.max(F.col("seq") == F.col("hit_seq")).alias("is_hit"),
        F.min_by(F.struct("role", F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"), "content"), "id").alias("m"),
    )
    cut = merged.select(
        "session_uuid",
        "seq",
        "is_hit",
        "m.role",
        "m.ts",
        expr.truncate(F.coalesce("m.content", F.lit("")), schema.EXCERPT_CHARS).alias("text"),
    )
    s = data.sessions.select(
        F.col("uuid").alias("session_uuid"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("project_path", F.lit("")).alias("project_path"),
        F.coalesce("source", F.lit(schema.DEFAULT_SOURCE)).alias("source"),
    )
    full = top.drop("hits").join(cut, "session_uuid").join(s, "session_uuid", "left")
    sized = full.groupBy("rank").agg(F.sum(expr.estimate_tokens(F.col("text"))).alias("tokens"))
    # estimates are never negative: stopping at the first group that does not fit is a running sum within the budget
    packed = sized.withColumn("upto", F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    fits = packed.where((F.col("upto") <= tokens) | (F.col("rank") == 0)).select("rank", (F.col("upto") > tokens).alias("floor"))
    out = full.join(F.broadcast(fits), "rank").where(~F.col("floor") | F.col("is_hit"))  # one row for each group
    return out.withColumn(
        "text", F.when(F.col("floor"), expr.truncate(F.col("text"), schema.FLOOR_CHARS)).otherwise(F.col("text"))
    ).drop("floor", "full")
