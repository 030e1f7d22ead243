"""Ranked full-text search and retrieval of candidates.

Long terms (three characters or more) match with Unicode case folding and score by BM25 over
character trigrams; short terms match with ASCII case folding and only filter.  With an index
of the messages long terms are looked up there: matches, scores and statistics come from its places, and text is
read of the rows that are shown, or that short terms filter.  Without one the corpus
statistics (rows, average length, document frequency of each term) come from one aggregation
over all messages, whatever the filters, as a scalar subquery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.catalog import Dataset
from threadloom.functions import expr, text
from threadloom.operators.text_index import scored
from threadloom.plans.sessions import acted_sessions

RESULT = "id bigint, seq int, session_uuid string, project_path string, parent_session string, agent_type string, source string, role string, ts bigint, snippet string, score double"


@dataclass(frozen=True)
class SearchFilter:
    since: int = 0
    project: str = ""
    role: str = ""
    tool_output: bool = False
    touched: str = ""
    tool: str = ""
    ran: str = ""
    source: str = ""


def _scoped(data: Dataset, f: SearchFilter) -> DataFrame:
    """Messages with their session's columns; messages without a session pass as of the default source."""
    m = data.messages
    if f.role:
        m = m.where(F.col("role") == f.role)
    elif not f.tool_output:
        m = m.where(F.col("role").isin(*schema.DIALOGUE))
    if f.since > 0:
        m = m.where(F.col("ts") >= f.since)
    for acted in acted_sessions(data.tool_targets, f.touched, f.tool, f.ran):
        m = m.join(acted, m.session_uuid == acted.acted, "left_semi")
    s = data.sessions.select(F.col("uuid").alias("session_uuid"), "project_path", "parent_session", "agent_type", "source")
    rows = m.join(s, "session_uuid", "left").where(expr.of_source(F.col("source"), f.source))
    return rows.where(expr.starts_with(F.col("project_path"), f.project)) if f.project else rows


def statistics(messages: DataFrame, terms: list[str]) -> DataFrame:
    """One row: n, average and the document frequency of each term (df0, df1, ...)."""
    c = F.coalesce(F.col("content"), F.lit(""))
    counts = [F.sum(expr.contains_long(c, t).cast("bigint")).alias(f"df{k}") for k, t in enumerate(terms)]
    return messages.agg(F.count("*").alias("n"), F.greatest(F.avg(expr.trigrams(c)), F.lit(1e-9)).alias("average"), *counts)


def _scored(rows: DataFrame, messages: DataFrame, terms: list[str]) -> DataFrame:
    stats = statistics(messages, terms)
    rows = rows.withColumn("stats", stats.select(F.struct(*stats.columns)).scalar())  # one row, computed once
    return rows.withColumn(
        "bm25",
        expr.bm25(
            F.col("content"), terms, F.col("stats.n"), F.col("stats.average"), [F.col(f"stats.df{k}") for k in range(len(terms))]
        ),
    ).drop("stats")


def search(data: Dataset, query: str, as_of: int, f: SearchFilter = SearchFilter(), limit: int = 20) -> DataFrame:
    """Messages that contain every term, best first by score, role and recency.

    Twelve times ``limit`` rows are taken by BM25 (by time where all terms are short) before they
    are ranked again; a query without terms has no rows, an empty one is an error.
    """
    if not query.strip():
        raise ValueError("empty query")
    limit = limit if limit > 0 else 20
    terms = text.search_terms(query)
    if not terms:
        return data.messages.sparkSession.createDataFrame([], RESULT)
    long, short = text.by_length(terms)
    c = F.col("content")
    indexed = bool(long) and data.text is not None
    rows = _scoped(data, f)
    if indexed:
        rows = rows.join(scored(data.text, long, True), "id")
        if short:
            rows = rows.where(expr.all_of([expr.contains_short(c, t) for t in short]))
    else:
        rows = rows.where(expr.all_of([expr.contains_long(c, t) for t in long] + [expr.contains_short(c, t) for t in short]))
    if indexed:
        pool = rows.drop("content", "raw_json").orderBy("bm25", "id").limit(limit * schema.OVERSCAN)
        snippet = expr.marked_snippet(c, long)
    elif long:
        pool = _scored(rows, data.messages, long).orderBy("bm25", "id").limit(limit * schema.OVERSCAN)
        snippet = expr.marked_snippet(c, long)
    else:
        pool = rows.withColumn("bm25", F.lit(0.0)).orderBy(F.desc("ts"), "id").limit(limit * schema.OVERSCAN)
        snippet = expr.window_snippet(c, terms)
    pool = pool.withColumn(
        "score", expr.relevance(F.col("bm25"), F.col("role"), F.col("ts"), as_of)
    ).orderBy(F.desc("score"), "bm25", "id").limit(limit)
    if indexed:  # the text of what is shown, at most ``limit`` rows
        shown = F.broadcast(pool)
        pool = data.messages.select("id", "content").join(shown, "id").orderBy(F.desc("score"), "bm25", "id")
    texts = [F.coalesce(k, F.lit("")).alias(k) for k in ("project_path", "parent_session", "agent_type")]
    return pool.select(
        "id",
        "seq",
        "session_uuid",
        *texts,
        F.coalesce("source", F.lit(schema.DEFAULT_SOURCE)).alias("source"),
        "role",
        F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"),
        snippet.alias("snippet"),
        "score",
    )


#: Characters of a candidate's snippet.
CANDIDATE_CHARS = 160


def with_snippets(data: Dataset, candidates: DataFrame) -> DataFrame:
    """Candidates (a bounded list) with the start of their text as ``snippet``."""
    own = data.messages.select("id", F.substring(F.coalesce("content", F.lit("")), 1, CANDIDATE_CHARS).alias("snippet"))
    return own.join(F.broadcast(candidates), "id").select(*candidates.columns, "snippet")


def retrieve(
    data: Dataset, terms: list[str], as_of: int, f: SearchFilter = SearchFilter(), limit: int = 60, per_session: int = 0
) -> DataFrame:
    """Candidates that contain any term: (session_uuid, seq, id, role, ts, full, score).

    Rows with a long term (``full``) stand before those with short ones alone and score by BM25, the
    others by the number of short terms; one with both gains 0.5.  Each kind is cut to twelve
    times ``limit`` first.  With ``per_session`` only so many of a session are kept.
    """
    limit = limit if limit > 0 else 60
    long, short = text.by_length(list(terms))
    c = F.col("content")
    scoped = _scoped(data, f)
    keep = ["session_uuid", "seq", "id", "role", "ts"]
    pools = []
    if long:
        if data.text is not None:
            hits = scoped.join(scored(data.text, long, False), "id")
        else:
            hits = _scored(scoped.where(expr.any_of([expr.contains_long(c, t) for t in long])), data.messages, long)
        pools.append(
            hits.orderBy("bm25", "id").limit(limit * schema.OVERSCAN).select(
                *keep, F.lit(True).alias("full"), expr.relevance(F.col("bm25"), F.col("role"), F.col("ts"), as_of).alias("score")
            ),
        )
    if short:
        count = sum((expr.contains_short(c, t).cast("int") for t in short), F.lit(0))
        hits = scoped.withColumn("mc", count).where("mc > 0")
        pools.append(
            hits.orderBy(F.desc("mc"), F.desc("ts"), "id").limit(limit * schema.OVERSCAN).select(
                *keep,
                F.lit(False).alias("full"),
                expr.relevance(-F.col("mc").cast("double"), F.col("role"), F.col("ts"), as_of).alias("score"),
            ),
        )
    if not pools:
        return data.messages.sparkSession.createDataFrame(
            [], "session_uuid string, seq int, id bigint, role string, ts bigint, full boolean, score double"
        )
    both = pools[0] if len(pools) == 1 else pools[0].unionByName(pools[1])
    key = Window.partitionBy("session_uuid", "seq")
    ranked = both.withColumn(
        "rn", F.row_number().over(key.orderBy(F.desc("full"), F.desc("score"), "id"))
    ).withColumn("kinds", F.size(F.collect_set("full").over(key)))
    best = ranked.where("rn = 1").withColumn(
        "score", F.col("score") + F.when(F.col("full") & (F.col("kinds") == 2), 0.5).otherwise(0.0)
    ).drop("rn", "kinds")
    order = [F.desc("full"), F.desc("score"), "session_uuid", "seq"]
    if per_session > 0:
        best = best.withColumn(
            "rn", F.row_number().over(Window.partitionBy("session_uuid").orderBy(*order))
        ).where(F.col("rn") <= per_session).drop("rn")
    return best.orderBy(*order).limit(limit).withColumn("ts", F.coalesce("ts", F.lit(0)).cast("bigint"))
