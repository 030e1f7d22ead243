"""Transcript files: scan, routing, lines, fingerprints, and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.shared import materialise

LONGEST_LINE = 16 * 1024 * 1024
EDGE_BYTES = 512


def source_of(path: Column) -> Column:
    """The format of a file by its path; any other file is of the default format."""
    return F.when(path.rlike(r"(^|/)rollout-[^/]*\.jsonl$"), "codex").when(
        path.rlike(r"/chats/session-[^/]*\.jsonl$"), "gemini"
    ).otherwise("claude-code")


def under_root(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def last_uuid(path: Column) -> Column:
    found = F.regexp_extract_all(
        F.element_at(F.split(path, "/"), -1), F.lit("([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
    )
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def is_subagent(path: Column) -> Column:
    return path.rlike(r"(^|/)subagents/agent-[^/]*\.jsonl$")


def subagent_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/subagents/[^/]+$", 1)


def project_of_path(path: Column) -> Column:
    """The project directory's name with its dashes as slashes; that cannot be told apart from real dashes."""
    name = F.when(
        is_subagent(path), F.regexp_extract(path, r"([^/]+)/[^/]+/subagents/[^/]+$", 1)
    ).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.replace(name, F.lit("-"), F.lit("/"))


def chat_project_id(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/chats/[^/]+$", 1)


def chat_projects(projects: DataFrame) -> DataFrame:
    """(project_id, project_path) of a table with one JSON text ``json`` that maps paths to ids; the map is inverted."""
    paths = projects.select(
        F.explode(F.map_entries(F.from_json(F.get_json_object("json", "$.projects"), "map<string,string>"))).alias("e")
    )
    return paths.select(F.col("e.value").alias("project_id"), F.col("e.key").alias("project_path"))


#: Bytes of a file that one task reads at a time.
CHUNK_BYTES = 64 * 1024 * 1024


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(source_file, uri, size, modified_ns) of all transcript files below the roots, each once; no content is read.

    ``roots`` that are missing have no files.
    """
    there = [r for r in roots if exists(spark, r)]
    if not there:
        return spark.createDataFrame([], "source_file string, uri string, size bigint, modified_ns bigint")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(there)
    return found.select(
        F.regexp_replace("path", "^file:/*", "/").alias("source_file"),
        F.col("path").alias("uri"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"),
    ).dropDuplicates(["source_file"])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def _open(uri: str):
    system, path = _system(uri)
    return system.open_input_file(path)


def _stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, times = [], []
        for uri in batch.column(1).to_pylist():
            system, path = _system(uri)
            info = system.get_file_info(path)
            sizes.append(info.size)
            times.append(None if info.mtime_ns is None else info.mtime_ns // 1_000_000)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], ["source_file", "size_now", "ms_now"])


def unchanged(files: DataFrame) -> DataFrame:
    """Those of some listed files that still have the size and time (to the millisecond) of the listing; only they are looked at."""
    now = files.select("source_file", "uri").mapInArrow(_stat, "source_file string, size_now bigint, ms_now bigint")
    same = (F.col("size") == F.col("size_now")) & (F.expr("modified_ns div 1000000") == F.col("ms_now"))
    return files.join(now, "source_file").where(same).drop("size_now", "ms_now")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the first and of the last bytes before an offset; null for a file that can't be read."""
    for batch in batches:
        heads, tails = [], []
        for uri, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            try:
                with _open(uri) as file:
                    head = file.read_at(min(EDGE_BYTES, file.size()), 0)
                    start = max(0, end - EDGE_BYTES)
                    tail = file.read_at(end - start, start) if end else b""
            except OSError:
                heads.append(None)
                tails.append(None)
                continue
            heads.append(sha256(head).hexdigest() if head else "")
            tails.append(sha256(tail).hexdigest() if tail else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(heads, pa.string()), pa.array(tails, pa.string())], ["source_file", "head_fingerprint", "tail_fingerprint"]
        )


def fingerprints(files: DataFrame, offset: str = "size") -> DataFrame:
    """SHA-256 of the first and of the last 512 bytes before ``offset``; '' for an empty file.  Only these bytes are read.

    A file that can't be read is left out.
    """
    got = files.select("source_file", "uri", F.col(offset).cast("bigint")).mapInArrow(
        _edges, "source_file string, head_fingerprint string, tail_fingerprint string"
    )
    return files.join(got.where("head_fingerprint is not null"), "source_file")


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The complete lines that start in a part of a file; one longer than the longest is told, not kept."""
    for batch in batches:
        for path, uri, chunk, start, end, size in zip(*[c.to_pylist() for c in batch.columns]):
            rows: list[tuple] = []
            held = n = 0
            with _open(uri) as file:
                base = max(0, start - 1)
                data = file.read_at(max(0, min(end, size) - base), base)
                # a line that reaches over the start belongs to the part before
                at = data.find(b"\n") + 1 or len(data) if start else 0
                while at < len(data):
                    stop = data.find(b"\n", at)
                    if stop >= 0:
                        line, after = data[at:stop], stop + 1
                    else:  # it ends in a later part; a last line without an end waits
                        far = _line_end(file, base + len(data), size)
                        if far is None:
                            break
                        long = far - base - at > LONGEST_LINE
                        line = None if long else data[at:] + file.read_at(far - base - len(data), base + len(data))
                        after = len(data)
                    if line is None or len(line) > LONGEST_LINE:
                        rows.append((path, chunk, n, None, True))
                    elif line:
                        rows.append((path, chunk, n, line.decode("utf-8", "replace"), False))
                        held += len(line)
                    n, at = n + 1, after
                    if held > CHUNK_BYTES // 8:
                        yield _line_batch(rows)
                        rows, held = [], 0
            # how many lines the part has, empty ones too
            rows.append((path, chunk, n, None, None))
            yield _line_batch(rows)


def _line_end(file, at: int, size: int) -> int | None:
    """Where the next line feed is; null if the file has none."""
    step = 1024 * 1024
    while at < size:
        found = file.read_at(min(step, size - at), at).find(b"\n")
        if found >= 0:
            return at + found
        at += step
    return None


_LINES = "source_file string, chunk int, at bigint, raw_line string, too_long boolean"


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _LINES.split(", ")])


def lines(files: DataFrame) -> DataFrame:
    """(source_file, line_no, raw_line, too_long) of the complete lines; a last line without an end waits for the next pass.

    ``files``: source_file, uri, size.  Parts of ``CHUNK_BYTES`` are read by tasks of their own, so a file may have
    any size; lines are counted per part and the counts of the parts before are added.
    """
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / CHUNK_BYTES).cast("int") - 1))
    chunks = files.select("source_file", "uri", "size", F.explode(parts).alias("chunk"))
    start = F.col("chunk").cast("bigint") * CHUNK_BYTES
    chunks = chunks.select("source_file", "uri", "chunk", start.alias("start"), (start + CHUNK_BYTES).alias("end"), "size")
    many = max(1, chunks.sparkSession.sparkContext.defaultParallelism)
    rows = materialise(chunks.repartition(many, "source_file", "chunk").mapInArrow(_read_lines, _LINES), "file-lines")
    counts = rows.where("too_long is null").select("source_file", "chunk", F.col("at").alias("n"))
    order = Window.partitionBy("source_file").orderBy("chunk")
    before = counts.select("source_file", "chunk", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return rows.where("too_long is not null").join(before, ["source_file", "chunk"]).select(
        "source_file", (F.col("before") + F.col("at") + 1).cast("bigint").alias("line_no"), "raw_line", "too_long"
    )


def current_lines(landed: DataFrame) -> DataFrame:
    """Of each line of a landed file the copy that was delivered last."""
    newest = F.max_by(F.struct("line_id", "raw_line"), F.struct("batch_no", "line_id"))
    return landed.groupBy("source_file", "line_no").agg(newest.alias("l")).select(
        "source_file", "line_no", "l.line_id", "l.raw_line"
    )


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; empty arrays stay arrays, nulls are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def as_markdown(messages: DataFrame) -> DataFrame:
    """A session's rows (seq, role, ts, content) as sections of Markdown."""
    at = F.when(
        F.col("ts") > 0, F.concat(F.lit(" · "), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm"))
    ).otherwise("")
    return messages.select(
        "seq", F.concat(F.lit("### "), "role", at, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("markdown")
    )


def as_raw(messages: DataFrame) -> DataFrame:
    """The stored lines of a session (seq, id, session_uuid, raw_json) as they came, without consecutive repeats."""
    from threadloom.operators.sequence import drop_repeats

    rows = messages.where("raw_json is not null").select("session_uuid", "seq", "id", "raw_json")
    return drop_repeats(rows, ["session_uuid"], ["seq", "id"], "raw_json").select("session_uuid", "seq", F.col("raw_json").alias("line"))
