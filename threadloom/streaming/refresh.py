"""Live maintenance: landed lines as a stream, merged into tables batch by batch.

Files that grow are landed as rows (one per line and delivery), so the stream's own offsets
track what was read.  Each micro-batch recomputes the sessions it touches from all their
lines and replaces them as a whole; a batch that runs twice writes the same rows.  Tables are
versions in a folder, the newest complete one is current, readers never see a half one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.ingest import replace_sessions
from threadloom.store import Busy, Store, ingest_all, reconcile


class VersionedTable:
    """A Parquet table whose versions are folders ``v=<n>``; ``_SUCCESS`` marks a complete one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={have[-1]}")

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        """Write a version again or anew, and drop those before the last ``keep``."""
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        jvm, _, fs = self._fs()
        for old in self.versions()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)


def merge_batch(
    landed: Callable[[], DataFrame], adapt: Callable[[DataFrame], DataFrame], target: VersionedTable
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: recompute the files of a batch from ``landed()`` and replace their sessions."""

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("source_file").distinct()
        lines = landed().join(touched, "source_file", "left_semi")
        done = [v for v in target.versions() if v < batch_id]
        base = target.spark.read.schema(target.schema).parquet(f"{target.path}/v={done[-1]}") if done else target.spark.createDataFrame([], target.schema)
        target.write(replace_sessions(base, adapt(lines)), batch_id)

    return run


def follow(
    spark: SparkSession,
    landing: str,
    schema: str,
    checkpoint: str,
    merge: Callable[[DataFrame, int], None],
    files_per_trigger: int = 100,
    once: bool = False,
) -> StreamingQuery:
    """Start the stream over a folder of landed Parquet files; ``once`` takes what is there and ends."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    writer = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def activity_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window of event time and type, for streams and tables: late rows count until the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n"
    )


def pass_over(store: Store, roots: list[str], clock: Callable[[], int], backstop: int = 20) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a clock: each tick takes in the files that are new or grew, every ``backstop``-th one
    reconciles with all files, those that are gone too.  A tick while another writer is at work does nothing.
    """

    def run(_: DataFrame, batch_id: int) -> None:
        try:
            if batch_id % backstop == 0:
                reconcile(store, roots, clock())
            else:
                ingest_all(store, roots, clock())
        except Busy:
            pass

    return run


def watch(store: Store, roots: list[str], checkpoint: str, clock: Callable[[], int], every: str = "5 seconds", backstop: int = 20) -> StreamingQuery:
    """Growing transcript files as a stream: offsets are those that the store keeps, so a restart goes on where it was."""
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(pass_over(store, roots, clock, backstop)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()
