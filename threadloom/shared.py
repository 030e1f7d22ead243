"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that
is unset (tests on one machine) a temporary folder is made and set for the session.
Written tables cut the lineage and survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="threadloom-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Drop all intermediate tables of this application; results that still read them can't be computed afterwards."""
    drop_path(spark, own_dir(spark))


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file beside the tables; it appears whole or not at all, and is never overwritten unless asked."""
    fs, target = _file_system(spark, path)
    if not overwrite and fs.exists(target):
        raise FileExistsError(path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if overwrite:
        fs.delete(target, False)
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is missing."""
    fs, target = _file_system(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def size_of(spark: SparkSession, path: str) -> int:
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def drop_path(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
