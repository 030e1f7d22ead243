"""Numbering rows of unbounded groups without holding one in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, group: list[str], pos: str, within: list[str | Column], name: str = "seq", block: int = 4096
) -> DataFrame:
    """``name`` counts the rows of each group from 0 by ``pos`` and ``within``.

    Rows are ranked within blocks of ``pos``; the counts of earlier blocks, a row per block, are
    added.  A null ``pos`` counts as the first.
    """
    placed = df.withColumn("__block", F.floor(F.coalesce(F.col(pos), F.lit(-1)) / block))
    counts = placed.groupBy(*group, "__block").agg(F.count("*").alias("__n"))
    before = counts.withColumn(
        "__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__block")) - F.col("__n")
    ).drop("__n")
    rank = F.row_number().over(Window.partitionBy(*group, "__block").orderBy(pos, *within)) - 1
    return placed.withColumn("__rank", rank).join(before, [*group, "__block"]).withColumn(
        name, (F.col("__before") + F.col("__rank")).cast("bigint")
    ).drop("__block", "__rank", "__before")


def drop_repeats(df: DataFrame, group: list[str], order: list[str], value: str, block: int = 4096) -> DataFrame:
    """Rows whose ``value`` differs from that of the row before.

    Rows are compared within blocks of ``order[0]``, a number; the last value of a block, a row per
    block, stands before the first row of the next one.  A null number counts as the first.
    """
    placed = df.withColumn("__block", F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(2**62))))
    last = placed.groupBy(*group, "__block").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    following = F.lead("__block").over(Window.partitionBy(*group).orderBy("__block"))
    carried = last.withColumn("__block", following).where("__block is not null").select(
        *group, "__block", F.col("__last")[value].alias(value), F.lit(False).alias("__own")
    )
    rows = placed.withColumn("__own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*group, "__block").orderBy("__own", *order)
    keep = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return rows.withColumn("__keep", keep).where("__keep and __own").select(*df.columns)


def number_in_runs(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "at", block: int = 4096) -> DataFrame:
    """``name`` counts from 0 the rows of each run of equal neighbouring ``value``s in a group.

    Runs may go on over blocks of ``order[0]``, a number: what moves between blocks is a row per block,
    its last value, its rows and where its last run starts.  A null number counts as the first,
    null values are equal to each other.
    """
    placed = df.withColumn("__block", F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(2**62))))
    ends = placed.groupBy(*group, "__block").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__end"), F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__block")
    ends = ends.select(*group, "__block", F.lag("__end").over(w).alias("__prior"), (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    own = Window.partitionBy(*group, "__block").orderBy(*order)
    rows = placed.join(ends, [*group, "__block"])
    place = F.row_number().over(own) - 1
    last = F.when(place == 0, F.col("__prior")).otherwise(F.lag(F.struct(value)).over(own))
    rows = rows.withColumn("__place", F.col("__before") + place).withColumn(
        "__start", F.when(last.isNull() | ~last[value].eqNullSafe(F.col(value)), F.col("__place"))
    )
    rows = rows.withColumn("__open", F.max("__start").over(own))
    starts = rows.groupBy(*group, "__block").agg(F.max("__start").alias("__open"))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "__block", F.max("__open").over(earlier).alias("__earlier"))
    at = (F.col("__place") - F.coalesce("__open", "__earlier")).cast("bigint")
    return rows.join(starts, [*group, "__block"]).select(*df.columns, at.alias(name))
