"""Global positions and ranks without a single task.

A range partitioning puts rows in order over tasks; the rows before a task are a sum
over one row per task.  A position is that sum plus the row number inside the task.
The partitions follow the rows, so one key that holds most of them spreads over
all tasks.

The range bounds come from a sample, so partition numbers are only sure once they are
written: ``ranged`` lands the rows in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filings_engine.session import materialize

PART = "_part"


def ranged(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and landed, with its partition in
    ``_part``: all rows of a smaller partition come first."""
    parted = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return materialize(parted.withColumn(PART, F.spark_partition_id()), as_table=True)


def with_position(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """O1: the place of each row in the whole order, from 1.  Equal rows of
    ``order`` lie in one task, so end it with columns that tell rows apart; rows
    equal in all of it get places in any order.

    One range shuffle, then a shuffle by partition for the row numbers; the window
    over all partitions holds one row for each."""
    rows = ranged(df, order, partitions)
    before = F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).select(F.col(PART).alias("_part_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    placed = rows.withColumn(name, number.cast("long")).join(F.broadcast(offsets), F.col(PART) == F.col("_part_of"))
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop(PART, "_part_of", "_before")


def running_count(points: DataFrame, key: str, at: str, weight: str, last: str, name: str = "running", partitions: int | None = None) -> DataFrame:
    """The sum of ``weight`` over the rows of the same key up to and including each
    row, in order of (``at``, ``last``); a null key is a key.

    (key, at) pairs are range-partitioned, so the rows of one key lie in as many
    partitions as their number asks for; a key's earlier partitions come in as one
    sum each."""
    rows = ranged(points, [F.col(key), F.col(at), F.col(last)], partitions)
    inside = Window.partitionBy(key, PART)
    totals = rows.groupBy(F.col(key).alias("_part_key"), F.col(PART).alias("_part_of")).agg(F.sum(weight).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_part_key").orderBy("_part_of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_part_key", "_part_of", F.coalesce(before, F.lit(0)).alias("_before"))
    running = F.sum(weight).over(inside.orderBy(at, last).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn(name, running)
    same = F.col(key).eqNullSafe(F.col("_part_key")) & (F.col(PART) == F.col("_part_of"))
    return placed.join(offsets, same).withColumn(name, F.col(name) + F.col("_before")).drop(PART, "_part_key", "_part_of", "_before")
