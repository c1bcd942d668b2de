"""Numbering rows in one order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators.lineage import cut


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 in the given order.

    Rows are dealt into ranges of the order, counted by shard and range, and
    numbered within both; only the small table of counts is summed up by shard,
    so no task holds a whole shard.
    """
    tie, part = "_tie", "_range"
    ranged = cut(df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(shard, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order, tie)) - 1
    return ranged.withColumn(slot, within.cast("long")).join(offsets, [shard, part]).withColumn(slot, F.col(slot) + F.col("_before")).drop(part, "_before", tie)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in the given order."""
    group = "_all"
    return with_slots(df.withColumn(group, F.lit(0)), group, order, name).drop(group)


def running(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group up to each row, in an order that tells all rows of a group apart.

    Rows are dealt into ranges of the order; only the sums of group and range
    are added up by group, so no task holds a whole group.
    """
    part = "_range"
    ranged = cut(df.repartitionByRange(*order, group).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(group, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_group"), F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(part) == F.col("_part"))
    return ranged.withColumn(name, within).join(offsets, same).withColumn(name, F.col(name) + F.col("_before")).drop(part, "_group", "_part", "_before")
