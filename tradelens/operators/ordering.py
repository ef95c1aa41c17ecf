"""Ranks and top rows that no single task has to order whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.session import checkpointed

#: A monotonically increasing id has the place inside a partition in its lower bits.
PARTITION_BITS = 33


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in ``order``. Spark applies the limit before the shuffle too, so a hot key sends few rows."""
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_spot", spot).filter(F.col("_spot") <= limit).drop("_spot")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Place of every row from 1 in ``order``, over the whole table.

    Rows are dealt to partitions by ranges of the order and sorted there; the counts of the partitions before, one row a partition, complete the place.
    No value and no prefix has to fit in a task: rows that are alike in the order are the only ones that stay together, in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed)  # the ranges are sampled, so they must be drawn once
    part = F.shiftrightunsigned("_id", PARTITION_BITS)
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_id") - F.shiftleft("_part", PARTITION_BITS) + 1
    return placed.withColumn("_part", part).join(parts, "_part").select(*df.columns, (F.col("_before") + inside).cast("bigint").alias(name))


def ranked(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Place of every row by ``value`` descending, then by ``tie`` ascending; nulls of either come last."""
    return numbered(df, [F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_last()], name)
