"""Exact quantiles and ranks without collecting a group.

Values are first counted per ``(group, value)`` — that aggregate combines on the map side — and the
counts are then accumulated with the segmented scan. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import log_segment
from tradelens.operators.scan import ordered_scan

ALL = "_all"


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    """How often each value occurs; ``weight`` says how many rows a row stands for, where they were counted before."""
    counted = (
        df.select(*keys, value.alias("_v"), (F.lit(1) if weight is None else weight).cast("bigint").alias("_w")).filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v").agg(F.sum("_w").alias("_cnt"))
    )
    return counted if keys else counted.withColumn(ALL, F.lit(0))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: Column, segment: Callable[[Column], Column] = log_segment,
                      weight: Column | None = None) -> DataFrame:
    """Distinct values with ``_cnt``, the running ``_cum`` in ascending order and the group's ``_total``.

    ``segment`` cuts the range of values; it must never decrease as the value grows. Large values in a narrow
    range, such as clocks, need segments of their own width.
    """
    counted = value_counts(df, keys, value, weight)
    return ordered_scan(
        counted, list(keys) or [ALL], segment(F.col("_v")), ["_v"],
        sums={"_cum": F.col("_cnt")}, totals={"_total": F.col("_cnt")},
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probabilities: Mapping[str, float],
    interpolate: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """One row per group with the requested quantiles.

    Default rule: the element at index ``floor(p * n)`` of the sorted group, the last one at the
    end. With ``interpolate`` the position is ``p * (n - 1)`` between two neighbours.
    """
    cum = cumulative_counts(df, keys, value, weight=weight)
    n = F.col("_total")

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_cum") > index, F.col("_v")))

    aggs = []
    for name, p in probabilities.items():
        if interpolate:
            pos = F.lit(float(p)) * (n - 1)
            low, high = at(F.floor(pos)), at(F.ceil(pos))
            share = F.max(pos - F.floor(pos))
            aggs.append((low + (high - low) * share).alias(name))
        else:
            aggs.append(at(F.least(F.floor(F.lit(float(p)) * n), n - 1)).alias(name))
    return cum.groupBy(*keys).agg(*aggs) if keys else cum.agg(*aggs)


def global_rank(
    df: DataFrame,
    value: str,
    rank: str | None = None,
    percent: str | None = None,
    below_share: str | None = None,
    keys: Sequence[str] = (),
    segment: Callable[[Column], Column] = log_segment,
) -> DataFrame:
    """Ascending ``rank()``, ``percent_rank()`` and share of strictly smaller values, group-wide.

    Works on the distinct values, so no window spans the whole table; rows get their rank back by
    an equality join on the value.
    """
    cum = cumulative_counts(df, keys, F.col(value), segment)
    below = F.col("_cum") - F.col("_cnt")
    outs = []
    if rank:
        outs.append((below + 1).cast("bigint").alias(rank))
    if percent:
        outs.append(F.when(F.col("_total") > 1, below / (F.col("_total") - 1)).otherwise(F.lit(0.0)).alias(percent))
    if below_share:
        outs.append((below / F.col("_total")).alias(below_share))
    ranks = cum.select(*keys, F.col("_v").alias(value), *outs)
    return df.join(ranks, [*keys, value], "left")


def percent_ranks(df: DataFrame, row_id: str, measures: Mapping[str, Column]) -> DataFrame:
    """``percent_rank()`` of several measures over the whole table in one pass, joined back by ``row_id``.

    The measures are stacked as (measure, value) rows so one counting scan serves all of them.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("_m"), c.cast("double").alias("_x")) for n, c in measures.items()])
    stacked = df.select(row_id, F.explode(cells).alias("_c")).select(row_id, "_c.*")
    cum = cumulative_counts(stacked, ["_m"], F.col("_x"))
    below = F.col("_cum") - F.col("_cnt")
    share = F.when(F.col("_total") > 1, below / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    ranked = stacked.join(cum.select("_m", F.col("_v").alias("_x"), share.alias("_p")), ["_m", "_x"])
    wide = ranked.groupBy(row_id).agg(*[F.max(F.when(F.col("_m") == n, F.col("_p"))).alias(n) for n in measures])
    return df.join(wide, row_id, "left")
