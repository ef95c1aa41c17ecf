"""Ordered prefix operators that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends all rows of one key to one task. Here each
key is cut into ordered segments. Rows are windowed inside ``(key, segment)``, segments are summed up
with an ordinary two-phase aggregate, and the small table of segment totals carries the running
state from one segment to the next. The result equals the plain window row for row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import epoch_micros

DAY_SECONDS = 86_400
SEG = "_seg"


def time_segment(ts: Column | str, seconds: int = DAY_SECONDS) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key in ``order``.

    ``segment`` must never decrease along ``order``. ``sums`` and ``maxes`` include the current
    row, ``previous`` is the value on the row before (NULL on the first), ``last_known`` the latest
    non-null value up to the current row, and ``totals`` the sum over the whole key. A row
    whose key or segment is NULL has no place in the order: it is kept, its running columns are NULL.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    previous, last_known, totals = dict(previous or {}), dict(last_known or {}), dict(totals or {})
    keys, order = list(keys), list(order)
    by = [*keys, SEG]

    staged = df.withColumn(SEG, segment)
    inputs = {f"_in_{n}": c for n, c in {**sums, **maxes, **previous, **last_known, **totals}.items()}
    staged = staged.withColumns(inputs)
    position = F.struct(*order)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_in_{n}").alias(f"_t_{n}") for n in {**sums, **totals}]
    aggs += [F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes]
    if previous:
        aggs.append(F.max_by(F.struct(*[F.col(f"_in_{n}") for n in previous]), position).alias("_t_prev"))
    aggs += [
        F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_t_{n}") for n in last_known
    ]
    segments = staged.groupBy(*by).agg(*aggs)

    across = Window.partitionBy(*keys).orderBy(SEG)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = [F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums]
    carried += [F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes]
    if previous:
        carried.append(F.lag("_t_prev").over(across).alias("_c_prev"))
    carried += [F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last_known]
    carried += [F.sum(f"_t_{n}").over(whole).alias(n) for n in totals]
    offsets = segments.select(*by, *carried)

    inside = Window.partitionBy(*by).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_w_{n}": F.sum(f"_in_{n}").over(running) for n in sums}
    local.update({f"_w_{n}": F.max(f"_in_{n}").over(running) for n in maxes})
    local.update({f"_w_{n}": F.last(f"_in_{n}", ignorenulls=True).over(running) for n in last_known})
    if previous:
        local["_w_prev"] = F.lag(F.struct(*[F.col(f"_in_{n}") for n in previous])).over(inside)
    joined = staged.withColumns(local).join(offsets, by, "left")

    out = {}
    for n in sums:
        out[n] = F.coalesce(f"_w_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))
    for n in maxes:
        out[n] = F.greatest(f"_w_{n}", f"_c_{n}")
    for n in last_known:
        out[n] = F.coalesce(f"_w_{n}", f"_c_{n}")
    if previous:
        out.update({n: F.coalesce("_w_prev", "_c_prev")[f"_in_{n}"] for n in previous})
    placed = F.col(SEG).isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    out = {n: F.when(placed, c) for n, c in out.items()}
    return joined.withColumns(out).select(*df.columns, *out, *totals)
