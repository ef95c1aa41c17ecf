"""As-of joins: the latest (or nearest) row of the right side at each left timestamp."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import epoch_micros
from tradelens.operators.scan import DAY_SECONDS, SEG, time_segment
from tradelens.session import checkpointed


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_cols: Sequence[str] | None = None,
    prefix: str = "",
    tie: Sequence[str] = (),
    segment_seconds: int = DAY_SECONDS,
    direction: str = "backward",
) -> DataFrame:
    """Left join each left row with the latest right row at or before it (``backward``) or the
    earliest at or after it (``forward``).

    Both sides are stacked and scanned once in time order, cut into time segments per key so that a
    hot key spreads over many tasks; the last right row of a segment is carried into the next ones.
    ``tie`` orders right rows that share a timestamp. Left rows with a NULL key go round the scan.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    cols = list(right_cols or [c for c in right.columns if c != right_key])
    sign = 1 if direction == "backward" else -1
    quote = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in cols])
    quote_type = right.select(quote.alias("q")).schema["q"].dataType
    ties = [F.col(c) for c in tie]

    tagged_right = right.filter(F.col(right_key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(right_key).alias("_k"),
        F.col(right_ts).alias("_ts"),
        (epoch_micros(right_ts) * sign).alias("_o"),
        F.lit(0).alias("_side"),
        (F.struct(*ties) if ties else F.struct(F.lit(0).alias("_z"))).alias("_tie"),
        quote.alias("_quote"),
    )
    keyed = left.filter(F.col(left_key).isNotNull() & F.col(left_ts).isNotNull())
    loose = left.filter(F.col(left_key).isNull() | F.col(left_ts).isNull())
    tagged_left = keyed.select(
        F.col(left_key).alias("_k"),
        F.col(left_ts).alias("_ts"),
        (epoch_micros(left_ts) * sign).alias("_o"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    segment = _signed_segment(sign, segment_seconds)
    rights, lefts = tagged_right.withColumn(SEG, segment), tagged_left.withColumn(SEG, segment)

    # Last quote before each segment. The left side adds only its distinct (key, segment) pairs, so
    # whatever joins built its other columns are pruned from this branch.
    last_quote = rights.groupBy("_k", SEG).agg(F.max_by("_quote", F.struct("_o", "_tie")).alias("_q"))
    wanted = keyed.select(F.col(left_key).alias("_k"), F.col(left_ts).alias("_ts")).withColumn(SEG, segment).select("_k", SEG).distinct()
    earlier = Window.partitionBy("_k").orderBy(SEG).rangeBetween(Window.unboundedPreceding, -1)
    carried = last_quote.unionByName(wanted.withColumn("_want", F.lit(True)), allowMissingColumns=True).withColumn(
        "_carry", F.last("_q", ignorenulls=True).over(earlier)).filter("_want").select("_k", SEG, "_carry")

    inside = Window.partitionBy("_k", SEG).orderBy("_o", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rights.unionByName(lefts, allowMissingColumns=True).withColumn(
        "_match", F.last("_quote", ignorenulls=True).over(inside)).filter("_side = 1")
    matched = scanned.join(carried, ["_k", SEG], "left").withColumn("_match", F.coalesce("_match", "_carry")).select("_left.*", "_match.*")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in quote_type.fields]
    return matched.unionByName(loose.select("*", *empty))


def _signed_segment(sign: int, seconds: int) -> Column:
    return time_segment("_ts", seconds) * F.lit(sign)


def asof_lookups(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str],
    right_key: str,
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_cols: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    segment_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """``asof_join`` of several keys of a row at once; ``keys`` names the left column of each prefix.

    The distinct (key, time) pairs of all keys are looked up in one scan of the right side, narrow and written once; each key then costs an equality
    join. So the right side is read for one scan whatever the number of keys, and the wide rows are never sorted with the quotes. Rows whose key or time is NULL get nulls.
    """
    cols = list(right_cols or [c for c in right.columns if c != right_key])
    asked = left.select(F.explode(F.array(*[F.col(k) for k in keys.values()])).alias("_key"), F.col(left_ts).alias("_when")).filter("_key IS NOT NULL AND _when IS NOT NULL").distinct()
    met = asof_join(asked, right, "_key", right_key, "_when", right_ts, cols, "_r_", tie, segment_seconds)
    met = checkpointed(met.select("_key", "_when", *[f"_r_{c}" for c in cols]))
    out = left
    for prefix, key in keys.items():
        quotes = met.select(F.col("_key").alias("_k"), F.col("_when").alias("_w"), *[F.col(f"_r_{c}").alias(f"{prefix}{c}") for c in cols])
        out = out.join(quotes, (F.col(key) == F.col("_k")) & (F.col(left_ts) == F.col("_w")), "left").drop("_k", "_w")
    return out


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_ts: str = "ts",
    right_ts: str = "ts",
    value_cols: Sequence[str] = (),
    tie: Sequence[str] = (),
    segment_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Nearest right row in either direction; the earlier one wins an equal distance.

    Both sides are stacked and dealt once per (key, segment); one shuffle serves the windows of both directions.
    Each window is a running one, so a segment costs its sort. Left rows with a NULL key or time get no match.
    """
    cols = [right_ts, *[c for c in value_cols if c != right_ts]]
    quote = F.struct(epoch_micros(right_ts).alias("_at"), *cols)
    ties = F.struct(*tie) if tie else F.struct(F.lit(0).alias("_z"))

    def placed(df: DataFrame, key: str, ts: str, side: int, *more: Column) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        return rows.select(F.col(key).alias("_k"), time_segment(ts, segment_seconds).alias(SEG), epoch_micros(ts).alias("_o"), F.lit(side).alias("_side"), *more)

    rights = placed(right, right_key, right_ts, 0, ties.alias("_tie"), quote.alias("_quote"))
    lefts = placed(left, left_key, left_ts, 1, F.struct(*left.columns).alias("_left"))
    loose = left.filter(F.col(left_key).isNull() | F.col(left_ts).isNull())

    # what the segments before and after a segment hold nearest to it
    ends = rights.groupBy("_k", SEG).agg(
        F.max_by("_quote", F.struct("_o", "_tie")).alias("_last"), F.max_by("_quote", F.struct(-F.col("_o"), "_tie")).alias("_first"))
    wanted = lefts.select("_k", SEG).distinct().withColumn("_want", F.lit(True))
    others = lambda order: Window.partitionBy("_k").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(wanted, allowMissingColumns=True).withColumns({
        "_before": F.last("_last", ignorenulls=True).over(others(F.asc(SEG))), "_after": F.last("_first", ignorenulls=True).over(others(F.desc(SEG))),
    }).filter("_want").select("_k", SEG, "_before", "_after")

    running = lambda order: Window.partitionBy("_k", SEG).orderBy(order, "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rights.unionByName(lefts, allowMissingColumns=True).withColumns({
        "_back": F.last("_quote", ignorenulls=True).over(running(F.asc("_o"))), "_ahead": F.last("_quote", ignorenulls=True).over(running(F.desc("_o")))})
    both = scanned.filter("_side = 1").join(carried, ["_k", SEG], "left").withColumns({
        "_back": F.coalesce("_back", "_before"), "_ahead": F.coalesce("_ahead", "_after")})
    back, ahead = F.col("_o") - F.col("_back._at"), F.col("_ahead._at") - F.col("_o")
    both = both.withColumns({"_near": F.when(ahead.isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_ahead"))})
    names = [f"nearest_{c}" for c in cols]
    delay = F.abs(F.col("_near._at") - F.col("_o")) / F.lit(1_000_000.0)
    matched = both.select("_left.*", *[F.col(f"_near.{c}").alias(n) for c, n in zip(cols, names, strict=True)], delay.alias("abs_delay_seconds"))
    return matched.unionByName(loose, allowMissingColumns=True)
