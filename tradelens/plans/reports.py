"""Per-user trade reports. Each takes the whole trade table and groups by user in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.functions.numeric import (avg_if, count_if, div, div0, int_div, max_if, seconds_between, sum_if)
from tradelens.operators.ordering import top_per
from tradelens.operators.quantiles import exact_quantiles, value_counts
from tradelens.operators.scan import ordered_scan, time_segment
from tradelens.session import checkpointed

NOTIONAL = "size * price"
TIMING_PROBS = {"p10_seconds_to_end": 0.1, "p50_seconds_to_end": 0.5, "p90_seconds_to_end": 0.9}


def user_trade_stats(trades: DataFrame) -> DataFrame:
    return trades.groupBy("username").agg(
        F.count(F.lit(1)).alias("trades"), F.min("ts").alias("first_trade_at"), F.max("ts").alias("last_trade_at"),
        F.count_distinct("market_slug").alias("unique_markets"), F.count_distinct("token_id").alias("unique_assets"),
        F.sum(F.expr(NOTIONAL)).alias("notional_usd"), F.avg("price").alias("avg_price"), F.avg("size").alias("avg_size"))


def breakdown(trades: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Trade counts per user by each of several columns in one scan, one row per (column, value)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("name")) for d in dims])
    return trades.select("username", F.explode(pairs).alias("d")).groupBy("username", "d.dimension", "d.name").agg(
        F.count(F.lit(1)).alias("trades"))


def top_markets(trades: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's markets by number of trades."""
    per = trades.groupBy("username", F.col("market_slug").alias("slug")).agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("trades"))
    return top_per(per, ["username"], [F.desc("trades"), F.asc("slug")], limit)


# ---- timing ----------------------------------------------------------------------------------


def with_timing(trades: DataFrame, low: int = -60, high: int = 3600) -> DataFrame:
    """15-minute trades with the seconds left until their window closes."""
    return trades.filter(C.is_15m("market_slug") & (C.slug_epoch("market_slug") > 0)).withColumns({
        "seconds_to_end": C.seconds_to_slug_end("market_slug", "ts"),
        "asset": C.asset_of("market_slug"),
    }).filter(F.col("seconds_to_end").between(low, high))


def timing_quantiles(timed: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    basic = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.min("seconds_to_end").alias("min_seconds_to_end"),
        F.max("seconds_to_end").alias("max_seconds_to_end"), F.avg("seconds_to_end").alias("avg_seconds_to_end"))
    quant = exact_quantiles(timed, keys, F.col("seconds_to_end"), TIMING_PROBS)
    return basic.join(quant, keys)


def timing_buckets(timed: DataFrame, width: int = 60) -> DataFrame:
    start = int_div(F.col("seconds_to_end"), width) * width
    return timed.groupBy("username", start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("price").alias("avg_price"), F.avg("size").alias("avg_size"),
    ).withColumn("bucket_end", F.col("bucket_start") + width)


def timing_pnl_buckets(timed: DataFrame, width: int = 60) -> DataFrame:
    start = int_div(F.col("seconds_to_end"), width) * width
    return timed.groupBy("username", start.alias("bucket_start")).agg(*pnl_columns()).withColumn(
        "bucket_end", F.col("bucket_start") + width)


# ---- realised PnL ----------------------------------------------------------------------------


def pnl_columns() -> list[Column]:
    done = F.col("realized_pnl").isNotNull()
    n, total, wins = count_if(done), sum_if("realized_pnl", done), count_if(F.col("realized_pnl") > 0)
    return [n.alias("resolved_trades"), total.alias("realized_pnl_usd"), div0(total, n).alias("avg_pnl_per_trade"),
            div0(wins, n).alias("win_rate")]


def realized_pnl_stats(enriched: DataFrame) -> DataFrame:
    done = F.col("realized_pnl").isNotNull()
    return enriched.groupBy("username").agg(
        *pnl_columns(), F.count_distinct(F.when(done, F.col("market_slug"))).alias("resolved_markets"),
        F.count_distinct("market_slug").alias("total_markets"))


def realized_pnl_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*pnl_columns(), F.sum(F.expr(NOTIONAL)).alias("notional_usd")).filter(
        "resolved_trades > 0")


# ---- execution -------------------------------------------------------------------------------


def execution_quality(enriched: DataFrame, eps: float = 1e-6) -> DataFrame:
    known, buy = C.book_known(), F.col("side") == "BUY"
    p, b, a, e = F.col("price"), F.col("best_bid_price"), F.col("best_ask_price"), F.lit(eps)
    return enriched.groupBy("username").agg(
        F.count(F.lit(1)).alias("trades"), count_if(known).alias("trades_with_tob"),
        div0(count_if(known), F.count(F.lit(1))).alias("tob_coverage"),
        count_if(known & buy & (p >= a - e)).alias("buy_taker_like"),
        count_if(known & buy & (p <= b + e)).alias("buy_maker_like"),
        count_if(known & buy & (p > b + e) & (p < a - e)).alias("buy_inside"),
        avg_if("spread", known).alias("avg_spread"), avg_if("price_minus_mid", known).alias("avg_price_minus_mid"))


MEASURES = ("spread", "tob_lag", "edge", "eff_spread", "eff_ratio")


def execution_report(enriched: DataFrame) -> DataFrame:
    """Distribution of five execution measures, one row per (user, side or ALL, measure).

    The measures are unpivoted so one exact-quantile pass serves all of them.
    """
    known = C.book_known() & (F.col("mid") > 0) & (F.col("spread") > 0)
    gap = F.col("mid") - F.col("price")
    eff = F.lit(2.0) * F.abs(gap)
    lag = F.unix_millis("tob_captured_at") - F.unix_millis("ts")
    item = lambda scope, name, v: F.struct(
        scope.alias("scope"), F.lit(name).alias("measure"), F.round(v.cast("double"), 6).alias("value"))
    every, side = F.lit("ALL"), F.col("side")
    long = enriched.filter(known).select("username", F.explode(F.array(
        item(every, "spread", F.col("spread")), item(every, "tob_lag", lag),
        item(side, "edge", F.when(side == "BUY", gap).otherwise(-gap)), item(side, "eff_spread", eff),
        item(side, "eff_ratio", div(eff, "spread")))).alias("m")).select("username", "m.*")
    keys = ["username", "scope", "measure"]
    counts = checkpointed(value_counts(long, keys, F.col("value")))
    basic = counts.groupBy(*keys).agg(
        F.sum("_cnt").alias("n"), (F.sum(F.col("_v") * F.col("_cnt")) / F.sum("_cnt")).alias("avg_value"), F.min("_v").alias("min_value"),
        F.max("_v").alias("max_value"))
    quant = exact_quantiles(counts, keys, F.col("_v"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}, weight=F.col("_cnt"))
    return basic.join(quant, keys)


# ---- activity --------------------------------------------------------------------------------


def activity_by(rows: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.expr(NOTIONAL)).alias("notional_usd"),
        F.avg("price").alias("avg_price"), F.avg("size").alias("avg_size"))


def selection_summary(trades: DataFrame) -> DataFrame:
    """How concentrated each user's trades are over markets: top 1/5/10 share and HHI."""
    per_market = trades.groupBy("username", "market_slug").agg(F.count(F.lit(1)).alias("n"))
    ranked = Window.partitionBy("username").orderBy(F.desc("n"), "market_slug")
    top = per_market.withColumn("rn", F.row_number().over(ranked)).filter("rn <= 10").groupBy("username").agg(
        max_if("n", F.col("rn") == 1).alias("top1_trades"),
        F.sum(F.when(F.col("rn") <= 5, F.col("n"))).alias("top5_trades"), F.sum("n").alias("top10_trades"))
    totals = per_market.groupBy("username").agg(
        F.sum("n").alias("trades"), F.count(F.lit(1)).alias("unique_markets"), F.sum(F.col("n") * F.col("n")).alias("_sq"))
    return totals.join(top, "username").select(
        "username", "trades", "unique_markets", "top1_trades", div0("top1_trades", "trades").alias("top1_share"),
        "top5_trades", div0("top5_trades", "trades").alias("top5_share"),
        "top10_trades", div0("top10_trades", "trades").alias("top10_share"),
        (F.col("_sq") / (F.col("trades") * F.col("trades"))).alias("market_hhi"))


def with_previous_trade(trades: DataFrame, keys: Sequence[str] = ("username",)) -> DataFrame:
    """The time and market of the trade before, per user in (ts, event_key) order."""
    return ordered_scan(trades, keys, time_segment("ts"), ["ts", "event_key"],
                        previous={"prev_ts": F.col("ts"), "prev_market_slug": F.col("market_slug")})


def market_churn(trades: DataFrame) -> DataFrame:
    """Market switches and seconds between trades per user. Trades are reduced once to counts per (user, seconds, switched); all figures come from those."""
    gaps = with_previous_trade(trades.select("username", "ts", "event_key", "market_slug"))
    counts = checkpointed(gaps.groupBy(
        "username", seconds_between("prev_ts", "ts").alias("delta"),
        F.coalesce(F.col("prev_ts").isNotNull() & (F.col("market_slug") != F.col("prev_market_slug")), F.lit(False)).alias("switched")).agg(F.count(F.lit(1)).alias("n")))
    n, switches = F.sum("n"), F.coalesce(F.sum(F.when(F.col("switched"), F.col("n"))), F.lit(0))
    basic = counts.groupBy("username").agg(
        n.alias("trades"), switches.alias("market_switches"), div0(switches, n - 1).alias("market_switch_rate"),
        div(F.sum(F.col("delta") * F.col("n")), F.sum(F.when(F.col("delta").isNotNull(), F.col("n")))).alias("avg_seconds_between_trades"))
    quant = exact_quantiles(counts, ["username"], F.col("delta"),
                            {"p50_seconds_between_trades": 0.5, "p90_seconds_between_trades": 0.9}, weight=F.col("n"))
    return basic.join(quant, "username", "left")


# ---- microstructure --------------------------------------------------------------------------


def microstructure_summary(flow: DataFrame, keys: Sequence[str]) -> DataFrame:
    active = F.col("volume_1m_before") > 0
    return flow.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("volume_1m_before").alias("avg_volume_1m_before"),
        F.avg("trades_1m_before").alias("avg_trade_count_1m_before"), F.avg("volume_1m_after").alias("avg_volume_1m_after"),
        F.avg("vwap_1m_before").alias("avg_vwap_1m_before"), F.avg("price").alias("avg_trade_price"),
        F.avg(F.col("price") - F.col("vwap_1m_before")).alias("avg_price_vs_vwap"),
        F.avg("price_range_1m_before").alias("avg_price_range_1m_before"),
        count_if(active).alias("trades_with_prior_activity"),
        div0(count_if(active), F.count(F.lit(1))).alias("prior_activity_coverage"))


def labels_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("username", "label_type").agg(
        F.count(F.lit(1)).alias("label_count"), F.count_distinct("label_value").alias("unique_values"),
        F.min("labeled_at").alias("first_labeled_at"), F.max("labeled_at").alias("last_labeled_at"),
        F.max_by("model_version", F.struct("labeled_at", "model_version")).alias("latest_model_version"))


