"""Trader-level aggregates: activity, PnL from resolutions, leaderboards, categories, platform health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import above_zero, count_if, div, div0, ladder, sum_if

TRADER = "proxy_address"


def since(as_of: Column, **span: int) -> Column:
    """Timestamps at or after ``as_of`` minus the span (days=, hours=)."""
    seconds = span.get("days", 0) * 86_400 + span.get("hours", 0) * 3_600
    return F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def activity_summary(trades: DataFrame, as_of: Column) -> DataFrame:
    """Counts and volume per trader over the last day, week, month and in total, in one scan."""
    day, week, month = since(as_of, days=1), since(as_of, days=7), since(as_of, days=30)
    return trades.groupBy(TRADER, "username").agg(
        F.count(F.lit(1)).alias("trades_total"), count_if(day).alias("trades_24h"), count_if(week).alias("trades_7d"),
        count_if(month).alias("trades_30d"), F.sum("notional").alias("volume_total"),
        sum_if("notional", day).alias("volume_24h"), sum_if("notional", week).alias("volume_7d"),
        F.count_distinct("market_slug").alias("unique_markets"), F.min("ts").alias("first_trade"), F.max("ts").alias("last_trade"))


def platform_stats(trades: DataFrame, bucket: Column) -> DataFrame:
    return trades.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count_distinct(TRADER).alias("unique_traders"),
        F.sum("notional").alias("total_volume"), F.count_distinct("market_slug").alias("unique_markets"))


def ingestion_health(trades: DataFrame, as_of: Column) -> DataFrame:
    """One row: recent counts, lag and a status.

    Lag over 5 minutes or a trade rate under half the daily average degrades; lag over 15 minutes or
    an idle hour is unhealthy.
    """
    hour, day = since(as_of, hours=1), since(as_of, hours=24)
    base = trades.agg(
        count_if(hour).alias("trades_last_hour"), count_if(day).alias("trades_last_24h"),
        F.count_distinct(F.when(day, F.col(TRADER))).alias("traders_last_24h"),
        F.count_distinct(F.when(day, F.col("market_slug"))).alias("markets_covered"),
        F.max("ts").alias("latest_trade_at"))
    lag = F.coalesce(F.unix_seconds(as_of) - F.unix_seconds("latest_trade_at"), F.lit(0).cast("bigint"))
    rate = F.col("trades_last_24h") / F.lit(24.0)
    slow = (F.col("trades_last_hour") < rate * 0.5) & (rate > 0)
    status = F.when((lag > 900) | (F.col("trades_last_hour") == 0), "unhealthy").when(
        (lag > 300) | slow, "degraded").otherwise("healthy")
    return base.withColumns({
        "ingestion_lag_seconds": lag, "avg_trades_per_hour": F.round(rate, 1), "status": status,
        "freshness": ladder(lag, [(60, "fresh"), (300, "recent"), (900, "stale")], "very_stale", "<=")})


# ---- PnL from resolutions --------------------------------------------------------------------


def position_pnl(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Realised PnL per (trader, condition, outcome) of resolved markets; dust is dropped.

    Trades are aggregated to positions before they meet the resolutions.
    """
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    done = resolutions.filter("is_resolved").select("condition_id", "winning_outcome_index", "resolution_time")
    keys = [TRADER, "username", "condition_id", "market_slug", "outcome", "outcome_index"]
    flow = lambda c: F.sum(F.when(buy, F.col(c)).otherwise(-F.col(c)))
    grouped = trades.groupBy(*keys).agg(
        flow("size").alias("net_shares"), flow("notional").alias("net_cost"),
        F.coalesce(div(sum_if("notional", buy), sum_if("size", buy)), F.lit(0.0)).alias("avg_entry_price"),
        count_if(buy).alias("buy_count"), count_if(sell).alias("sell_count"),
        F.min("ts").alias("first_trade_at"), F.max("ts").alias("last_trade_at"))
    price = F.when(F.col("outcome_index") == F.col("winning_outcome_index"), 1.0).otherwise(0.0)
    return (
        grouped.join(done, "condition_id")
        .filter((F.abs("net_shares") > 0.001) | (F.abs("net_cost") > 0.01))
        .withColumns({"settlement_price": price, "realized_pnl": price * F.col("net_shares") - F.col("net_cost")})
        .drop("winning_outcome_index")
    )


def trader_pnl(positions: DataFrame) -> DataFrame:
    won, lost = above_zero("realized_pnl"), F.round("realized_pnl", 9) < 0
    n = F.count(F.lit(1))
    return positions.groupBy(TRADER).agg(
        F.max("username").alias("username"), F.sum("realized_pnl").alias("total_realized_pnl"),
        n.alias("total_positions_closed"), count_if(won).alias("winning_positions"),
        count_if(lost).alias("losing_positions"), div0(count_if(won), n).alias("win_rate"))


def pnl_summary(pnl: DataFrame) -> DataFrame:
    total = F.col("total_realized_pnl")
    return pnl.agg(
        F.count(F.lit(1)).alias("total_traders"), F.sum(total).alias("total_pnl"), F.avg(total).alias("avg_pnl"),
        count_if(above_zero(total)).alias("profitable_traders"), count_if(F.round(total, 9) < 0).alias("losing_traders"),
        F.avg("win_rate").alias("avg_win_rate"))


def top_traders(pnl: DataFrame, limit: int = 20) -> DataFrame:
    return pnl.orderBy(F.desc("total_realized_pnl"), TRADER).limit(limit)


def resolution_stats(markets: DataFrame, resolved: Column, winner: Column) -> DataFrame:
    return markets.agg(
        F.count(F.lit(1)).alias("total_markets"), count_if(resolved).alias("resolved_markets"),
        count_if(winner.isin("Yes", "Up")).alias("yes_winners"), count_if(winner.isin("No", "Down")).alias("no_winners"))


def trader_metrics(trades: DataFrame, pnl: DataFrame, min_trades: int = 10, limit: int | None = None) -> DataFrame:
    """One row per trader with enough trades; with a limit, those of the largest volume."""
    grouped = trades.groupBy(TRADER, "username").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("notional").alias("total_volume_usd"),
        F.count_distinct("market_slug").alias("unique_markets"),
        F.min("ts").alias("first_trade_at"), F.max("ts").alias("last_trade_at"),
        (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days_active"),
        count_if(F.col("side") == "BUY").alias("buy_count"), count_if(F.col("side") == "SELL").alias("sell_count"),
        F.avg("notional").alias("avg_trade_size"), F.avg("price").alias("avg_price"),
    ).filter(F.col("total_trades") >= min_trades)
    joined = grouped.join(pnl.select(TRADER, F.col("total_realized_pnl").alias("total_pnl")), TRADER, "left").withColumn(
        "total_pnl", F.coalesce("total_pnl", F.lit(0.0)))
    return joined.orderBy(F.desc("total_volume_usd"), TRADER).limit(limit) if limit else joined


def strategy_indicators(trades: DataFrame) -> DataFrame:
    """Share of markets traded on both outcomes and share of buys on the first outcome."""
    buys = F.col("side") == "BUY"
    per_market = trades.groupBy(TRADER, "condition_id").agg(
        F.count_distinct("outcome_index").alias("outcomes"), count_if(buys).alias("buys"),
        count_if(buys & (F.col("outcome_index") == 0)).alias("first_buys"))
    return per_market.groupBy(TRADER).agg(
        (count_if(F.col("outcomes") >= 2) / F.count(F.lit(1))).alias("complete_set_ratio"),
        F.coalesce(div(F.sum("first_buys"), F.sum("buys")), F.lit(0.5)).alias("direction_bias"))


# ---- leaderboards ----------------------------------------------------------------------------


def eligible_traders(scores: DataFrame, profiles: DataFrame, pnl: DataFrame, ml: DataFrame) -> DataFrame:
    """Score rows with profile, PnL and ML columns; what is missing counts as zero."""
    p = profiles.select(TRADER, "total_trades", "total_volume_usd", "days_active", "unique_markets", "first_trade_at",
                        "last_trade_at")
    m = ml.select(TRADER, "ml_score", "ml_tier", "predicted_sharpe")
    joined = scores.join(p, TRADER, "left").join(pnl.drop("version", "username"), TRADER, "left").join(m, TRADER, "left")
    zeros = {"total_trades": 0, "days_active": 0, "unique_markets": 0, "total_volume_usd": 0.0, "total_realized_pnl": 0.0,
             "win_rate": 0.0, "closed_positions": 0}
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(z).cast(dict(joined.dtypes)[c])) for c, z in zeros.items()})


def leaderboard(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    return scores.join(profiles.select(TRADER, "total_volume_usd", "total_trades"), TRADER, "left")


def leaderboard_pnl(scores: DataFrame, profiles: DataFrame, pnl: DataFrame) -> DataFrame:
    return leaderboard(scores, profiles).join(
        pnl.select(TRADER, F.col("total_realized_pnl").alias("realized_pnl"), "win_rate", "closed_positions"), TRADER, "left",
    ).withColumns({"realized_pnl": F.coalesce("realized_pnl", F.lit(0.0)), "win_rate": F.coalesce("win_rate", F.lit(0.0)),
                   "closed_positions": F.coalesce("closed_positions", F.lit(0).cast("bigint"))})


def leaderboard_ml(scores: DataFrame, profiles: DataFrame, ml: DataFrame) -> DataFrame:
    """The ML score and tier override the rule-based ones where present."""
    m = ml.select(TRADER, "ml_score", "ml_tier", "predicted_sharpe", "model_version")
    return leaderboard(scores, profiles).join(m, TRADER, "left").withColumns({
        "smart_money_score": F.coalesce("ml_score", F.col("total_score").cast("double")),
        "tier": F.coalesce("ml_tier", "tier"),
        "predicted_sharpe": F.coalesce("predicted_sharpe", F.lit(0.0)),
        "model_version": F.coalesce("model_version", F.lit("rule-based")),
    }).drop("ml_score", "ml_tier")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# ---- clusters and tiers ----------------------------------------------------------------------


def cluster_summary(ml: DataFrame, anomaly_cut: float = 0.9) -> DataFrame:
    return ml.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("trader_count"), count_if(F.col("anomaly_score") >= anomaly_cut).alias("anomaly_count"),
        F.avg("anomaly_score").alias("avg_anomaly_score"))


def cluster_performance(ml: DataFrame, profiles: DataFrame, scores: DataFrame, pnl: DataFrame) -> DataFrame:
    joined = (
        ml.select(TRADER, "cluster_id").join(profiles.select(TRADER, "total_volume_usd"), TRADER, "left")
        .join(scores.select(TRADER, "total_score"), TRADER, "left").join(pnl.select(TRADER, "total_realized_pnl"), TRADER, "left"))
    gain = count_if(F.col("total_realized_pnl") > 0)
    return joined.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("trader_count"), F.avg("total_realized_pnl").alias("avg_pnl"),
        F.sum("total_realized_pnl").alias("total_pnl"), F.avg("total_score").alias("avg_smart_money_score"),
        F.avg("total_volume_usd").alias("avg_volume"), gain.alias("profitable_traders"),
        div0(gain, F.count(F.lit(1))).alias("profitable_ratio"))


def replicability(clusters: DataFrame, flag: str, label: str, size: str) -> DataFrame:
    """Clusters grouped by whether they can be copied, with their labels as one string."""
    return clusters.groupBy(flag).agg(
        F.count(F.lit(1)).alias("cluster_count"), F.sum(size).alias("total_traders"),
        F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("strategy_types"))


TIERS = ("DIAMOND", "GOLD", "SILVER", "BRONZE")


def tier_distribution(scores: DataFrame) -> DataFrame:
    """Traders per tier in tier order; a tier without traders shows as zero."""
    spark = scores.sparkSession
    tiers = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TIERS)], "tier_order int, tier string")
    counts = scores.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("total_score").alias("avg_score"))
    shown = tiers.join(counts, "tier", "left").withColumn("trader_count", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")
    total = F.sum("trader_count").over(Window.partitionBy(F.lit(1)))
    return shown.withColumn("percentage", div0(F.col("trader_count") * 100.0, total))


def ml_health(scores: DataFrame, ml: DataFrame, as_of: Column) -> DataFrame:
    """Share of scored traders that carry an ML row and the age of the newest score."""
    joined = scores.join(ml.select(TRADER, F.lit(True).alias("_ml")), TRADER, "left")
    n, covered = F.count(F.lit(1)), count_if(F.col("_ml").isNotNull())
    newest = F.max("calculated_at")
    age = (F.unix_seconds(as_of) - F.unix_seconds(newest)) / F.lit(3600.0)
    return joined.agg(
        n.alias("scored_traders"), covered.alias("enriched_traders"), div0(covered, n).alias("coverage"),
        newest.alias("last_scored_at"), age.alias("hours_since_scoring"),
        F.when(age <= 24, "fresh").when(age <= 72, "stale").otherwise("outdated").alias("freshness"))


# ---- categories ------------------------------------------------------------------------------


def category_distribution(trades: DataFrame, classes: DataFrame) -> DataFrame:
    """Volume share of each category per trader. Trades shrink to (trader, market) before the join."""
    per_market = trades.groupBy(TRADER, "username", "market_slug").agg(
        F.sum("notional").alias("v"), F.count(F.lit(1)).alias("n"))
    named = per_market.join(classes.select("market_slug", "category"), "market_slug", "left").withColumn(
        "category", F.coalesce("category", F.lit("OTHER")))
    grouped = named.groupBy(TRADER, "username", "category").agg(F.sum("v").alias("volume"), F.sum("n").alias("trade_count"))
    return grouped.withColumn("concentration", div0("volume", F.sum("volume").over(Window.partitionBy(TRADER))))


def category_profiles(distribution: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("category", "concentration")))
    return distribution.groupBy(TRADER).agg(F.map_from_entries(pairs).alias("profile"))


def concentrated_in(distribution: DataFrame, categories: Sequence[str], min_share: float) -> DataFrame:
    share = sum_if("concentration", F.col("category").isin(*categories))
    return distribution.groupBy(TRADER).agg(share.alias("category_concentration")).filter(
        F.col("category_concentration") >= min_share)


def category_stats(trades: DataFrame, classes: DataFrame) -> DataFrame:
    named = trades.join(classes.select("market_slug", "category"), "market_slug", "left")
    return named.groupBy(F.coalesce("category", F.lit("UNCLASSIFIED")).alias("category")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.count_distinct(TRADER).alias("unique_traders"),
        F.count_distinct("market_slug").alias("unique_markets"), F.sum("notional").alias("total_volume"),
        F.min("ts").alias("first_trade"), F.max("ts").alias("last_trade"))


def classify_markets(markets: DataFrame, patterns: dict[str, Sequence[str]], known: DataFrame | None = None,
                     text: Column | None = None) -> DataFrame:
    """Category with most pattern hits per distinct, not yet classified market; the first wins ties.

    Confidence grows by a quarter per hit; all matched patterns are kept.
    """
    slugs = markets.select("market_slug").distinct()
    if known is not None:
        slugs = slugs.join(known.select("market_slug"), "market_slug", "left_anti")
    words = F.lower(F.concat(F.regexp_replace("market_slug", "-", " "), F.lit(" "))) if text is None else text
    staged = slugs.withColumn("_t", words)
    hit_arrays = {c: F.array_compact(F.array(*[F.when(F.col("_t").rlike(p), p) for p in ps])) for c, ps in patterns.items()}
    staged = staged.withColumns({f"_h{i}": a for i, a in enumerate(hit_arrays.values())})
    best = reduce(
        lambda acc, i: F.when(F.size(f"_h{i}") > F.size(acc["hits"]),
                              F.struct(F.lit(list(patterns)[i]).alias("category"), F.col(f"_h{i}").alias("hits"))).otherwise(acc),
        range(len(patterns)),
        F.struct(F.lit("OTHER").alias("category"), F.array().cast("array<string>").alias("hits")))
    staged = staged.withColumn("_b", best)
    return staged.select(
        "market_slug", F.col("_b.category").alias("category"),
        F.least(F.lit(1.0), F.size("_b.hits") * F.lit(0.25)).alias("confidence"),
        F.array_join("_b.hits", ",").alias("matched_patterns"))


# ---- misc ------------------------------------------------------------------------------------


def recent_activity(trades: DataFrame, scores: DataFrame, min_score: int, limit: int) -> DataFrame:
    """Latest trades by traders with a high score."""
    good = scores.filter(F.col("total_score") >= min_score).select(TRADER, "total_score", "tier")
    return trades.join(good, TRADER).orderBy(F.desc("ts"), "event_key").limit(limit)


