"""Trader integrity checks: regular timing, streaks, implausible results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import count_if, div
from tradelens.operators.scan import ordered_scan, time_segment

STATUS_IMPACT = 100.0


def interval_regularity(trades: DataFrame, min_intervals: int = 10, segment_seconds: int = 3600) -> DataFrame:
    """Mean and coefficient of variation of the gaps between all of a trader's trades, found segment by segment."""
    scan = ordered_scan(trades.select("username", "ts", "event_key"), ["username"], time_segment("ts", segment_seconds), ["ts", "event_key"],
                        previous={"before": F.unix_millis("ts")})
    gaps = scan.withColumn("gap", F.unix_millis("ts") - F.col("before")).filter("gap > 0")
    stats = gaps.groupBy("username").agg(
        F.count(F.lit(1)).alias("intervals"), F.avg("gap").alias("avg_interval_ms"), F.stddev_pop("gap").alias("_sd"))
    return stats.filter(F.col("intervals") >= min_intervals).withColumn("cv", F.coalesce(div("_sd", "avg_interval_ms"), F.lit(0.0))).withColumn(
        "suspicious", (F.col("cv") < 0.1) & (F.col("avg_interval_ms") < 5000)).drop("_sd")


def streaks(results: DataFrame, won: Column) -> DataFrame:
    """Longest run of wins and of losses per user in (ts, event_key) order.

    A run is a set of rows with equal difference between the row number and the running win count.
    """
    flag = F.when(won, 1).otherwise(0)
    scan = ordered_scan(
        results.select("username", "ts", "event_key", flag.alias("won")), ["username"], time_segment("ts"), ["ts", "event_key"],
        sums={"_n": F.lit(1), "_w": F.col("won")})
    island = F.when(F.col("won") == 1, F.col("_n") - F.col("_w")).otherwise(F.col("_w"))
    runs = scan.groupBy("username", "won", island.alias("island")).agg(F.count(F.lit(1)).alias("length"))
    longest = lambda v: F.coalesce(F.max(F.when(F.col("won") == v, F.col("length"))), F.lit(0).cast("bigint"))
    return runs.groupBy("username").agg(longest(1).alias("max_win_streak"), longest(0).alias("max_loss_streak"))


def integrity_alerts(results: DataFrame, trades: DataFrame, won: Column, min_trades: int = 30, max_win_rate: float = 0.85,
                     sharpe_limit: float = 5.0, max_streak: int = 20) -> DataFrame:
    """One row per failed check of a trader, with severity and impact on the integrity score.

    ``results`` are trades with a ``ret`` value; ``won`` says which of them count as wins.
    """
    n = F.count(F.lit(1))
    stats = results.groupBy("username").agg(
        n.alias("n"), div(count_if(won), n).alias("win_rate"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"))
    spread = trades.groupBy("username").agg(n.alias("trades"), F.count_distinct("market_slug").alias("markets"))
    joined = (
        spread.join(stats, "username", "left").join(interval_regularity(trades), "username", "left")
        .join(streaks(results, won), "username", "left"))
    rate = F.col("win_rate")
    enough = F.col("n") >= min_trades
    level = F.when(rate > 0.98, "CRITICAL").when(rate > 0.95, "HIGH").otherwise("MEDIUM")
    sharpe = div("mean", F.nullif(F.round("std", 9), F.lit(0.0)))
    alert = lambda kind, severity, impact, value: F.struct(
        F.lit(kind).alias("anomaly_type"), severity.alias("severity"), impact.alias("integrity_impact"), value.cast("double").alias("evidence"))
    checks = [
        F.when(enough & (rate > max_win_rate),
               alert("WIN_RATE_ANOMALY", level, F.when(rate > 0.98, 30.0).otherwise(15.0), rate)),
        F.when(F.col("suspicious"), alert("TIMING_PATTERN", F.lit("MEDIUM"), F.lit(10.0), F.col("cv"))),
        F.when((F.col("trades") > 100) & (F.col("markets") == 1), alert("VOLUME_INFLATION", F.lit("LOW"), F.lit(5.0), F.col("trades"))),
        F.when(enough & (sharpe > sharpe_limit), alert("SCORE_GAMING", F.lit("HIGH"), F.lit(25.0), sharpe)),
        F.when(F.col("max_win_streak") > max_streak, alert("WIN_STREAK", F.lit("MEDIUM"), F.lit(15.0), F.col("max_win_streak"))),
    ]
    return joined.select("username", F.explode(F.array_compact(F.array(*checks))).alias("a")).select("username", "a.*")


def trader_integrity(alerts: DataFrame, population: DataFrame) -> DataFrame:
    """Score and status of every trader; no alerts means a clean 100."""
    level = lambda s: count_if(F.col("severity") == s)
    hit = alerts.groupBy("username").agg(
        F.count(F.lit(1)).alias("anomaly_count"), level("CRITICAL").alias("critical"), level("HIGH").alias("high"),
        F.sum("integrity_impact").alias("impact"))
    rows = population.select("username").distinct().join(hit, "username", "left").fillna(
        {"anomaly_count": 0, "critical": 0, "high": 0, "impact": 0.0})
    status = F.when(F.col("critical") > 0, "BLACKLISTED").when(F.col("high") >= 2, "SUSPENDED").when(
        F.col("anomaly_count") > 0, "FLAGGED").otherwise("TRUSTED")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(STATUS_IMPACT) - F.col("impact")))
    return rows.select("username", score.alias("score"), status.alias("status"), "anomaly_count", "critical", "high")
