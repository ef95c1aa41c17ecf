"""Screens for under-noticed traders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import div0
from tradelens.operators.keysets import with_benchmark
from tradelens.operators.quantiles import percent_ranks


def percentile_screens(traders: DataFrame, min_sharpe: float = 1.5, max_volume: float = 50_000, min_trades: int = 30) -> DataFrame:
    """Percent ranks of quality and of low visibility among the eligible traders."""
    rows = traders.filter(
        (F.col("sharpe_ratio") >= min_sharpe) & (F.col("total_volume_usd") <= max_volume) & (F.col("total_trades") >= min_trades)
    )
    return percent_ranks(rows, "proxy_address", {
        "sharpe_percentile": F.col("sharpe_ratio"), "winrate_percentile": F.col("win_rate"),
        "pnl_percentile": F.col("total_realized_pnl"), "visibility_percentile": -F.round("total_volume_usd", 6)})


def hidden_gems(screened: DataFrame, limit: int | None = 50) -> DataFrame:
    """Top 30 % on one quality measure and in the low-volume half."""
    s, w, p, v = (F.col(c) for c in ("sharpe_percentile", "winrate_percentile", "pnl_percentile", "visibility_percentile"))
    visibility = F.least(F.lit(100.0), (1 - v) * 100)
    rate = F.col("total_trades") / F.greatest(F.lit(1), F.col("days_active"))
    gem = F.least(F.lit(100.0), F.least(F.lit(50.0), F.col("sharpe_ratio") * 20) + (F.lit(50.0) - visibility / 2))
    out = screened.filter(((s >= 0.7) | (w >= 0.7) | (p >= 0.7)) & (v >= 0.5)).withColumns({
        "composite": F.round((s + w + p) / 3 - (1 - v), 9),
        "visibility_score": visibility,
        "quality_score": s * 40 + w * 30 + p * 30,
        "discovery_score": gem,
        "edge_persistence": F.least(F.lit(0.9), F.lit(0.5) + rate * 0.05 + F.col("win_rate") * 0.2),
    })
    return out.orderBy(F.desc("composite"), "proxy_address").limit(limit) if limit else out


def rising_stars(traders: DataFrame, max_days: int = 30, min_win_rate: float = 0.6, min_sharpe: float = 1.0, min_trades: int = 10,
                 established_days: int = 30, limit: int | None = 50) -> DataFrame:
    """New traders who beat the average of established ones, weighted by newness."""
    per_day = F.col("total_realized_pnl") / F.greatest(F.col("days_active"), F.lit(1))
    bench = traders.filter(F.col("days_active") >= established_days).agg(
        F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("win_rate").alias("avg_winrate"), F.avg(per_day).alias("avg_pnl_per_day"))
    young = traders.filter(
        (F.col("days_active") <= max_days) & (F.col("win_rate") >= min_win_rate) & (F.col("sharpe_ratio") >= min_sharpe)
        & (F.col("total_trades") >= min_trades))
    s = F.col("sharpe_ratio") / F.greatest(F.col("avg_sharpe"), F.lit(0.1))
    w = F.col("win_rate") / F.greatest(F.col("avg_winrate"), F.lit(0.1))
    rows = with_benchmark(young, bench).filter(
        (F.col("sharpe_ratio") >= F.col("avg_sharpe") * 1.2) | (F.col("win_rate") >= F.col("avg_winrate") * 1.1)
    ).withColumns({"sharpe_vs_avg": s, "winrate_vs_avg": w,
                   "pnl_vs_avg": per_day / F.greatest(F.col("avg_pnl_per_day"), F.lit(1.0))})
    s, w, days = F.col("sharpe_vs_avg"), F.col("winrate_vs_avg"), F.col("days_active")
    base = F.least(F.lit(100.0), F.greatest(F.lit(0), F.lit(30) - days) + F.col("win_rate") * 40 + F.col("sharpe_ratio") * 20)
    bonus = F.least(F.lit(20.0), (s - 1) * 10 + (w - 1) * 10)
    gain = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (s - 1) * 0.5) + F.greatest(F.lit(0.0), (w - 1) * 0.5))
    out = rows.withColumns({
        "composite": F.round((s + w) * (1 + (F.lit(float(max_days)) - days) / max_days), 9),
        "discovery_score": F.least(F.lit(100.0), base + bonus),
        "acceleration": gain,
        "edge_persistence": F.least(F.lit(0.7), F.lit(0.3) + F.col("win_rate") * 0.3 + gain * 0.2),
        "visibility_score": F.greatest(F.lit(10), F.lit(40) - days),
    })
    return out.orderBy(F.desc("composite"), "proxy_address").limit(limit) if limit else out


def niche_specialists(traders: DataFrame, max_markets: int = 5, min_trades: int = 20, min_sharpe: float = 1.0, limit: int = 50) -> DataFrame:
    focus = div0(F.lit(1.0), F.greatest(F.lit(1), F.col("unique_markets")))
    return traders.filter(
        (F.col("unique_markets") <= max_markets) & (F.col("total_trades") >= min_trades) & (F.col("sharpe_ratio") >= min_sharpe)
    ).withColumn("discovery_score", F.least(F.lit(100.0), F.col("sharpe_ratio") * 30 + focus * 40)).orderBy(
        F.desc("sharpe_ratio"), "proxy_address").limit(limit)


def contrarians(traders: DataFrame, strategies=("DIRECTIONAL_FUNDAMENTAL", "EVENT_DRIVEN"), min_sharpe: float = 0.5,
                min_trades: int = 20, limit: int = 50) -> DataFrame:
    pnl = F.col("total_realized_pnl")
    score = F.col("sharpe_ratio") * 30 + F.log10(F.greatest(F.lit(1.0), pnl)) * 10
    return traders.filter(
        F.col("strategy_type").isin(*strategies) & (pnl > 0) & (F.col("sharpe_ratio") >= min_sharpe) & (F.col("total_trades") >= min_trades)
    ).withColumn("discovery_score", F.least(F.lit(100.0), score)).orderBy(F.desc("total_realized_pnl"), "proxy_address").limit(limit)
