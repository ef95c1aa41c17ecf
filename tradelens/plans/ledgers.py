"""Ledger lists: what a dashboard shows newest or strongest first, and the counters of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import div0, sum_if
from tradelens.operators.latest import latest_per_key
from tradelens.operators.ordering import top_per
from tradelens.plans.signals import SEVERITY_RANK


def severity_rank() -> Column:
    level = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        level = F.when(F.col("severity") == name, rank).otherwise(level)
    return level


def open_anomalies(anomalies: DataFrame, states: Sequence[str] = ("OPEN", "INVESTIGATING")) -> DataFrame:
    """The newest version of each anomaly that is still open."""
    return latest_per_key(anomalies, ["alert_id"], ["version"]).filter(F.col("status").isin(*states)).withColumn("severity_rank", severity_rank())


def live_consensus(signals: DataFrame, as_of: Column, strengths: Sequence[str] = ("STRONG", "EXTREME")) -> DataFrame:
    return latest_per_key(signals, ["signal_id"], ["version"]).filter(F.col("strength").isin(*strengths) & (F.col("valid_until") > as_of))


def latest_discoveries(discoveries: DataFrame, as_of: Column, days: int = 7, limit: int = 50) -> DataFrame:
    recent = latest_per_key(discoveries, ["proxy_address"], ["version"]).filter(F.col("discovered_at") > as_of - F.make_dt_interval(F.lit(days)))
    return recent.orderBy(F.desc("discovery_score"), "proxy_address").limit(limit)


def current_index(history: DataFrame) -> DataFrame:
    """Members of the newest rebalancing of each index."""
    newest = history.groupBy("index_type").agg(F.max("rebalanced_at").alias("rebalanced_at"))
    return history.join(newest, ["index_type", "rebalanced_at"], "left_semi")


def valued_positions(positions: DataFrame) -> DataFrame:
    """Open fund positions with value and unrealised PnL."""
    cost = F.col("shares") * F.col("avg_entry_price")
    value = F.col("shares") * F.col("current_price")
    return latest_per_key(positions, ["fund_type", "token_id"], ["version"]).filter("shares > 0").withColumns({
        "current_value": value, "unrealized_pnl": value - cost, "unrealized_pnl_pct": div0((value - cost) * 100, cost)})


def newest_per_fund(rows: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    """The latest rows of every fund: trades, executions or user transactions."""
    return top_per(rows, ["fund_type"], [F.desc(ts), F.asc(tie)], limit)


def day_counters(trades: DataFrame, executions: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Trades, notional and executed signals of each fund in the last hours; a fund without any has zeros."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    within = lambda ts: (F.col(ts) >= since) & (F.col(ts) <= as_of)
    traded = trades.groupBy("fund_type").agg(F.count_if(within("ts")).alias("trades_24h"), sum_if("notional", within("ts")).alias("volume_24h"))
    signalled = executions.groupBy("fund_type").agg(F.count_if(within("executed_at")).alias("signals_24h"))
    return traded.join(signalled, "fund_type", "full_outer").fillna({"trades_24h": 0, "volume_24h": 0.0, "signals_24h": 0})
