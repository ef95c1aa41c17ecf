"""Edge decay tests and persistence estimates per trader.

All tests compare a long with a recent window. Both windows come from one conditional aggregate; the
test statistics are column math on the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import col, count_if, div, ladder, with_upper_tails
from tradelens.plans.traders import since

# Decline thresholds, confidence by p-value and recommended actions.
EARLY, MODERATE, SEVERE, CRITICAL = 0.15, 0.25, 0.40, 0.60
SIGNIFICANCE = 0.05
MEAN_CONFIDENCE = [(0.01, 0.95), (0.05, 0.85), (0.10, 0.70)]
VARIANCE_CONFIDENCE = [(0.01, 0.90), (0.05, 0.80), (0.10, 0.65)]
ACTIONS = {
    "NONE": "Continue standard monitoring",
    "EARLY_WARNING": "Increase monitoring frequency, consider reducing weight",
    "MODERATE": "Reduce index weight by 50%, set removal watch",
    "SEVERE": "Remove from index consideration, blacklist for 30 days",
    "CRITICAL": "Immediate removal from all indices, investigate cause",
}


def window_stats(returns: DataFrame, as_of: Column, long_days: int = 90, recent_days: int = 30, win: Column | None = None) -> DataFrame:
    """Count, mean, deviation, win rate and Sharpe per user for both windows.

    ``returns`` has ``username, ts, ret``. ``win`` defaults to a positive return.
    """
    won = win if win is not None else F.col("ret") > 0
    aggs = []
    for tag, days in (("h", long_days), ("r", recent_days)):
        inside = since(as_of, days=days)
        n = count_if(inside)
        aggs += [n.alias(f"{tag}_n"), F.avg(F.when(inside, F.col("ret"))).alias(f"{tag}_mean"),
                 F.stddev_pop(F.when(inside, F.col("ret"))).alias(f"{tag}_std"),
                 div(count_if(inside & won), n).alias(f"{tag}_win")]
    stats = returns.filter(since(as_of, days=max(long_days, recent_days))).groupBy("username").agg(*aggs)
    flat = lambda t: F.round(f"{t}_std", 9) > 0
    return stats.withColumns({f"{t}_sharpe": F.when(flat(t), div(f"{t}_mean", f"{t}_std")).otherwise(0.0) for t in ("h", "r")})


def _welch() -> tuple[Column, Column]:
    """t statistic and its normal score for a drop of the mean (small samples are widened)."""
    n1, n2 = F.col("h_n").cast("double"), F.col("r_n").cast("double")
    v1, v2 = F.pow("h_std", F.lit(2.0)) / n1, F.pow("r_std", F.lit(2.0)) / n2
    enough = (n1 > 1) & (n2 > 1)
    se = F.sqrt(v1 + v2)
    t = F.when(enough & (se > 0), (F.col("h_mean") - F.col("r_mean")) / se).otherwise(0.0)
    spread = v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)
    freedom = F.when(~enough, F.lit(1.0)).when(spread == 0, F.greatest(n1 + n2 - 2, F.lit(1.0))).otherwise(
        F.greatest(F.lit(1.0), F.floor((v1 + v2) * (v1 + v2) / F.nullif(spread, F.lit(0.0))).cast("double")))
    z = F.when((freedom > 2) & (freedom <= 30), t * F.sqrt(freedom / F.nullif(freedom - 2, F.lit(0.0)))).otherwise(t)
    return t, z


def _indicator(name: str, applies: Column, hist: Column, recent: Column, change: Column, p: Column, levels, rest: float,
               scale: float) -> Column:
    """Struct of one test, NULL where it does not fire; its score sorts first."""
    sample = F.least(F.lit(1.0), (F.col("h_n") + F.col("r_n")) / F.lit(100.0))
    confidence = ladder(p, levels, rest, "<") * sample
    score = F.least(F.lit(100.0), change * 100 * scale * confidence)
    fires = applies & (F.round(change, 9) >= EARLY) & ~((p > SIGNIFICANCE) & (F.round(change, 9) < MODERATE))
    return F.when(fires, F.struct(
        score.alias("decay_score"), F.lit(name).alias("type"), hist.alias("historical"), recent.alias("recent"),
        change.alias("pct_decline"), confidence.alias("confidence"), p.alias("p_value")))


def decay_signal(change: Column) -> Column:
    return ladder(F.round(change, 9), [(CRITICAL, "CRITICAL"), (SEVERE, "SEVERE"), (MODERATE, "MODERATE"), (EARLY, "EARLY_WARNING")], "NONE")


def edge_decay(stats: DataFrame, min_trades: int = 20) -> DataFrame:
    """Worst of four decay tests per trader, MULTIPLE when several fire."""
    rows = stats.filter((F.col("h_n") >= min_trades) & (F.col("r_n") > 0))
    _, z_mean = _welch()
    n1, n2 = F.col("h_n").cast("double"), F.col("r_n").cast("double")
    pooled = (F.col("h_win") * n1 + F.col("r_win") * n2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z_win = F.when(se > 0, (F.col("h_win") - F.col("r_win")) / se).otherwise(0.0)
    spread = F.when((n1 > 2) & (n2 > 2), F.lit(2.0) / F.nullif(n1 - 1, F.lit(0.0)) + F.lit(2.0) / F.nullif(n2 - 1, F.lit(0.0)))
    ratio = div(F.pow("r_std", F.lit(2.0)), F.pow("h_std", F.lit(2.0)))
    z_var = F.when(ratio > 0, F.ln(ratio) / F.sqrt(spread))
    rows = with_upper_tails(rows, {"p_mean": z_mean, "p_win": z_win, "p_var": z_var}).withColumn(
        "p_var", F.when(z_var.isNull(), 0.5).otherwise(F.col("p_var")))
    p_mean, p_win, p_var = F.col("p_mean"), F.col("p_win"), F.col("p_var")
    fall = lambda a, b: div(col(a) - col(b), a)
    tests = F.array_compact(F.array(
        _indicator("SHARPE_RATIO", F.round("h_sharpe", 9) > 0, F.col("h_sharpe"), F.col("r_sharpe"), fall("h_sharpe", "r_sharpe"), p_mean,
                   MEAN_CONFIDENCE, 0.50, 1.0),
        _indicator("WIN_RATE", F.round("h_win", 9) > 0.5, F.col("h_win"), F.col("r_win"), fall("h_win", "r_win"), p_win, MEAN_CONFIDENCE, 0.50, 0.8),
        _indicator("RETURNS", F.round("h_mean", 9) > 0, F.col("h_mean"), F.col("r_mean"), fall("h_mean", "r_mean"), p_mean, MEAN_CONFIDENCE, 0.50, 1.0),
        _indicator("CONSISTENCY", (F.round("h_std", 9) > 0) & (F.col("r_std") > F.col("h_std")), F.col("h_std"), F.col("r_std"),
                   div(F.col("r_std") - F.col("h_std"), "h_std"), p_var, VARIANCE_CONFIDENCE, 0.45, 0.6)))
    worst = F.array_max(F.col("_t"))
    out = rows.withColumn("_t", tests).withColumn("_w", worst)
    return out.select(
        "username", F.size("_t").alias("indicators"), F.coalesce("_w.decay_score", F.lit(0.0)).alias("decay_score"),
        F.when(F.size("_t") > 1, "MULTIPLE").otherwise(F.coalesce("_w.type", F.lit("RETURNS"))).alias("decay_type"),
        F.coalesce("_w.historical", "h_sharpe").alias("historical_metric"), F.coalesce("_w.recent", "r_sharpe").alias("recent_metric"),
        F.coalesce("_w.pct_decline", F.lit(0.0)).alias("pct_decline"), F.coalesce("_w.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("_w.p_value", F.lit(1.0)).alias("p_value"), F.col("h_n").alias("trades_analyzed"),
        decay_signal(F.coalesce("_w.pct_decline", F.lit(0.0))).alias("signal"),
    ).withColumn("recommended_action", action_of(F.col("signal")))


def action_of(signal: Column) -> Column:
    out = F.lit("Unknown signal")
    for name, text in ACTIONS.items():
        out = F.when(signal == name, text).otherwise(out)
    return out


# Fixed values: (drop of the Sharpe ratio beyond, status, lowest health score).
HEALTH_STEPS = [(-0.40, "CRITICAL", 0.0), (-0.25, "SEVERE", 20.0), (-0.15, "MODERATE", 40.0), (0.0, "EARLY_WARNING", 60.0)]


def edge_health(stats: DataFrame, min_trades: int = 20) -> DataFrame:
    """Sharpe change between the windows as a status and a health score."""
    change = F.when(F.round("h_sharpe", 9) > 0, div(F.col("r_sharpe") - F.col("h_sharpe"), "h_sharpe")).otherwise(0.0)
    c = F.round(F.col("sharpe_change"), 9)
    status = ladder(c, [(bound, name) for bound, name, _ in HEALTH_STEPS], "HEALTHY", "<")
    health = ladder(c, [(bound, F.greatest(F.lit(low), F.lit(100.0) + F.col("sharpe_change") * 100)) for bound, _, low in HEALTH_STEPS],
                    F.least(F.lit(100.0), F.lit(100.0) + F.col("sharpe_change") * 50), "<")
    short = F.col("h_n") < min_trades
    return stats.withColumn("sharpe_change", change).select(
        "username", "h_n", "r_n", "h_sharpe", "r_sharpe", "sharpe_change",
        F.when(short, "INSUFFICIENT_DATA").otherwise(status).alias("status"), F.when(~short, health).alias("health_score"))


def edge_decay_list(health: DataFrame, min_trades: int, min_decline: float, limit: int) -> DataFrame:
    decline = -F.col("sharpe_change")
    return health.filter((F.col("h_n") >= min_trades) & (F.round(decline, 9) >= min_decline)).withColumn("decline", decline).orderBy(
        F.desc(F.round("decline", 6)), "username").limit(limit)


# How durable each strategy is taken to be.
DURABLE = ("ARBITRAGEUR", "MARKET_MAKER", "DIRECTIONAL_FUNDAMENTAL")
SEMI_DURABLE = ("EVENT_DRIVEN", "SWING_TRADER", "DIRECTIONAL_MOMENTUM")


def edge_persistence(returns: DataFrame, scores: DataFrame, as_of: Column, min_trades: int = 30, recent_days: int = 7) -> DataFrame:
    """Probability that an edge lasts 30, 60 and 90 days from five weighted factors."""
    recent = since(as_of, days=recent_days)
    n = F.count(F.lit(1))
    base = returns.groupBy("username").agg(
        n.alias("trade_count"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("std"), F.count_distinct("market_slug").alias("markets"),
        F.datediff(F.max("ts"), F.min("ts")).alias("days_active"), div(count_if(F.col("ret") > 0), n).alias("win_rate"),
        F.coalesce(F.avg(F.when(recent, F.col("ret"))), F.lit(0.0)).alias("recent_mean"),
    ).filter(F.col("trade_count") >= min_trades).join(scores.select("username", "strategy_type"), "username", "left")
    sharpe = F.when(F.round("std", 9) > 0, F.col("mean") / F.col("std")).otherwise(0.0)
    kind = F.coalesce("strategy_type", F.lit("UNKNOWN"))
    cap = lambda c: F.least(F.lit(1.0), c)
    cv = F.coalesce(div("std", F.abs("mean")), F.lit(10.0))
    ratio = div("recent_mean", "mean")
    rows = base.withColumn("sharpe_ratio", sharpe).withColumns({
        "strategy_factor": F.when(kind.isin(*DURABLE), 0.85).when(kind.isin(*SEMI_DURABLE), 0.65).otherwise(0.45),
        "consistency_factor": F.when(F.col("sharpe_ratio") > 0, cap(F.col("sharpe_ratio") / 2)).otherwise(0.0) * 0.4
        + F.when(F.col("win_rate") > 0.5, (F.col("win_rate") - 0.5) * 2).otherwise(0.0) * 0.3 + F.greatest(F.lit(0.0), 1 - cv / 5) * 0.3,
        "track_record_factor": cap(F.col("days_active") / F.lit(90.0)) * 0.6 + cap(F.col("trade_count") / F.lit(200.0)) * 0.4,
        "recent_factor": F.when(ratio.isNull(), 0.5).when(ratio >= 1, cap(F.lit(0.5) + (ratio - 1) * 0.5)).otherwise(
            F.greatest(F.lit(0.0), ratio * 0.5)),
        "conditions_factor": F.lit(0.5) + cap(F.col("markets") / F.lit(10.0)) * 0.5,
    })
    weighted = (F.col("strategy_factor") * 0.25 + F.col("consistency_factor") * 0.25 + F.col("track_record_factor") * 0.20
                + F.col("recent_factor") * 0.15 + F.col("conditions_factor") * 0.15)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp((weighted - 0.5) * -2))
    rows = rows.withColumn("prob_30d", p)
    prob = F.col("prob_30d")
    risk = F.when((prob >= 0.75) & (F.col("consistency_factor") >= 0.7), "LOW").when(prob >= 0.55, "MODERATE").when(
        prob >= 0.35, "HIGH").otherwise("VERY_HIGH")
    rows = rows.withColumn("persistence_risk", risk)
    return rows.withColumns({
        "prob_60d": prob * 0.90, "prob_90d": prob * 0.80,
        "confidence": F.least(F.lit(0.95), F.col("track_record_factor") * F.col("consistency_factor")),
        "expected_sharpe_30d": F.col("sharpe_ratio") * prob,
        "recommendation": F.when(F.col("persistence_risk") == "LOW", "INCLUDE").when(
            F.col("persistence_risk") == "MODERATE", F.when(F.col("sharpe_ratio") > 1.5, "INCLUDE").otherwise("REDUCE_WEIGHT"),
        ).when(F.col("persistence_risk") == "HIGH", "REDUCE_WEIGHT").otherwise("EXCLUDE"),
    })
