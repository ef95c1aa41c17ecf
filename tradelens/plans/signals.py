"""Market signals: consensus, suspicious flow, alert rules, follow signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import count_if, div, div0, ladder, sum_if
from tradelens.plans.traders import TRADER, since

STRENGTH_LADDER = [(0.85, "VERY_STRONG"), (0.75, "STRONG"), (0.65, "MODERATE"), (0.55, "WEAK")]
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def consensus_signals(trades: DataFrame, scores: DataFrame, as_of: Column, hours: int = 48, min_traders: int = 3, min_volume: float = 5000.0,
                      min_score: float = 60.0, yes_names: Sequence[str] = ("YES", "UP")) -> DataFrame:
    """Direction, agreement, strength and confidence of high-score traders in every market at once.

    Trades are reduced to one net position per (market, trader), then to one row per market.
    """
    smart = scores.filter(F.col("total_score") >= min_score).select("username", "total_score")
    outcome, side = F.upper("outcome"), F.upper("side")
    names_yes = outcome.isin(*yes_names)
    for_yes = ((side == "BUY") & names_yes) | ((side == "SELL") & ~names_yes)
    net = trades.filter(since(as_of, hours=hours)).join(smart, "username").groupBy("market_slug", "username").agg(
        F.max("total_score").alias("score"), sum_if("notional", for_yes).alias("yes"), sum_if("notional", ~for_yes).alias("no"),
        F.sum("notional").alias("volume"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ).withColumn("lean", F.round(F.col("yes") - F.col("no"), 9)).filter("lean != 0")
    up, down = F.col("lean") > 0, F.col("lean") < 0
    market = net.groupBy("market_slug").agg(
        count_if(up).alias("n_yes"), count_if(down).alias("n_no"), sum_if("volume", up).alias("v_yes"), sum_if("volume", down).alias("v_no"),
        sum_if("score", up).alias("s_yes"), sum_if("score", down).alias("s_no"),
        sum_if(F.col("volume") * F.col("score"), up).alias("w_yes"), sum_if(F.col("volume") * F.col("score"), down).alias("w_no"),
        F.max("last_ts").alias("last_trade_at"), F.min("last_ts").alias("first_trade_at"))
    no_side = F.col("n_no") > F.col("n_yes")
    pick = lambda a, b: F.when(no_side, F.col(b)).otherwise(F.col(a))
    total = F.col("n_yes") + F.col("n_no")
    out = market.withColumns({
        "direction": F.when(F.col("n_yes") > F.col("n_no"), "YES").when(no_side, "NO").otherwise("SPLIT"),
        "agreement_pct": F.greatest("n_yes", "n_no") / total, "num_traders": total,
        "num_for": pick("n_yes", "n_no"), "num_against": pick("n_no", "n_yes"),
        "volume_for": pick("v_yes", "v_no"), "volume_against": pick("v_no", "v_yes"),
        "_score": div0(pick("s_yes", "s_no"), pick("n_yes", "n_no")),
        "signal_quality": div0(pick("w_yes", "w_no"), pick("v_yes", "v_no")),
    })
    volume = F.col("volume_for") + F.col("volume_against")
    crowd = F.least(F.lit(1.0), F.log(F.col("num_traders") + 1) / F.log(F.lit(21.0)))
    confidence = (crowd * 0.30 + div0("volume_for", volume) * 0.40 + F.col("_score") / 100 * 0.30) * 100
    return out.filter((F.col("num_traders") >= min_traders) & (volume >= min_volume)).withColumns({
        "strength": ladder(F.col("agreement_pct"), STRENGTH_LADDER, "NONE"),
        "confidence_score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), confidence)),
        "implied_prob_shift": div0("volume_for", volume) - 0.5,
    }).filter("strength != 'NONE'").drop("n_yes", "n_no", "v_yes", "v_no", "s_yes", "s_no", "w_yes", "w_no", "_score")


def consensus_screen(trades: DataFrame, scores: DataFrame, as_of: Column, hours: int, min_score: float, min_traders: int,
                     min_volume: float = 0.0) -> DataFrame:
    """Number of high-score traders and their volume per (market, outcome)."""
    smart = scores.filter(F.col("total_score") >= min_score).select("username", "total_score")
    return trades.filter(since(as_of, hours=hours) & (F.col("side") == "BUY")).join(smart, "username").groupBy(
        "market_slug", "outcome").agg(
        F.count_distinct("username").alias("num_traders"), F.sum("notional").alias("total_volume"), F.avg("total_score").alias("avg_score"),
        F.max("ts").alias("last_trade_at")).filter((F.col("num_traders") >= min_traders) & (F.col("total_volume") >= min_volume))


# ---- suspicious flow -------------------------------------------------------------------------


def _alert(rows: DataFrame, kind: str, severity: Column, confidence: Column) -> DataFrame:
    return rows.withColumns({"signal_type": F.lit(kind), "severity": severity, "confidence": F.least(F.lit(1.0), confidence)})


def new_account_whale(trades: DataFrame, as_of: Column, hours: int = 24, max_age_days: int = 7, min_bet: float = 5000,
                      min_share: float = 0.8) -> DataFrame:
    """Young accounts whose recent money sits mostly in one large bet."""
    bets = trades.filter(since(as_of, hours=hours)).groupBy(TRADER, "username", "market_slug", "side").agg(F.sum("notional").alias("bet"))
    main = F.max_by(F.struct("market_slug", "side"), F.struct(F.round("bet", 6), "market_slug", "side"))
    stats = bets.groupBy(TRADER, "username").agg(
        F.sum("bet").alias("total_volume"), F.count_distinct("market_slug").alias("unique_markets"),
        main.alias("_m"), F.max("bet").alias("bet_size")).withColumn("share", div("bet_size", "total_volume"))
    large = stats.filter((F.col("bet_size") >= min_bet) & (F.round("share", 9) >= min_share))
    first = trades.groupBy(TRADER).agg(F.min("ts").alias("first_trade"))
    age = F.datediff(as_of, F.col("first_trade"))
    rows = large.join(first, TRADER).withColumn("account_age_days", age).filter(F.col("account_age_days") <= max_age_days)
    bet, young = F.col("bet_size"), F.col("account_age_days")
    severity = F.when((bet >= 50_000) & (young <= 3), "CRITICAL").when((bet >= 20_000) & (young <= 5), "HIGH").when(
        bet >= 10_000, "MEDIUM").otherwise("LOW")
    bump = lambda cond, by: F.when(cond, by).otherwise(0.0)
    confidence = (F.lit(0.5) + bump(young <= 3, 0.2) + bump(bet >= 10_000, 0.15) + bump(bet >= 50_000, 0.15)
                  + bump(F.round("share", 9) >= 0.95, 0.1))
    return _alert(rows, "NEW_ACCOUNT_WHALE", severity, confidence).select(
        "signal_type", TRADER, "username", F.col("_m.market_slug").alias("market_slug"), F.col("_m.side").alias("direction"),
        "bet_size", "total_volume", "unique_markets", "account_age_days", "share", "severity", "confidence")


def volume_spike(trades: DataFrame, as_of: Column, hours: int = 6, days: int = 30, ratio: float = 10.0, min_volume: float = 1000) -> DataFrame:
    """Markets trading far above their daily average; both spans come from one scan."""
    recent, past = since(as_of, hours=hours), since(as_of, days=days) & ~since(as_of, hours=hours)
    buy = recent & (F.col("side") == "BUY")
    rows = trades.filter(since(as_of, days=max(days, hours // 24 + 1))).groupBy("market_slug").agg(
        sum_if("notional", recent).alias("recent_volume"), sum_if("notional", buy & (F.col("outcome_index") == 0)).alias("yes_volume"),
        sum_if("notional", buy & (F.col("outcome_index") == 1)).alias("no_volume"),
        F.count_distinct(F.when(recent, F.col(TRADER))).alias("unique_traders"),
        (F.sum(F.when(past, F.col("notional"))) / days).alias("avg_daily_volume"))
    spike = div("recent_volume", F.col("avg_daily_volume") * (hours / 24.0))
    rows = rows.withColumn("spike_ratio", spike).filter(
        (F.col("recent_volume") >= min_volume) & (F.round("spike_ratio", 9) >= ratio))
    yes, no = F.col("yes_volume"), F.col("no_volume")
    tilt = div0(F.abs(yes - no), yes + no)
    s = F.col("spike_ratio")
    severity = F.when((s >= 50) & (tilt >= 0.7), "CRITICAL").when(s >= 20, "HIGH").when(s >= 10, "MEDIUM").otherwise("LOW")
    return _alert(rows.withColumn("imbalance", tilt), "VOLUME_SPIKE", severity, F.lit(0.3) + s / 50 + tilt * 0.3).withColumn(
        "direction", F.when(F.round(yes - no, 9) > 0, "YES").otherwise("NO"))


def smart_money_divergence(trades: DataFrame, scores: DataFrame, as_of: Column, hours: int = 24, top_n: int = 100,
                           min_traders: int = 3, sentiment_days: int = 7) -> DataFrame:
    """Several top traders buying the outcome most money is against."""
    top = scores.orderBy(F.desc("total_score"), TRADER).limit(top_n).select(TRADER, F.lit(True).alias("_top"))
    bets = trades.filter(since(as_of, hours=hours) & (F.col("side") == "BUY")).join(top, TRADER, "left_semi").groupBy(
        "market_slug", "outcome_index").agg(
        F.sum("notional").alias("smart_volume"), F.count_distinct(TRADER).alias("num_traders")).filter(F.col("num_traders") >= min_traders)
    mood = trades.filter(since(as_of, days=sentiment_days)).groupBy("market_slug").agg(
        sum_if("notional", F.col("outcome_index") == 0).alias("yes_volume"), sum_if("notional", F.col("outcome_index") == 1).alias("no_volume"))
    crowd = F.when(F.round(F.col("yes_volume") - F.col("no_volume"), 9) > 0, 0).otherwise(1)
    rows = bets.join(mood.withColumn("consensus_outcome", crowd), "market_slug").filter(
        F.col("outcome_index") != F.col("consensus_outcome"))
    share = div0(F.greatest("yes_volume", "no_volume"), F.col("yes_volume") + F.col("no_volume"))
    n = F.col("num_traders")
    severity = F.when((n >= 5) & (share >= 0.7), "CRITICAL").when((n >= 3) & (share >= 0.6), "HIGH").otherwise("MEDIUM")
    return _alert(rows.withColumn("consensus_pct", share), "SMART_MONEY_DIVERGENCE", severity,
                  F.lit(0.4) + n * 0.1 + F.col("smart_volume") / 50_000).withColumn(
        "direction", F.when(F.col("outcome_index") == 0, "YES").otherwise("NO"))


def coordinated_entry(trades: DataFrame, as_of: Column, hours: int = 24, min_traders: int = 3, max_minutes: int = 120,
                      min_volume: float = 10_000) -> DataFrame:
    """Several accounts entering one outcome within a short span."""
    recent = trades.filter(since(as_of, hours=hours) & (F.col("side") == "BUY"))
    rows = recent.groupBy("market_slug", "outcome_index").agg(
        F.count_distinct(TRADER).alias("num_traders"), F.sum("notional").alias("total_volume"), F.min("ts").alias("cluster_start"),
        F.max("ts").alias("cluster_end"))
    minutes = F.floor(F.unix_seconds("cluster_end") / 60) - F.floor(F.unix_seconds("cluster_start") / 60)
    rows = rows.withColumn("window_minutes", minutes).filter(
        (F.col("num_traders") >= min_traders) & (F.col("window_minutes") <= max_minutes) & (F.round("total_volume", 6) >= min_volume))
    n, w = F.col("num_traders"), F.col("window_minutes")
    severity = F.when((n >= 5) & (w <= 30), "CRITICAL").when((n >= 4) & (w <= 60), "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW")
    return _alert(rows, "COORDINATED_ENTRY", severity, F.lit(0.3) + n * 0.1 + n / F.greatest(F.lit(1), w) * 0.2).withColumn(
        "direction", F.when(F.col("outcome_index") == 0, "YES").otherwise("NO"))


def cluster_members(trades: DataFrame, clusters: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """All traders of each flagged cluster, by entry time. The list is as long as the cluster has traders."""
    keys = ["market_slug", "outcome_index"]
    entries = trades.filter(since(as_of, hours=hours) & (F.col("side") == "BUY")).join(clusters.select(*keys), keys, "left_semi").groupBy(
        *keys, "username").agg(F.min("ts").alias("entry"))
    listed = F.array_sort(F.collect_list(F.struct("entry", "username")))
    return entries.groupBy(*keys).agg(F.transform(listed, lambda x: x["username"]).alias("traders"))


def large_recent_bets(trades: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return trades.filter(since(as_of, hours=hours)).groupBy(TRADER, "username", "market_slug", "side", "outcome_index").agg(
        F.sum("notional").alias("bet_size"), F.min("ts").alias("first_bet"), F.count(F.lit(1)).alias("num_bets"))


def late_entry_conviction(trades: DataFrame, as_of: Column, hours: int = 24, min_bet: float = 10_000, active_days: int = 7,
                          min_market_volume: float = 5000) -> DataFrame:
    """Large recent bets by traders new to the market or far above their history there."""
    active = trades.filter(since(as_of, days=active_days)).groupBy("market_slug").agg(F.sum("notional").alias("v")).filter(
        F.round("v", 6) >= min_market_volume)
    bets = large_recent_bets(trades.join(active, "market_slug", "left_semi"), as_of, hours).filter(F.round("bet_size", 6) >= min_bet)
    history = trades.filter(~since(as_of, hours=hours)).groupBy(TRADER, "market_slug").agg(F.sum("notional").alias("historical_volume"))
    rows = bets.join(history, [TRADER, "market_slug"], "left").filter(
        F.col("historical_volume").isNull() | (F.col("bet_size") > F.col("historical_volume") * 2))
    new, bet = F.col("historical_volume").isNull(), F.col("bet_size")
    severity = F.when((bet >= 50_000) & new, "CRITICAL").when((bet >= 25_000) & new, "HIGH").when(bet >= 10_000, "MEDIUM").otherwise("LOW")
    bump = lambda cond, by: F.when(cond, by).otherwise(0.0)
    return _alert(rows.withColumn("is_new_to_market", new), "LATE_ENTRY_CONVICTION", severity,
                  F.lit(0.4) + bump(new, 0.25) + bump(bet >= 25_000, 0.2) + bump(bet >= 50_000, 0.15))


def whale_anomaly(trades: DataFrame, as_of: Column, hours: int = 24, whale_volume: float = 100_000, min_bet: float = 5000) -> DataFrame:
    """High-volume traders putting money into a market they never traded before."""
    whales = trades.groupBy(TRADER).agg(F.sum("notional").alias("v")).filter(F.round("v", 6) >= whale_volume)
    theirs = trades.join(whales, TRADER, "left_semi")
    known = theirs.filter(~since(as_of, hours=hours)).select(TRADER, "market_slug")
    rows = large_recent_bets(theirs, as_of, hours).filter(F.round("bet_size", 6) >= min_bet).join(known, [TRADER, "market_slug"], "left_anti")
    bet = F.col("bet_size")
    severity = F.when(bet >= 50_000, "HIGH").when(bet >= 20_000, "MEDIUM").otherwise("LOW")
    return _alert(rows, "WHALE_ANOMALY", severity, F.lit(0.4) + bet / 50_000).withColumn(
        "direction", F.when(F.col("outcome_index") == 0, "YES").otherwise("NO"))


# ---- alert tables ----------------------------------------------------------------------------


def detection_performance(alerts: DataFrame) -> DataFrame:
    right, known = F.col("was_correct"), F.col("was_correct").isNotNull()
    return alerts.groupBy("signal_type", "severity").agg(
        F.count(F.lit(1)).alias("total_alerts"), count_if(right).alias("correct_predictions"),
        count_if(~right).alias("incorrect_predictions"), count_if(~known).alias("unresolved"),
        div0(count_if(right), count_if(known)).alias("accuracy"), F.avg("confidence").alias("avg_confidence"),
        F.sum("total_volume_usd").alias("total_volume_flagged"))


def daily_summary(alerts: DataFrame) -> DataFrame:
    level = lambda s: count_if(F.col("severity") == s)
    return alerts.groupBy(F.to_date("detected_at").alias("date")).agg(
        F.count(F.lit(1)).alias("total_alerts"), level("CRITICAL").alias("critical_alerts"), level("HIGH").alias("high_alerts"),
        level("MEDIUM").alias("medium_alerts"), F.sum("total_volume_usd").alias("total_suspicious_volume"),
        F.count_distinct("market_slug").alias("unique_markets"), F.avg("confidence").alias("avg_confidence"))


def top_suspicious_markets(alerts: DataFrame, limit: int = 100) -> DataFrame:
    newest = F.max_by(F.struct("signal_type", "severity", "direction"), F.struct("detected_at", "alert_id"))
    return alerts.groupBy("market_slug").agg(
        newest.alias("_n"), F.count(F.lit(1)).alias("total_signals"), F.max("confidence").alias("max_confidence"),
        F.sum("total_volume_usd").alias("total_suspicious_volume"), F.max("detected_at").alias("last_alert_at"),
    ).select("market_slug", F.col("_n.signal_type").alias("latest_signal"), F.col("_n.severity").alias("latest_severity"),
             F.col("_n.direction").alias("predicted_direction"), "total_signals", "max_confidence", "total_suspicious_volume",
             "last_alert_at").orderBy(F.desc("max_confidence"), F.desc("total_signals"), "market_slug").limit(limit)


def repeat_suspects(flagged: DataFrame, min_flags: int = 2) -> DataFrame:
    done = F.col("market_outcome").isNotNull()
    hits = count_if(done & (F.col("bet_direction") == F.col("market_outcome")))
    return flagged.groupBy(TRADER, "username").agg(
        F.count(F.lit(1)).alias("times_flagged"), hits.alias("correct_bets"), count_if(done).alias("resolved_bets"),
        div0(hits, count_if(done)).alias("success_rate"), F.sum("bet_size_usd").alias("total_suspicious_volume"),
        F.array_join(F.array_sort(F.collect_set("signal_type")), ",").alias("signal_types")).filter(F.col("times_flagged") >= min_flags)


RULES = (
    ("top10_position", "POSITION_ENTRY", 80.0, 5000.0, "HIGH"),
    ("whale_trade", "LARGE_TRADE", 0.0, 50_000.0, "HIGH"),
)


def alert_rules(trades: DataFrame, scores: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """One row per (trade, rule) that fires. The rules are a short constant list, tested in one pass."""
    scored = trades.join(scores.select("username", "total_score"), "username", "left").withColumn(
        "total_score", F.coalesce("total_score", F.lit(0)))
    fired = [F.when(
        (F.col("total_score") >= score) & (F.col("notional") >= size),
        F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("alert_type"), F.lit(priority).alias("priority")))
        for rule, kind, score, size, priority in rules]
    return scored.withColumn("_r", F.explode(F.array_compact(F.array(*fired)))).select(
        "event_key", "username", "market_slug", "ts", "notional", "total_score", "_r.*")


def drift_trend(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.to_date("checked_at").alias("date")).agg(
        F.avg("drift_ratio").alias("avg_drift_ratio"), F.max("drift_ratio").alias("max_drift_ratio"),
        count_if(F.col("alert_level") == "warning").alias("warning_count"), count_if(F.col("alert_level") == "critical").alias("critical_count"),
        count_if(F.col("retrain_triggered")).alias("retrains_triggered"))


def active_alerts(alerts: DataFrame, states: Sequence[str], limit: int) -> DataFrame:
    level = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        level = F.when(F.col("severity") == name, rank).otherwise(level)
    return alerts.filter(F.col("status").isin(*states)).orderBy(level.desc(), F.desc("detected_at"), "alert_id").limit(limit)
