"""Trader scoring and index construction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import div, div0, ladder
from tradelens.operators.keysets import with_benchmark
from tradelens.operators.quantiles import global_rank
from tradelens.plans.traders import TRADER

# Component weights and score ladders, (at least, points).
WEIGHTS = {"profitability": 0.40, "risk": 0.30, "consistency": 0.20, "track_record": 0.10}
PNL_LADDER = [(100_000, 95.0), (50_000, 85.0), (20_000, 75.0), (10_000, 65.0), (5_000, 55.0), (1_000, 45.0)]
MARKET_RISK_LADDER = [(50, 30.0), (20, 25.0), (10, 20.0), (5, 15.0)]
TRADE_RATE_LADDER = [(5, 30.0), (2, 25.0), (1, 20.0), (0.5, 15.0)]
DAYS_CONSISTENCY_LADDER = [(365, 35.0), (180, 30.0), (90, 25.0), (30, 20.0)]
DAYS_RECORD_LADDER = [(365, 35.0), (180, 30.0), (90, 25.0), (60, 20.0), (30, 15.0)]
VOLUME_LADDER = [(100_000, 35.0), (50_000, 30.0), (20_000, 25.0), (10_000, 20.0), (5_000, 15.0), (1_000, 10.0)]
MARKET_RECORD_LADDER = [(50, 30.0), (30, 25.0), (20, 20.0), (10, 15.0), (5, 10.0)]
TIER_LADDER = [(80, "DIAMOND"), (60, "GOLD"), (40, "SILVER")]
ML_TIER_LADDER = [(90, "DIAMOND"), (70, "GOLD"), (50, "SILVER")]
MIN_PEERS = 10
MAX_SHARPE = 10.0
FULL_CONFIDENCE_DAYS = 30


def score_tier(score: Column, steps=TIER_LADDER) -> Column:
    return ladder(score, steps, "BRONZE")


def profitability(pnl: Column, peer_percentile: Column) -> Column:
    """Losses start at 20 and fall; gains rank among peers up to 95, or climb a ladder without peers."""
    alone = ladder(pnl, PNL_LADDER, F.lit(35.0) + pnl / 1000 * 10)
    return F.when(pnl <= 0, F.greatest(F.lit(0.0), F.lit(20.0) + pnl / 100)).otherwise(
        F.coalesce(F.least(peer_percentile, F.lit(95.0)), alone))


def risk(avg_size: Column, markets: Column) -> Column:
    sizing = F.when(avg_size > 0, ladder(avg_size, [(100, 20.0), (500, 15.0), (1000, 10.0)], 5.0, "<=")).otherwise(0.0)
    return F.least(F.lit(100.0), F.lit(50.0) + sizing + ladder(markets, MARKET_RISK_LADDER, 10.0))


def consistency(trades: Column, days: Column, buys: Column, sells: Column) -> Column:
    rate = F.when(days > 0, ladder(div(trades, days), TRADE_RATE_LADDER, 10.0)).otherwise(0.0)
    balance = div0(F.least(buys, sells), (buys + sells) / 2) * 35
    active = ladder(days, DAYS_CONSISTENCY_LADDER, days / 30 * 20)
    return F.when(trades < 50, trades / 50 * 30).otherwise(F.least(F.lit(100.0), rate + balance + active))


def track_record(days: Column, volume: Column, markets: Column) -> Column:
    return F.least(
        F.lit(100.0),
        ladder(days, DAYS_RECORD_LADDER, days / 30 * 15) + ladder(volume, VOLUME_LADDER, 5.0)
        + ladder(markets, MARKET_RECORD_LADDER, 5.0))


def strategy_classify(metrics: DataFrame) -> DataFrame:
    """Best of three strategy scores; close calls are HYBRID, weak ones UNKNOWN."""
    trades, total = F.col("total_trades"), F.col("buy_count") + F.col("sell_count")
    balance = F.lit(1.0) - F.abs(F.lit(0.5) - div0("buy_count", total)) * 2
    busy = trades > 500
    arb = F.least(F.lit(100.0), F.col("complete_set_ratio") * 100 + F.when(busy, 20.0).otherwise(0.0))
    maker = F.when(total > 0, F.least(F.lit(100.0), balance * 50 + F.when(busy, 30.0).otherwise(0.0)))
    directional = F.least(
        F.lit(100.0), F.abs(F.col("direction_bias") - 0.5) * 100 + F.when(F.col("unique_markets") < 50, 30.0).otherwise(0.0))
    entry = lambda s, pos, name: F.struct(s.alias("s"), F.lit(pos).alias("p"), F.lit(name).alias("n"))
    ranked = F.sort_array(F.filter(F.array(
        entry(arb, 3, "ARBITRAGEUR"), entry(maker, 2, "MARKET_MAKER"), entry(directional, 1, "DIRECTIONAL_MOMENTUM"),
    ), lambda x: x["s"].isNotNull()), asc=False)
    first, second = F.get(F.col("_r"), F.lit(0)), F.get(F.col("_r"), F.lit(1))
    close = second.isNotNull() & (F.round(first["s"] - second["s"], 9) < 15)
    return metrics.withColumn("_r", ranked).withColumns({
        "strategy_type": F.when(close, "HYBRID").when(first["s"] < 30, "UNKNOWN").otherwise(first["n"]),
        "strategy_confidence": F.when(close, first["s"] * 0.7).otherwise(first["s"]),
    }).drop("_r")


def peer_percentile(metrics: DataFrame) -> DataFrame:
    """Share of traders with a known, strictly smaller PnL; NULL when there are too few peers."""
    peers = metrics.filter("total_pnl != 0").select(TRADER, "total_pnl")
    ranked = global_rank(peers, "total_pnl", below_share="_share").select(TRADER, "_share")
    size = peers.agg(F.count(F.lit(1)).alias("_peers"))
    out = with_benchmark(metrics.join(ranked, TRADER, "left"), size)
    return out.withColumn("peer_percentile", F.when(F.col("_peers") > MIN_PEERS, F.col("_share") * 100)).drop("_share", "_peers")


def smart_money_score(metrics: DataFrame, indicators: DataFrame) -> DataFrame:
    """Four component scores, the strategy and the weighted total of every trader."""
    joined = metrics.join(indicators, TRADER, "left").withColumns({
        "complete_set_ratio": F.coalesce("complete_set_ratio", F.lit(0.0)),
        "direction_bias": F.coalesce("direction_bias", F.lit(0.5)),
    })
    base = strategy_classify(peer_percentile(joined)).withColumns({
        "profitability_score": profitability(F.col("total_pnl"), F.col("peer_percentile")),
        "risk_adjusted_score": risk(F.col("avg_trade_size"), F.col("unique_markets")),
        "consistency_score": consistency(F.col("total_trades"), F.col("days_active"), F.col("buy_count"), F.col("sell_count")),
        "track_record_score": track_record(F.col("days_active"), F.col("total_volume_usd"), F.col("unique_markets")),
    })
    steady, gains, kind = F.col("consistency_score"), F.col("profitability_score"), F.col("strategy_type")
    adjusted = base.withColumns({
        "consistency_score": F.when(kind == "ARBITRAGEUR", F.when(steady < 70, steady * 0.8).otherwise(
            F.least(F.lit(100.0), steady * 1.1))).otherwise(steady),
        "profitability_score": F.when((kind == "DIRECTIONAL_MOMENTUM") & (gains > 60), F.least(F.lit(100.0), gains * 1.1)).otherwise(gains),
    })
    total = (F.col("profitability_score") * WEIGHTS["profitability"] + F.col("risk_adjusted_score") * WEIGHTS["risk"]
             + F.col("consistency_score") * WEIGHTS["consistency"] + F.col("track_record_score") * WEIGHTS["track_record"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(total, 9), 0).cast("int")))
    return adjusted.withColumn("total_score", score).withColumns({
        "tier": score_tier(F.col("total_score")),
        "data_quality": F.when(F.col("total_trades") >= 50, "good").otherwise("limited"),
    })


def ranked_top(rows: DataFrame, order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """Rank of the best ``limit`` rows; the limit bounds what the single ordered window holds."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def daily_sharpe(position_pnl: DataFrame, min_days: int = 5) -> DataFrame:
    """Annualised Sharpe of daily realised PnL with a confidence that grows over a month of days."""
    daily = position_pnl.filter(F.round("realized_pnl", 9) != 0).groupBy(TRADER, F.to_date("resolution_time").alias("d")).agg(
        F.max("username").alias("username"), F.sum("realized_pnl").alias("pnl"))
    stats = daily.groupBy(TRADER).agg(
        F.max("username").alias("username"), F.avg("pnl").alias("mean_daily_pnl"), F.stddev_pop("pnl").alias("std_daily_pnl"),
        F.count(F.lit(1)).alias("days_with_pnl"), F.sum("pnl").alias("total_pnl"), F.min("pnl").alias("worst_day_pnl"),
    ).filter((F.col("days_with_pnl") >= min_days) & (F.round("std_daily_pnl", 9) > 0))
    mean, std = F.col("mean_daily_pnl"), F.col("std_daily_pnl")
    sharpe = mean / std * F.sqrt(F.lit(365.0))
    drawdown = F.when(mean > 0, F.abs(F.least(F.col("worst_day_pnl"), F.lit(0.0)) / mean)).otherwise(0.0)
    return stats.withColumns({
        "sharpe_ratio": sharpe, "sharpe_ratio_capped": F.least(sharpe, F.lit(MAX_SHARPE)),
        "max_drawdown": F.least(drawdown, F.lit(1.0)),
        "confidence": F.least(F.col("days_with_pnl") / F.lit(float(FULL_CONFIDENCE_DAYS)), F.lit(1.0)),
    })


# ---- indices ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexConfig:
    """Entry rules and weighting of one index."""

    name: str
    size: int
    weighting: str  # EQUAL | SCORE | SHARPE | CLUSTER
    min_score: float
    min_trades: int
    min_days: int
    min_volume: float
    min_sharpe: float = 0.0
    allowed: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    min_category_share: float = 0.0
    max_weight: float = 0.20


NOT_COPYABLE = ("ARBITRAGEUR", "MARKET_MAKER", "SCALPER")

# Size, weighting and entry thresholds per index.
DEFAULT_INDICES = (
    IndexConfig("TOP_10", 10, "EQUAL", 50, 10, 1, 1000, excluded=NOT_COPYABLE),
    IndexConfig("TOP_25", 25, "EQUAL", 45, 5, 1, 500, excluded=NOT_COPYABLE),
    IndexConfig("CRYPTO", 15, "SHARPE", 40, 5, 1, 500, excluded=NOT_COPYABLE),
    IndexConfig("POLITICS", 15, "SCORE", 40, 5, 1, 500, allowed=("DIRECTIONAL_FUNDAMENTAL", "EVENT_DRIVEN")),
    IndexConfig("ALL", 50, "SCORE", 40, 5, 1, 500),
    IndexConfig("SPORTS", 10, "SCORE", 40, 5, 1, 500, excluded=NOT_COPYABLE),
    IndexConfig("NEWS", 10, "SHARPE", 40, 10, 7, 1000, allowed=("EVENT_DRIVEN", "DIRECTIONAL_MOMENTUM", "DIRECTIONAL_FUNDAMENTAL"),
                categories=("NEWS", "POLITICS"), min_category_share=0.5),
    IndexConfig("ALPHA", 15, "SCORE", 50, 5, 1, 500, excluded=NOT_COPYABLE, max_weight=0.15),
)


@dataclass
class IndexInputs:
    """Tables an index build reads."""

    traders: DataFrame
    clusters: DataFrame | None = None
    categories: DataFrame | None = None
    extra: Mapping[str, DataFrame] = field(default_factory=dict)


def rule_rows(configs: Sequence[IndexConfig]) -> Column:
    """The entry rules as an array of structs, one per index: a short constant table."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array(*[F.struct(
        F.lit(c.name).alias("index_type"), F.lit(c.size).alias("size"), F.lit(c.weighting).alias("weighting"), F.lit(float(c.min_score)).alias("min_score"),
        F.lit(c.min_trades).alias("min_trades"), F.lit(c.min_days).alias("min_days"), F.lit(float(c.min_volume)).alias("min_volume"), F.lit(float(c.min_sharpe)).alias("min_sharpe"),
        names(c.allowed).alias("allowed"), names(c.excluded).alias("excluded"), names(c.categories).alias("categories"), F.lit(float(c.min_category_share)).alias("min_share"),
        F.lit(float(c.max_weight)).alias("max_weight")) for c in configs])


def index_candidates(inputs: IndexInputs, configs: Sequence[IndexConfig]) -> DataFrame:
    """Each trader once for every index whose rules it meets. The traders are read once, whatever the number of indices."""
    strategy = F.coalesce(F.nullif(F.col("strategy_type"), F.lit("")), F.lit("UNKNOWN"))
    rows = inputs.traders.withColumn("strategy_type", strategy)
    in_categories = F.lit(True)
    if inputs.categories is not None and any(c.categories for c in configs):
        shares = inputs.categories.groupBy(TRADER).agg(F.map_from_entries(F.collect_list(F.struct("category", "concentration"))).alias("_shares"))  # a trader has few categories
        rows = rows.join(shares, TRADER, "left")
        held = F.aggregate(F.col("r.categories"), F.lit(0.0), lambda total, c: total + F.coalesce(F.try_element_at("_shares", c), F.lit(0.0)))
        in_categories = (F.size("r.categories") == 0) | (F.col("_shares").isNotNull() & (held >= F.col("r.min_share")) & (held > 0))
    kind = F.col("strategy_type")
    return rows.withColumn("r", F.explode(rule_rows(configs))).filter(
        (F.col("total_score") >= F.col("r.min_score")) & (F.col("total_trades") >= F.col("r.min_trades")) & (F.col("days_active") >= F.col("r.min_days"))
        & (F.col("total_volume_usd") >= F.col("r.min_volume")) & (F.col("sharpe_ratio") >= F.col("r.min_sharpe"))
        & ((F.size("r.allowed") == 0) | (kind == "UNKNOWN") | F.array_contains("r.allowed", kind)) & ~F.array_contains("r.excluded", kind) & in_categories)


def index_weights(chosen: DataFrame) -> DataFrame:
    """Raw weight by the index's rule, one cap, then renormalised to sum to one. An index holds at most ``size`` rows."""
    everyone, group = Window.partitionBy("index_type"), Window.partitionBy("index_type", "strategy_cluster")
    share = lambda c, w: div0(c, F.sum(c).over(w))
    way, sharpe = F.col("r.weighting"), F.greatest(F.lit(0.0), F.col("sharpe_ratio"))
    capped = F.least(F.when(way == "SHARPE", share(sharpe, everyone)).when(
        way == "CLUSTER", share(F.col("total_score"), group) / F.size(F.collect_set("strategy_cluster").over(everyone))).otherwise(share(F.col("total_score"), everyone)), F.col("r.max_weight"))
    raw = F.when(way == "EQUAL", F.lit(1.0) / F.count(F.lit(1)).over(everyone)).otherwise(capped)
    return chosen.withColumn("_raw", raw).withColumn("weight", div0("_raw", F.sum("_raw").over(everyone))).drop("_raw")


def index_build_all(inputs: IndexInputs, configs: Sequence[IndexConfig] = DEFAULT_INDICES) -> DataFrame:
    """Members and weights of all indices in one pass: rules as rows, one rank per index (Spark cuts to the largest size before the shuffle), weights side by side."""
    spot = F.row_number().over(Window.partitionBy("r.index_type").orderBy(F.desc("total_score"), F.asc(TRADER)))
    most = max(c.size for c in configs)
    ranked = index_candidates(inputs, configs).withColumn("index_rank", spot).filter(F.col("index_rank") <= most).filter(F.col("index_rank") <= F.col("r.size"))
    ranked = ranked.withColumn("index_type", F.col("r.index_type"))
    if inputs.clusters is not None:
        ranked = ranked.join(inputs.clusters.select(TRADER, "strategy_cluster"), TRADER, "left").withColumn("strategy_cluster", F.coalesce("strategy_cluster", F.lit("UNKNOWN")))
    else:
        ranked = ranked.withColumn("strategy_cluster", F.lit("UNKNOWN"))
    return index_weights(ranked).select(
        "index_type", TRADER, "username", "weight", "total_score", "sharpe_ratio", "strategy_type", "index_rank")


def index_build(inputs: IndexInputs, config: IndexConfig) -> DataFrame:
    return index_build_all(inputs, [config])


def index_rebalance_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Traders that enter or leave each index."""
    keys = ["index_type", TRADER]
    side = lambda a, b, label: a.select(*keys).join(b.select(*keys), keys, "left_anti").withColumn("change", F.lit(label))
    return side(new, old, "ADD").unionByName(side(old, new, "REMOVE"))
