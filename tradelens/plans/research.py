"""Trade research: execution scenarios, PnL decomposition, book edges, market coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import count_if, div, div0, ladder, sum_if
from tradelens.operators.quantiles import exact_quantiles

SCENARIOS = ("actual", "mid", "exec_proxy", "all_maker", "all_taker")
# Labels of the time left, (below seconds, label).
BUCKETS_15M = [(60, "<1m"), (180, "1-3m"), (300, "3-5m"), (600, "5-10m")]
BUCKETS_1H = [(60, "<1m"), (180, "1-3m"), (300, "3-5m"), (600, "5-10m"), (900, "10-15m"), (1200, "15-20m"), (1800, "20-30m")]


def timing_label(seconds: Column, steps=BUCKETS_15M, rest: str = "10-15m") -> Column:
    return ladder(seconds, steps, rest, "<")


def entry_price(scenario: Column) -> Column:
    """Assumed fill price; a price that is missing or not positive falls back to the actual one."""
    actual, bid, ask, mid = (F.col(c) for c in ("price", "best_bid_price", "best_ask_price", "mid"))
    buy = F.col("side") == "BUY"
    near, far = F.when(buy, bid).otherwise(ask), F.when(buy, ask).otherwise(bid)
    kind = F.col("exec_type")
    proxy = F.when(kind == "MAKER_LIKE", near).when(kind == "TAKER_LIKE", far).when(kind == "INSIDE", mid).otherwise(actual)
    chosen = (
        F.when(scenario == "mid", mid).when(scenario == "all_maker", near).when(scenario == "all_taker", far)
        .when(scenario == "exec_proxy", proxy).otherwise(actual))
    return F.coalesce(F.when(chosen > 0, chosen), actual)


def with_scenarios(rows: DataFrame, scenarios: Sequence[str] = SCENARIOS) -> DataFrame:
    """One row per (trade, scenario) with entry price, PnL and cost."""
    long = rows.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    entry = entry_price(F.col("scenario"))
    gain = F.col("settle_price") - F.col("entry_price")
    pnl = F.col("size") * F.when(F.col("side") == "SELL", -gain).otherwise(gain)
    cost = F.col("size") * F.col("entry_price")
    return long.withColumn("entry_price", entry).withColumns({
        "pnl": F.when((F.col("scenario") == "actual") & F.col("realized_pnl").isNotNull(), F.col("realized_pnl")).otherwise(pnl),
        "cost": F.when(cost > 0, cost)})


def scenario_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    pnl, cost = F.sum("pnl"), F.sum(F.when(F.col("pnl").isNotNull(), F.col("cost")))
    return long.groupBy(*keys).agg(
        F.count("pnl").alias("trades"), pnl.alias("pnl"), cost.alias("cost"), div0(pnl, cost).alias("roi"),
        div0(count_if(F.round("pnl", 9) > 0), F.count("pnl")).alias("win_rate"))


def pnl_decomposition(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settled PnL split into direction (settle against mid) and execution (mid against price)."""
    settled = rows.filter((F.col("settle_price").isNotNull()) & (F.col("mid") > 0))
    size, price, mid, settle = (F.col(c) for c in ("size", "price", "mid", "settle_price"))
    actual = (settle - price) * size
    won = F.round(actual, 9) > 0
    gains, losses = sum_if(actual, won), F.abs(sum_if(actual, F.round(actual, 9) < 0))
    return settled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(actual).alias("actual_pnl"), F.sum((settle - mid) * size).alias("direction_pnl"),
        F.sum((mid - price) * size).alias("execution_pnl"), F.sum((settle - F.col("best_bid_price")) * size).alias("maker_pnl"),
        F.sum((settle - F.col("best_ask_price")) * size).alias("taker_pnl"), div0(count_if(won), F.count(F.lit(1))).alias("win_rate"),
        div(gains, losses).alias("profit_factor"), F.avg(price).alias("avg_price"), F.avg(mid).alias("avg_mid"), F.avg(settle).alias("avg_settle"))


def edge_by_book_side(books: DataFrame) -> DataFrame:
    """Quantiles of four complete-set edges from the snapshot nearest to each trade on both outcomes."""
    lag = F.abs(F.unix_micros("captured_at") - F.unix_micros("trade_at"))
    quote = F.struct("best_bid_price", "best_ask_price")
    nearest = lambda o: F.min_by(quote, F.when(F.col("outcome") == o, F.struct(lag.alias("l"), F.col("captured_at"), quote)))
    both = books.filter(F.col("outcome").isin("Up", "Down")).groupBy("trade_key").agg(nearest("Up").alias("u"), nearest("Down").alias("d")).filter(
        F.col("u.best_bid_price").isNotNull() & F.col("d.best_bid_price").isNotNull())
    ub, ua, db, da = (F.col(c) for c in ("u.best_bid_price", "u.best_ask_price", "d.best_bid_price", "d.best_ask_price"))
    edge = lambda n, a, b: F.struct(F.lit(n).alias("edge"), F.round(F.lit(1.0) - (a + b), 6).alias("v"))
    long = both.select(F.explode(F.array(
        edge("edge_bid", ub, db), edge("edge_bid_ask", ub, da), edge("edge_ask_bid", ua, db), edge("edge_ask", ua, da))).alias("e")).select("e.*")
    probs = {"p05": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    return exact_quantiles(long, ["edge"], F.col("v"), probs, interpolate=True).join(long.groupBy("edge").agg(F.count("v").alias("n")), "edge")


def market_coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Overlap of two users' markets, plain and weighted by the first user's trades."""
    a = first.groupBy("market_slug").agg(F.count(F.lit(1)).alias("na"))
    b = second.groupBy("market_slug").agg(F.count(F.lit(1)).alias("nb"))
    joined = a.join(b, "market_slug", "full_outer")
    mine, both = F.col("na").isNotNull(), F.col("na").isNotNull() & F.col("nb").isNotNull()
    return joined.agg(
        count_if(mine).alias("markets_a"), count_if(F.col("nb").isNotNull()).alias("markets_b"), count_if(both).alias("overlap"),
        F.coalesce(F.sum("na"), F.lit(0)).alias("trades_a"), F.coalesce(F.sum(F.when(both, F.col("na"))), F.lit(0)).alias("trades_in_overlap"),
        F.round(div0(count_if(both) * 100.0, count_if(mine)) + 1e-9, 2).alias("overlap_pct"),
        F.round(div0(F.sum(F.when(both, F.col("na"))) * 100.0, F.sum("na")) + 1e-9, 2).alias("trade_overlap_pct"))


def missing_markets(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    counts = first.groupBy("market_slug").agg(F.count(F.lit(1)).alias("trades"))
    return counts.join(second.select("market_slug"), "market_slug", "left_anti").orderBy(F.desc("trades"), "market_slug").limit(limit)
