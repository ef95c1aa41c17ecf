"""Position ledgers, final positions, settlement and complete sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.functions.numeric import above_zero, count_if, div, div0, int_div, seconds_between, sum_if
from tradelens.operators.latest import latest_per_key
from tradelens.operators.ordering import top_per
from tradelens.operators.scan import ordered_scan, time_segment

UP_NAMES = ("Up", "Yes")
DOWN_NAMES = ("Down", "No")
POSITION_KEYS = ("username", "market_slug", "token_id")


def latest_quotes(ws_tob: DataFrame) -> DataFrame:
    """Newest continuous quote per token."""
    return latest_per_key(ws_tob, ["asset_id"], ["ts", "seq", "offset"]).select(
        "asset_id", F.col("ts").alias("tob_ts"), "best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size",
        "last_trade_price")


def position_ledger(trades: DataFrame, keys: Sequence[str] = POSITION_KEYS) -> DataFrame:
    """Running shares and cost per position in (ts, event_key) order."""
    size, cost = F.col("size"), F.col("price") * F.col("size")
    flows = trades.withColumns({"signed_shares": C.signed("side", size), "signed_cost_usd": C.signed("side", cost)})
    out = ordered_scan(
        flows, keys, time_segment("ts"), ["ts", "event_key"],
        sums={"position_shares": F.col("signed_shares"), "position_cost_usd": F.col("signed_cost_usd")})
    return out.withColumn("avg_entry_price", F.when(F.col("position_shares") > 0, div("position_cost_usd", "position_shares")))


def flow_columns() -> dict[str, Column]:
    """Bought, sold and net totals of a group of trades."""
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    cost = F.col("price") * F.col("size")
    bought, sold = sum_if("size", buy), sum_if("size", sell)
    paid, received = sum_if(cost, buy), sum_if(cost, sell)
    return {
        "trades": F.count(F.lit(1)), "first_trade_at": F.min("ts"), "last_trade_at": F.max("ts"),
        "buy_shares": bought, "sell_shares": sold, "net_shares": bought - sold,
        "buy_cost_usd": paid, "sell_proceeds_usd": received, "net_cost_usd": paid - received,
        "avg_buy_price": div(paid, bought), "avg_sell_price": div(received, sold),
    }


def position_final(trades: DataFrame, keys: Sequence[str] = POSITION_KEYS) -> DataFrame:
    """Net shares, cost and average prices per position; names come from its latest trade."""
    newest = F.max_by(F.struct("title", "outcome"), F.struct("ts", "event_key"))
    flows = [c.alias(n) for n, c in flow_columns().items()]
    return trades.groupBy(*keys).agg(newest.alias("_n"), *flows).select(
        *keys, F.col("_n.title").alias("title"), F.col("_n.outcome").alias("outcome"), *flow_columns())


def settled_positions(positions: DataFrame, markets_latest: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Positions with their market's settlement, and mark-to-market where a mid is known."""
    m = markets_latest.select(F.col("slug").alias("market_slug"), "end_date", "outcomes", "outcome_prices")
    out = positions.join(m, "market_slug", "left").withColumns({
        "is_resolved": C.is_resolved(), "settle_price": C.settle_price(), "resolved_outcome": C.resolved_outcome(),
    }).withColumn("realized_pnl_usd", F.col("settle_price") * F.col("net_shares") - F.col("net_cost_usd"))
    if marks is not None:
        out = out.join(marks, ["market_slug", "token_id"], "left").withColumn(
            "mtm_pnl_usd", F.when(F.col("mid") > 0, F.col("mid") * F.col("net_shares") - F.col("net_cost_usd")))
    return out.drop("outcomes", "outcome_prices")


def latest_marks(tob_raw: DataFrame) -> DataFrame:
    cols = ["market_slug", "token_id", "captured_at", "trade_key", "best_bid_price", "best_ask_price", "mid", "spread"]
    latest = latest_per_key(tob_raw.select(*cols), ["market_slug", "token_id"], ["captured_at", "trade_key"])
    return latest.select("market_slug", "token_id", F.col("captured_at").alias("latest_tob_at"), "best_bid_price",
                         "best_ask_price", "mid", "spread")


def position_summary(trades: DataFrame, settled: DataFrame) -> DataFrame:
    """Per user: open and resolved markets, open cost, mark-to-market and realised PnL."""
    live = ~F.col("is_resolved") & (F.col("net_shares") != 0)
    return settled.groupBy("username").agg(
        F.count_distinct("market_slug").alias("markets"),
        F.count_distinct(F.when(~F.col("is_resolved"), F.col("market_slug"))).alias("open_markets"),
        F.count_distinct(F.when(F.col("is_resolved"), F.col("market_slug"))).alias("resolved_markets"),
        sum_if("net_cost_usd", live).alias("open_net_cost_usd"),
        sum_if("mtm_pnl_usd", live & (F.col("mid") > 0)).alias("open_mtm_pnl_usd"),
        sum_if("realized_pnl_usd", F.col("is_resolved") & F.col("settle_price").isNotNull()).alias("realized_pnl_usd"),
    )


STATES = {
    "OPEN": ("NOT is_resolved", "abs(net_cost_usd)"),
    "RESOLVED": ("is_resolved", "realized_pnl_usd"),
    "ALL": ("true", "last_trade_at"),
}


def token_positions(settled: DataFrame, state: str = "ALL", limit: int = 200) -> DataFrame:
    """Each user's top positions of a state; an open position must still hold shares."""
    where, order = STATES[state]
    rows = settled.filter(where)
    if state == "OPEN":
        rows = rows.filter("net_shares != 0")
    return top_per(rows, ["username"], [F.expr(order).desc_nulls_last(), F.asc("market_slug"), F.asc("token_id")], limit)


def market_positions(settled: DataFrame) -> DataFrame:
    """Positions rolled up to (user, market)."""
    done = F.col("is_resolved")
    keys = ["username", "market_slug", "end_date", "is_resolved", "resolved_outcome"]
    rolled = settled.groupBy(*keys).agg(
        F.sum("trades").alias("trades"), F.min("first_trade_at").alias("first_trade_at"),
        F.max("last_trade_at").alias("last_trade_at"), F.count(F.lit(1)).alias("token_positions"),
        F.sum("net_cost_usd").alias("net_cost_usd"),
        sum_if("realized_pnl_usd", F.col("realized_pnl_usd").isNotNull()).alias("_r"),
        sum_if("mtm_pnl_usd", F.col("mtm_pnl_usd").isNotNull()).alias("_m"),
    )
    return rolled.select(
        *[c for c in rolled.columns if c not in ("_r", "_m")],
        F.when(done, F.col("_r")).alias("realized_pnl_usd"), F.when(~done, F.col("_m")).alias("mtm_pnl_usd"))


def top_market_positions(rolled: DataFrame, state: str = "ALL", limit: int = 200) -> DataFrame:
    where, order = STATES[state]
    return top_per(rolled.filter(where), ["username"], [F.expr(order).desc_nulls_last(), F.asc("market_slug")], limit)


def asset_roi(settled: DataFrame) -> DataFrame:
    """Realised PnL over cost per user and 15-minute asset."""
    rows = settled.withColumn("asset", C.asset_of("market_slug")).filter(
        (F.col("asset") != "") & F.col("realized_pnl_usd").isNotNull())
    cost, pnl = F.sum("net_cost_usd"), F.sum("realized_pnl_usd")
    return rows.groupBy("username", "asset").agg(
        F.count(F.lit(1)).alias("token_positions"), cost.alias("net_cost_usd"), pnl.alias("realized_pnl_usd"),
        F.when(above_zero(cost), div0(pnl, cost)).otherwise(0.0).alias("roi"))


def entry_buckets(settled: DataFrame, width: int = 60) -> DataFrame:
    """PnL and ROI by how long before the end the first trade came."""
    left = C.seconds_to_slug_end("market_slug", "first_trade_at")
    rows = settled.filter(C.is_15m("market_slug") & (C.slug_epoch("market_slug") > 0)).withColumn("_left", left).filter(
        F.col("_left").between(-60, 900) & F.col("realized_pnl_usd").isNotNull())
    start = int_div(F.col("_left"), width) * width
    cost, pnl = F.sum("net_cost_usd"), F.sum("realized_pnl_usd")
    return rows.groupBy("username", start.alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("token_positions"), cost.alias("net_cost_usd"), pnl.alias("realized_pnl_usd"),
        F.when(above_zero(cost), div0(pnl, cost)).otherwise(0.0).alias("roi"),
    ).withColumn("bucket_end", F.col("bucket_start") + width)


# ---- complete sets ---------------------------------------------------------------------------


def both_sides(trades: DataFrame, keys: Sequence[Column | str], up=("Up",), down=("Down",)) -> DataFrame:
    """Shares, cost and average price of each outcome bought in a group, and the matched quantity."""
    bought = trades.filter((F.col("side") == "BUY") & F.col("outcome").isin(*up, *down))
    is_up, is_down = F.col("outcome").isin(*up), F.col("outcome").isin(*down)
    cost = F.col("size") * F.col("price")
    grouped = bought.groupBy(*keys).agg(
        F.max("title").alias("title"),
        sum_if("size", is_up).alias("up_shares"), sum_if(cost, is_up).alias("up_cost"), count_if(is_up).alias("up_trades"),
        sum_if("size", is_down).alias("down_shares"), sum_if(cost, is_down).alias("down_cost"),
        count_if(is_down).alias("down_trades"),
        F.min("ts").alias("first_trade_at"), F.max("ts").alias("last_trade_at"),
    )
    up_price, down_price = div0("up_cost", "up_shares"), div0("down_cost", "down_shares")
    return grouped.withColumns({
        "matched_shares": F.least("up_shares", "down_shares"),
        "avg_up_price": up_price, "avg_down_price": down_price,
        "edge_per_share": F.lit(1.0) - (up_price + down_price),
    }).withColumn("edge_pnl", F.col("matched_shares") * F.col("edge_per_share"))


def complete_sets_by_market(trades: DataFrame) -> DataFrame:
    return both_sides(trades, ["username", "market_slug"], UP_NAMES, DOWN_NAMES).filter("up_shares > 0 AND down_shares > 0")


def complete_sets_summary(by_market: DataFrame) -> DataFrame:
    matched, pnl = F.sum("matched_shares"), F.sum("edge_pnl")
    return by_market.groupBy("username").agg(
        F.count(F.lit(1)).alias("total_markets"), count_if(above_zero("edge_per_share")).alias("positive_edge_markets"),
        matched.alias("total_matched_shares"), pnl.alias("total_edge_pnl"),
        F.when(matched > 0, div0(pnl, matched)).otherwise(0.0).alias("avg_edge_per_share"),
        F.avg(F.col("up_trades") + F.col("down_trades")).alias("avg_trades_per_market"))


def complete_set_stats(trades: DataFrame) -> DataFrame:
    """Per user over all Up/Down markets, also those bought on one side only."""
    m = both_sides(trades, ["username", "market_slug"])
    matched, pnl = F.sum("matched_shares"), F.sum("edge_pnl")
    return m.groupBy("username").agg(
        F.count(F.lit(1)).alias("markets_traded"), count_if(F.col("matched_shares") > 0).alias("markets_with_complete_sets"),
        matched.alias("complete_set_shares_total"), pnl.alias("total_implied_edge_usd"),
        F.when(matched > 0, div0(pnl, matched)).otherwise(0.0).alias("avg_implied_edge_per_share"))


def windowed_complete_sets(trades: DataFrame, seconds: int = 60) -> DataFrame:
    """(user, market, tumbling window) groups in which both outcomes were bought."""
    window = F.window("ts", f"{seconds} seconds")["start"].alias("window_start")
    return both_sides(trades, ["username", "market_slug", window]).filter("up_shares > 0 AND down_shares > 0")


def windowed_rollup(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    matched, pnl = F.sum("matched_shares"), F.sum("edge_pnl")
    return windows.groupBy(*keys).agg(
        F.count_distinct("market_slug").alias("markets_with_sets"), F.count(F.lit(1)).alias("windows_with_both_sides"),
        matched.alias("detected_shares"), pnl.alias("total_implied_edge_usd"),
        F.when(matched > 0, div0(pnl, matched)).otherwise(0.0).alias("avg_implied_edge_per_share"))


def complete_set_pairs(trades: DataFrame, window_seconds: int = 60, most_legs: int = 512) -> DataFrame:
    """Pairs of opposite-outcome buys in one market at most ``window_seconds`` apart.

    The second leg is offered to the time slot of the first leg only (its own slot and the one
    before), so a hot market is cut into slots and no pair outside the window is ever built. A slot of more than ``most_legs`` first legs is divided by their hash; its
    second legs go to each part, so one task joins at most about that many first legs, however busy a minute is.
    """
    names = [*UP_NAMES, *DOWN_NAMES]
    cols = ["username", "market_slug", "condition_id", "ts", "event_key", "outcome", "price", "size"]
    bought = trades.filter((F.col("side") == "BUY") & F.col("outcome").isin(names)).select(*cols)
    slot = F.floor(F.unix_seconds("ts") / F.lit(window_seconds + 1)).cast("bigint")
    keys = ["username", "market_slug", "condition_id", "_slot"]

    def leg(n: int, slots: Column) -> DataFrame:
        return bought.select(
            *cols[:3], *[F.col(c).alias(f"{c}_{n}") for c in cols[3:]], slots.alias("_slot"))

    first = leg(1, slot)
    second = leg(2, F.explode(F.array(slot - 1, slot)))
    busy = first.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(most_legs)).alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    first = first.join(busy, keys, "left").withColumn("_part", F.pmod(F.xxhash64("event_key_1"), parts)).drop("_parts")
    second = second.join(busy, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1))).drop("_parts")
    gap = seconds_between("ts_1", "ts_2")
    cost = F.col("price_1") + F.col("price_2")
    return (
        first.join(second, [*keys, "_part"])
        .filter((F.col("outcome_1") != F.col("outcome_2")) & (F.col("ts_1") <= F.col("ts_2"))
                & (F.col("event_key_1") < F.col("event_key_2")) & (gap <= window_seconds))
        .drop("_slot", "_part", "condition_id")
        .withColumns({
            "time_gap_sec": gap, "matched_size": F.least("size_1", "size_2"), "combined_cost": cost,
            "edge_per_share": F.lit(1.0) - cost, "edge_pnl": F.least("size_1", "size_2") * (F.lit(1.0) - cost),
        })
    )
