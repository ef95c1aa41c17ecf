"""Trade enrichment chain: book at trade, market metadata, settlement, continuous book, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.functions.numeric import div, millis_between, seconds_between
from tradelens.operators.asof import asof_join, asof_lookups
from tradelens.operators.latest import latest_per_key

BOOK_COLUMNS = [
    "captured_at", "best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size", "mid", "spread",
    "total_bid_volume", "total_ask_volume", "bid_levels", "ask_levels",
]
MARKET_COLUMNS = ["market_id", "end_date", "active", "outcomes", "outcome_prices", "token_ids", "volume_num"]


def trade_enrich(trades: DataFrame, book_by_trade: DataFrame, markets_latest: DataFrame) -> DataFrame:
    """Trades with their book snapshot, market row, time to end and settlement result."""
    book = book_by_trade.select(
        F.col("trade_key").alias("event_key"), "token_id",
        *[F.col(c).alias("tob_captured_at" if c == "captured_at" else c) for c in BOOK_COLUMNS if c in book_by_trade.columns],
    )
    market = markets_latest.select(F.col("slug").alias("market_slug"), *MARKET_COLUMNS)
    joined = trades.join(book, ["event_key", "token_id"], "left").join(market, "market_slug", "left")
    return (
        joined.withColumn("end_date", F.coalesce("end_date", C.slug_end("market_slug")))
        .withColumns({
            "seconds_to_end": seconds_between("ts", "end_date"),
            "price_minus_mid": F.col("price") - F.col("mid"),
            "is_resolved": C.is_resolved(),
            "resolved_outcome": C.resolved_outcome(),
            "settle_price": C.settle_price(),
        })
        .withColumn("realized_pnl", C.trade_pnl(F.col("settle_price")))
    )


def research_columns(enriched: DataFrame) -> DataFrame:
    """Labels and execution measures on top of the enriched trade."""
    known = C.book_known()
    spread_known = known & (F.col("mid") > 0) & (F.col("spread") > 0)
    return enriched.withColumns({
        "day": F.to_date("ts"),
        "hour_utc": F.hour("ts"),
        "notional_usd": F.col("price") * F.col("size"),
        "series": C.series_of("market_slug", "title"),
        "asset": C.asset_of("market_slug"),
        "tob_known": known,
        "exec_type": C.exec_type(known),
        "edge_vs_mid": F.when(known, C.edge_vs_mid()),
        "effective_spread": F.when(known, C.effective_spread()),
        "effective_spread_ratio": F.when(spread_known, div(C.effective_spread(), "spread")),
        "tob_lag_millis": millis_between("ts", "tob_captured_at"),
        "tob_imbalance": F.when(known, C.imbalance("best_bid_size", "best_ask_size")),
    })


def enrich_v2(enriched: DataFrame, receipts: DataFrame, onchain: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds the receipt, the on-chain pair and the market resolution."""
    tx = receipts.select(
        F.col("tx_hash").alias("transaction_hash"), F.col("block_number").alias("tx_block_number"),
        F.col("block_timestamp").alias("tx_block_timestamp"), F.col("status").alias("tx_status"),
        F.col("gas_used").alias("tx_gas_used"),
    )
    pair = onchain.select(
        "event_key", "onchain_usdc", "onchain_shares", "onchain_price",
        F.col("pair_token_id").alias("onchain_pair_token_id"), F.col("price_sum").alias("onchain_price_sum"),
        F.lit(True).alias("_onchain"),
    )
    done = resolutions.select("market_slug", F.col("resolution_time").alias("market_resolved_at"))
    return (
        enriched.join(tx, "transaction_hash", "left").join(pair, "event_key", "left").join(done, "market_slug", "left")
        .withColumns({
            "onchain_matched": F.coalesce("_onchain", F.lit(False)),
            "complete_set_like": F.col("onchain_pair_token_id").isNotNull(),
            "complete_set_edge": F.when(F.col("onchain_price_sum") != 0, F.lit(1.0) - F.col("onchain_price_sum")),
            "full_book_imbalance": C.imbalance("total_bid_volume", "total_ask_volume"),
            "tob_imbalance": C.imbalance("best_bid_size", "best_ask_size"),
            "seconds_to_resolution": seconds_between("ts", "market_resolved_at"),
            "exec_type": C.exec_type_loose("price", "best_bid_price", "best_ask_price", "mid"),
        })
        .drop("_onchain")
    )


def _ws_side(df: DataFrame, prefix: str) -> DataFrame:
    """Zero quotes count as missing; mid and spread need both sides."""
    quoted = ["best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size", "last_trade_price"]
    df = df.withColumns({f"{prefix}{c}": F.nullif(F.col(f"{prefix}{c}"), F.lit(0.0)) for c in quoted})
    bid, ask = F.col(f"{prefix}best_bid_price"), F.col(f"{prefix}best_ask_price")
    both = (bid > 0) & (ask > 0)
    return df.withColumns({
        f"{prefix}mid": F.when(both, (bid + ask) / 2),
        f"{prefix}spread": F.when(both, ask - bid),
        f"{prefix}tob_lag_millis": millis_between(f"{prefix}ts", "ts"),
    }).withColumnRenamed(f"{prefix}ts", f"{prefix}tob_captured_at")


def _ws_columns(ws_tob: DataFrame) -> DataFrame:
    """One quote per (asset, ts): the one written last."""
    return latest_per_key(
        ws_tob.select("asset_id", "ts", "best_bid_price", "best_bid_size", "best_ask_price", "best_ask_size",
                      "last_trade_price", "seq", "offset"),
        ["asset_id", "ts"], ["seq", "offset"],
    ).drop("seq", "offset")


def with_ws_book(enriched: DataFrame, ws_tob: DataFrame) -> DataFrame:
    """Latest continuous quote of the traded token at or before the trade."""
    out = asof_join(enriched, _ws_columns(ws_tob), "token_id", "asset_id", prefix="ws_")
    return _ws_side(out, "ws_").withColumn(
        "ws_exec_type", C.exec_type_loose("price", "ws_best_bid_price", "ws_best_ask_price", "ws_mid"))


def with_both_books(enriched: DataFrame, ws_tob: DataFrame) -> DataFrame:
    """Latest continuous quotes of the traded token and of the other token of its market, in one scan of the quotes, and the cost of buying both at the ask."""
    keyed = enriched.withColumn("opposite_token_id", C.opposite_token())
    out = asof_lookups(keyed, _ws_columns(ws_tob), {"ws_": "token_id", "ws_opp_": "opposite_token_id"}, "asset_id")
    out = _ws_side(out, "ws_").withColumn("ws_exec_type", C.exec_type_loose("price", "ws_best_bid_price", "ws_best_ask_price", "ws_mid"))
    out = _ws_side(out, "ws_opp_")
    ask, other = F.col("ws_best_ask_price"), F.col("ws_opp_best_ask_price")
    total = F.when((ask > 0) & (other > 0), ask + other)
    return out.withColumns({"ws_complete_set_ask_sum": total, "ws_complete_set_edge_ask": F.lit(1.0) - total})


# ---- minute bars -----------------------------------------------------------------------------


def minute_bars(prints: DataFrame) -> DataFrame:
    """Per token and minute: counts, volume, vwap, range, volatility and signed flow."""
    size, price = F.col("size"), F.col("price")
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    volume = F.sum("size")
    buy_volume = F.coalesce(F.sum(F.when(buy, size)), F.lit(0.0))
    sell_volume = F.coalesce(F.sum(F.when(sell, size)), F.lit(0.0))
    return prints.groupBy("token_id", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("trade_count"),
        volume.alias("volume"),
        F.sum(size * price).alias("notional"),
        F.avg(price).alias("avg_price"),
        div(F.sum(size * price), volume).alias("vwap"),
        F.min(price).alias("low_price"),
        F.max(price).alias("high_price"),
        (F.max(price) - F.min(price)).alias("price_range"),
        F.stddev_pop(price).alias("price_volatility"),
        buy_volume.alias("buy_volume"),
        sell_volume.alias("sell_volume"),
        F.count(F.when(buy, 1)).alias("buy_count"),
        F.count(F.when(sell, 1)).alias("sell_count"),
        F.coalesce(div(buy_volume - sell_volume, volume), F.lit(0.0)).alias("flow_imbalance"),
        F.min("ts").alias("first_trade_at"),
        F.max("ts").alias("last_trade_at"),
    )


def minute_lag_join(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Market activity one and two minutes before and one minute after each trade.

    The three neighbour minutes are gathered per token-minute of the trades first, so the wide trade
    rows are shuffled once for a single equality join.
    """
    minute = F.date_trunc("minute", "ts")
    wanted = ["volume", "trade_count", "flow_imbalance", "price_volatility", "vwap", "price_range"]
    pack = F.struct(*wanted)
    shifted = bars.select(
        "token_id", pack.alias("bar"),
        F.explode(F.array(
            F.struct((F.col("minute") + F.expr("INTERVAL 1 MINUTE")).alias("minute"), F.lit("b1").alias("slot")),
            F.struct((F.col("minute") + F.expr("INTERVAL 2 MINUTE")).alias("minute"), F.lit("b2").alias("slot")),
            F.struct((F.col("minute") - F.expr("INTERVAL 1 MINUTE")).alias("minute"), F.lit("a1").alias("slot")),
        )).alias("at"),
    )
    around = shifted.groupBy("token_id", F.col("at.minute").alias("_minute")).agg(
        *[F.max(F.when(F.col("at.slot") == s, F.col("bar"))).alias(f"_{s}") for s in ("b1", "b2", "a1")])
    joined = trades.withColumn("_minute", minute).join(around, ["token_id", "_minute"], "left")
    b1, b2, a1 = F.col("_b1"), F.col("_b2"), F.col("_a1")
    return joined.withColumns({
        "volume_1m_before": b1["volume"],
        "trades_1m_before": b1["trade_count"],
        "flow_imbalance_1m_before": b1["flow_imbalance"],
        "volatility_1m_before": b1["price_volatility"],
        "vwap_1m_before": b1["vwap"],
        "price_range_1m_before": b1["price_range"],
        "volume_1m_after": a1["volume"],
        "trades_1m_after": a1["trade_count"],
        "flow_imbalance_1m_after": a1["flow_imbalance"],
        "volume_acceleration": F.when(
            (b1["volume"] > 0) & (b2["volume"] > 0), div(b1["volume"] - b2["volume"], b2["volume"])),
        "price_vs_vwap": F.when(b1["vwap"] > 0, F.col("price") - b1["vwap"]),
    }).drop("_minute", "_b1", "_b2", "_a1")


def label_pivot_join(trades: DataFrame, labels: DataFrame) -> DataFrame:
    """Cluster, regime and complete-set labels of a trade as columns."""
    kind = lambda k, c: F.max(F.when(F.col("label_type") == k, F.col(c)))
    wide = labels.filter(F.col("label_type").isin("cluster", "regime", "complete_set")).groupBy("event_key").agg(
        kind("cluster", "label_value").alias("cluster_label"),
        kind("cluster", "label_score").alias("cluster_score"),
        kind("regime", "label_value").alias("research_regime"),
        kind("complete_set", "label_value").alias("complete_set_flag"),
        kind("complete_set", "label_score").alias("complete_set_edge"),
    )
    return trades.join(wide, "event_key", "left")
