"""Typed tables projected from event envelopes.

A projection lists its columns as ``name: (json path, kind)``. The paths of one projection are folded
into a single ``from_json`` schema whose leaves are text, so each payload is parsed once and a leaf
may arrive as a number or as a quoted number.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.sources.envelopes import best_effort_ts

LEVELS = "array<struct<price:string,size:string>>"


def _number(text: Column) -> Column:
    return text.try_cast("double")


# Cell kinds: how the text of a leaf becomes a column.
KINDS = {
    "text": lambda c: c,
    "upper": lambda c: F.upper(c),
    "number": _number,
    "positive": lambda c: F.nullif(_number(c), F.lit(0.0)),  # zero stands for missing
    "int": lambda c: c.try_cast("int"),
    "long": lambda c: c.try_cast("bigint"),
    "flag": lambda c: F.coalesce(c.try_cast("boolean"), F.lit(False)),
    "maybe_flag": lambda c: c.try_cast("boolean"),
    "time": best_effort_ts,
    "texts": lambda c: F.from_json(c, "array<string>"),
    "numbers": lambda c: F.transform(F.from_json(c, "array<string>"), _number),
    "levels": lambda c: F.transform(F.from_json(c, LEVELS), lambda x: F.struct(
        x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size"))),
}


@dataclass(frozen=True)
class Projection:
    """Columns read from payloads of one event type.

    ``event_type`` is compared with the end of the envelope's type, so a feed may put its own
    namespace in front. ``time_default`` names columns that fall back to the envelope time.
    """

    event_type: str
    cells: Mapping[str, tuple[str, str]]
    time_default: tuple[str, ...] = ()
    type_start: str = ""
    derived: Mapping[str, str] = field(default_factory=dict)


TRADE_CELLS = {
    "market_slug": ("trade.slug", "text"), "title": ("trade.title", "text"), "token_id": ("trade.asset", "text"),
    "condition_id": ("trade.conditionId", "text"), "side": ("trade.side", "text"), "outcome": ("trade.outcome", "text"),
    "outcome_index": ("trade.outcomeIndex", "int"), "price": ("trade.price", "number"), "size": ("trade.size", "number"),
    "transaction_hash": ("trade.transactionHash", "text"),
}
ERROR_CELLS = {
    "error_type": ("error.type", "text"), "error_upstream_status": ("error.upstreamStatus", "int"),
    "error_upstream_method": ("error.upstreamMethod", "text"), "error_upstream_url": ("error.upstreamUrl", "text"),
    "error_message": ("error.message", "text"),
}


def _book(prefix: str, node: str) -> dict[str, tuple[str, str]]:
    return {
        f"{prefix}best_bid_price": (f"{node}.bestBid", "positive"), f"{prefix}best_bid_size": (f"{node}.bestBidSize", "positive"),
        f"{prefix}best_ask_price": (f"{node}.bestAsk", "positive"), f"{prefix}best_ask_size": (f"{node}.bestAskSize", "positive"),
        f"{prefix}last_trade_price": (f"{node}.lastTradePrice", "positive"),
        f"{prefix}tob_updated_at": (f"{node}.updatedAt", "time"), f"{prefix}last_trade_at": (f"{node}.lastTradeAt", "time"),
    }


ORDER_CELLS = {
    "token_id": ("tokenId", "text"), "side": ("side", "text"), "price": ("price", "positive"), "order_type": ("orderType", "text"),
    "tick_size": ("tickSize", "positive"), "neg_risk": ("negRisk", "maybe_flag"), "fee_rate_bps": ("feeRateBps", "int"),
    "nonce": ("nonce", "long"), "defer_exec": ("deferExec", "maybe_flag"), "mode": ("mode", "text"), "success": ("success", "flag"),
    "order_id": ("orderId", "text"), **ERROR_CELLS,
}

# Payload paths of each event type.
PROJECTIONS: dict[str, Projection] = {
    "user_trades": Projection("user.trade", {
        "username": ("username", "text"), "proxy_address": ("proxyAddress", "text"), **TRADE_CELLS}),
    "market_trades": Projection("market.trade", {
        "captured_at": ("capturedAt", "time"), **TRADE_CELLS, "market_slug": ("marketSlug", "text"),
        "proxy_wallet": ("trade.proxyWallet", "text")}, time_default=("captured_at",)),
    "clob_tob": Projection("clob.tob", {
        "captured_at": ("capturedAt", "time"), "market_slug": ("marketSlug", "text"), "token_id": ("tokenId", "text"),
        "outcome": ("outcome", "text"), "trade_key": ("trigger.tradeKey", "text"), "trade_at": ("trigger.tradeAt", "time"),
        "username": ("trigger.username", "text"), "proxy_address": ("trigger.proxyAddress", "text"),
        "best_bid_price": ("book.bestBid.price", "number"), "best_bid_size": ("book.bestBid.size", "number"),
        "best_ask_price": ("book.bestAsk.price", "number"), "best_ask_size": ("book.bestAsk.size", "number"),
        "mid": ("book.mid", "number"), "spread": ("book.spread", "number"), "book_timestamp_ms": ("book.timestamp", "long"),
        "book_hash": ("book.hash", "text"), "cached": ("cached", "flag"), "cache_age_millis": ("cacheAgeMillis", "long"),
        "bid_levels": ("book.bidLevels", "levels"), "ask_levels": ("book.askLevels", "levels"),
        "total_bid_volume": ("book.totalBidVolume", "number"), "total_ask_volume": ("book.totalAskVolume", "number"),
        "book_imbalance": ("book.bookImbalance", "number"), "depth_at_1pct": ("book.depthAt1Pct", "number"),
    }, time_default=("captured_at",)),
    "gamma_markets": Projection("gamma.market", {
        "captured_at": ("capturedAt", "time"), "slug": ("slug", "text"), "market_id": ("market.id", "text"),
        "condition_id": ("market.conditionId", "text"), "end_date": ("market.endDate", "time"),
        "event_start_time": ("market.eventStartTime", "time"), "active": ("market.active", "flag"), "closed": ("market.closed", "flag"),
        "uma_resolution_status": ("market.umaResolutionStatus", "text"), "outcomes": ("market.outcomes", "texts"),
        "outcome_prices": ("market.outcomePrices", "numbers"), "token_ids": ("market.clobTokenIds", "texts"),
        "best_bid": ("market.bestBid", "number"), "best_ask": ("market.bestAsk", "number"),
        "last_trade_price": ("market.lastTradePrice", "number"), "volume_num": ("market.volumeNum", "number"),
        "liquidity_num": ("market.liquidityNum", "number"), "restricted": ("market.restricted", "flag"),
    }, time_default=("captured_at",)),
    "tx_receipts": Projection("tx.receipt", {
        "captured_at": ("capturedAt", "time"), "chain_id": ("chainId", "long"), "tx_hash": ("txHash", "text"),
        "block_number": ("blockNumber", "long"), "block_timestamp": ("blockTimestamp", "time"), "status": ("status", "int"),
        "from_address": ("from", "text"), "to_address": ("to", "text"), "gas_used": ("gasUsed", "long"),
        "effective_gas_price": ("effectiveGasPrice", "long"), "receipt_json": ("receipt", "text"),
    }, time_default=("captured_at", "block_timestamp")),
    "ws_tob": Projection("ws.tob", {
        "captured_at": ("updatedAt", "time"), "asset_id": ("assetId", "text"), "best_bid_price": ("bestBid", "number"),
        "best_bid_size": ("bestBidSize", "number"), "best_ask_price": ("bestAsk", "number"), "best_ask_size": ("bestAskSize", "number"),
        "last_trade_price": ("lastTradePrice", "number"), "last_trade_at": ("lastTradeAt", "time"),
    }, time_default=("captured_at",)),
    "ws_trades": Projection("ws.trade", {
        "captured_at": ("capturedAt", "time"), "market_id": ("market", "text"), "asset_id": ("assetId", "text"), "side": ("side", "upper"),
        "price": ("price", "number"), "size": ("size", "number"), "fee_rate_bps": ("feeRateBps", "long"),
        "transaction_hash": ("transactionHash", "text"),
    }, time_default=("captured_at",)),
    "strategy_orders": Projection(".order", {
        "strategy": ("strategy", "text"), "run_id": ("runId", "text"), "action": ("action", "text"), "reason": ("reason", "text"),
        "market_slug": ("marketSlug", "text"), "market_type": ("marketType", "text"), "token_id": ("tokenId", "text"),
        "direction": ("direction", "text"), "seconds_to_end": ("secondsToEnd", "long"), "tick_size": ("tickSize", "positive"),
        "success": ("success", "flag"), "error": ("error", "text"), "order_id": ("orderId", "text"), "price": ("price", "positive"),
        "size": ("size", "positive"), "replaced_order_id": ("replacedOrderId", "text"), "replaced_price": ("replacedPrice", "positive"),
        "replaced_size": ("replacedSize", "positive"), "replaced_order_age_millis": ("replacedOrderAgeMillis", "long"),
        "order_age_millis": ("orderAgeMillis", "long"), **_book("", "book"), "other_token_id": ("otherTokenId", "text"),
        **_book("other_", "otherBook"),
    }, type_start="strategy."),
    "limit_orders": Projection("order.limit", {
        **ORDER_CELLS, "size": ("size", "positive"), "expiration_seconds": ("expirationSeconds", "long")}),
    "market_orders": Projection("order.market", {**ORDER_CELLS, "amount": ("amount", "positive")}),
    "cancel_orders": Projection("order.cancel", {
        "order_id": ("orderId", "text"), "mode": ("mode", "text"), "success": ("success", "flag"), **ERROR_CELLS}),
    "order_status": Projection("order.status", {
        "order_id": ("orderId", "text"), "token_id": ("tokenId", "text"), "side": ("side", "text"),
        "requested_price": ("requestedPrice", "positive"), "requested_size": ("requestedSize", "positive"),
        "exchange_status": ("exchangeStatus", "text"), "matched_size": ("matchedSize", "positive"),
        "remaining_size": ("remainingSize", "positive"), "order_json": ("orderJson", "text"), "error": ("error", "text")}),
    "global_trades": Projection("global.trade", {
        "trade_id": ("id", "text"), "username": ("username", "text"), "pseudonym": ("pseudonym", "text"),
        "proxy_address": ("proxyWallet", "text"), "market_slug": ("slug", "text"), "title": ("title", "text"),
        "condition_id": ("conditionId", "text"), "token_id": ("asset", "text"), "side": ("side", "text"), "outcome": ("outcome", "text"),
        "outcome_index": ("outcomeIndex", "int"), "price": ("price", "number"), "size": ("size", "number"),
        "transaction_hash": ("transactionHash", "text"),
    }, derived={"notional": "price * size"}),
}


def payload_schema(cells: Mapping[str, tuple[str, str]]) -> T.StructType:
    """Nested struct with a text leaf for every path."""
    tree: dict = {}
    for path, _ in cells.values():
        node = tree
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node.setdefault(leaf, None)

    def build(node: dict) -> T.StructType:
        return T.StructType([T.StructField(k, T.StringType() if v is None else build(v)) for k, v in node.items()])

    return build(tree)


def is_type(spec: Projection) -> Column:
    kind = F.col("type").endswith(spec.event_type)
    return kind & F.col("type").startswith(spec.type_start) if spec.type_start else kind


def of_type(events: DataFrame, spec: Projection) -> DataFrame:
    return events.filter(is_type(spec))


def project(events: DataFrame, name: str, source: str | None = None) -> DataFrame:
    """Rows of one typed table; works on batch and streaming envelopes alike."""
    spec = PROJECTIONS[name]
    rows = of_type(events, spec)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    parsed = rows.withColumn("_p", F.from_json("data", payload_schema(spec.cells)))
    columns = []
    for column, (path, kind) in spec.cells.items():
        value = KINDS[kind](F.col("_p." + path))
        columns.append((F.coalesce(value, F.col("ts")) if column in spec.time_default else value).alias(column))
    out = parsed.select(
        "ts", *columns, F.col("kafka_key").alias("event_key"), "kafka_partition", "kafka_offset", "kafka_timestamp")
    return out.withColumns({c: F.expr(e) for c, e in spec.derived.items()}) if spec.derived else out
