"""Receipt log decoding and reconciliation of trades with chain flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.hexwords import address, as_long, big_number, scaled, small_number, word_at
from tradelens.functions.numeric import div, rnd, sum_if

# Event signatures (topic 0) and contract addresses of the chain.
ERC20_TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
ORDER_FILLED = "0xd0a08e8c493f9c94f29311604c9de1b4e8c8d4c06bd0c789af57f2d65bfec0f6"
ORDERS_MATCHED = "0x63bf4d16b7fa898ef4c4b2b6d90fd201e9c56313b65638af6088d149d2ce956c"
TRANSFER_SINGLE = "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
USDC = "0x2791bca1f2de4661ed88a30c99a7a9449aa84174"
EXCHANGE = "0x4bfb41d5b3570defd03c39a9a4d8de6bd8b8982e"
CONDITIONAL_TOKENS = "0x4d97dcd97ec945f40cf65f87097ace5ea0476045"

LOGS = "struct<logs:array<struct<address:string,topics:array<string>,data:string>>>"


def receipt_logs(receipts: DataFrame) -> DataFrame:
    """One row per log of a receipt."""
    logs = F.from_json("receipt_json", LOGS)["logs"]
    return receipts.select("tx_hash", "block_timestamp", F.posexplode(logs).alias("log_index", "log")).select(
        "tx_hash", "block_timestamp", "log_index", F.lower("log.address").alias("address"), F.col("log.topics").alias("topics"),
        F.col("log.data").alias("data"))


def _of(logs: DataFrame, signature: str, topics: int, emitter: str | None = None) -> DataFrame:
    keep = (F.lower(F.get("topics", F.lit(0))) == signature) & (F.size("topics") >= topics) & F.col("data").startswith("0x")
    return logs.filter(keep & (F.col("address") == emitter) if emitter else keep)


def _word(i: int) -> Column:
    return word_at(F.col("data"), i)


def erc20_transfers(logs: DataFrame) -> DataFrame:
    return _of(logs, ERC20_TRANSFER, 3).select(
        "tx_hash", "block_timestamp", "log_index", F.col("address").alias("token_address"), address(F.col("topics")[1]).alias("from_address"),
        address(F.col("topics")[2]).alias("to_address"), small_number(_word(0)).alias("amount_raw"))


def usdc_transfers(transfers: DataFrame) -> DataFrame:
    return transfers.filter(F.col("token_address") == USDC).withColumn("amount_usdc", F.col("amount_raw").cast("double") / F.lit(1e6))


def order_filled(logs: DataFrame) -> DataFrame:
    return _of(logs, ORDER_FILLED, 4, EXCHANGE).select(
        "tx_hash", "block_timestamp", "log_index", F.col("topics")[1].alias("order_hash"), address(F.col("topics")[2]).alias("addr1"),
        address(F.col("topics")[3]).alias("addr2"), big_number(_word(1)).alias("token_id"), scaled(_word(2)).alias("usdc_amount"),
        scaled(_word(3)).alias("shares_amount"))


def orders_matched(logs: DataFrame) -> DataFrame:
    return _of(logs, ORDERS_MATCHED, 3, EXCHANGE).select(
        "tx_hash", "block_timestamp", "log_index", F.col("topics")[1].alias("match_id"), address(F.col("topics")[2]).alias("user_address"),
        big_number(_word(1)).alias("token_id"), scaled(_word(2)).alias("usdc_amount"), scaled(_word(3)).alias("shares_amount"))


def _erc1155(logs: DataFrame, signature: str) -> DataFrame:
    return _of(logs, signature, 4).select(
        "tx_hash", "block_timestamp", "log_index", F.col("address").alias("token_address"), address(F.col("topics")[1]).alias("operator"),
        address(F.col("topics")[2]).alias("from_address"), address(F.col("topics")[3]).alias("to_address"), "data")


def erc1155_single(logs: DataFrame) -> DataFrame:
    return _erc1155(logs, TRANSFER_SINGLE).select(
        "*", big_number(_word(0)).alias("token_id"), small_number(_word(1)).alias("value_raw")).drop("data")


def erc1155_batch_items(logs: DataFrame) -> DataFrame:
    """One row per (id, value) of a batch transfer; both arrays sit at byte offsets inside the data."""
    offset = lambda i: (as_long(_word(i)) / 32).cast("int")
    rows = _erc1155(logs, TRANSFER_BATCH).withColumns({"_ids": offset(0), "_values": offset(1)}).withColumn(
        "_n", as_long(word_at(F.col("data"), F.col("_ids"))).cast("int"))
    index = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    items = rows.select("*", F.explode(index).alias("item"))
    at = lambda base: word_at(F.col("data"), F.col(base) + 1 + F.col("item"))
    return items.select(
        "tx_hash", "block_timestamp", "log_index", "token_address", "operator", "from_address", "to_address", "item",
        big_number(at("_ids")).alias("token_id"), small_number(at("_values")).alias("value_raw"))


def ctf_transfers(single: DataFrame, batch_items: DataFrame, contract: str = CONDITIONAL_TOKENS) -> DataFrame:
    """Single and batch transfers of outcome tokens in one table."""
    cols = ["tx_hash", "block_timestamp", "operator", "from_address", "to_address", "token_id", "value_raw"]
    both = single.filter(F.col("token_address") == contract).select(*cols).unionByName(
        batch_items.filter(F.col("token_address") == contract).select(*cols))
    return both.withColumn("shares_amount", F.col("value_raw").cast("double") / F.lit(1e6))


def tx_cash_reconcile(trades: DataFrame, usdc: DataFrame) -> DataFrame:
    """Cash expected from the trades of a transaction against what moved on chain."""
    cost = F.col("price") * F.col("size")
    keys = ["username", "proxy_address", "tx_hash"]
    expected = trades.filter(F.col("transaction_hash").isNotNull() & (F.col("transaction_hash") != "")).withColumnRenamed(
        "transaction_hash", "tx_hash").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), sum_if(cost, F.col("side") == "BUY").alias("expected_out"), sum_if(cost, F.col("side") == "SELL").alias("expected_in"))
    me = F.lower("proxy_address")
    flows = expected.select(*keys).join(usdc.select("tx_hash", "from_address", "to_address", "amount_usdc"), "tx_hash").groupBy(*keys).agg(
        sum_if("amount_usdc", F.col("from_address") == me).alias("actual_out"), sum_if("amount_usdc", F.col("to_address") == me).alias("actual_in"))
    out = expected.join(flows, keys, "left").fillna({"actual_out": 0.0, "actual_in": 0.0})
    return out.select(*keys, "trade_count", *[rnd(c).alias(n) for n, c in {
        "expected_usdc_out": F.col("expected_out"), "expected_usdc_in": F.col("expected_in"), "expected_usdc_net": F.col("expected_in") - F.col("expected_out"),
        "actual_usdc_out": F.col("actual_out"), "actual_usdc_in": F.col("actual_in"), "actual_usdc_net": F.col("actual_in") - F.col("actual_out"),
        "usdc_out_diff": F.col("actual_out") - F.col("expected_out"), "usdc_in_diff": F.col("actual_in") - F.col("expected_in")}.items()])


def onchain_pair(trades: DataFrame, matched: DataFrame, transfers: DataFrame, filled: DataFrame, markets: DataFrame,
                 exchange: str = EXCHANGE) -> DataFrame:
    """The match of each trade on chain and the opposite leg minted with it.

    Among the outcome tokens the exchange sent to others in the same transaction, the leg with the
    closest share count is the pair; its cash comes from the closest fill of that token.
    """
    t = trades.filter(F.col("transaction_hash").isNotNull()).select(
        "event_key", "username", "market_slug", F.lower("proxy_address").alias("user_address"), "token_id", "price", "side",
        F.col("transaction_hash").alias("tx_hash"))
    m = matched.select("tx_hash", "user_address", "token_id", F.col("usdc_amount").alias("onchain_usdc"), F.col("shares_amount").alias("onchain_shares"))
    hits = t.join(m, ["tx_hash", "user_address", "token_id"]).join(
        markets.select(F.col("slug").alias("market_slug"), "token_ids"), "market_slug", "left")
    legs = transfers.filter((F.col("from_address") == exchange) & (F.col("to_address") != exchange) & (F.col("shares_amount") > 0)).select(
        "tx_hash", F.col("to_address").alias("leg_to"), F.col("token_id").alias("leg_token"), F.col("shares_amount").alias("leg_shares"))
    ok = (F.col("leg_to") != F.col("user_address")) & (F.col("leg_token") != F.col("token_id")) & (
        F.coalesce(F.size("token_ids"), F.lit(0)).isin(0, -1) | F.array_contains("token_ids", F.col("leg_token")))
    leg = F.struct("leg_token", "leg_shares", "leg_to")
    far = F.struct(F.round(F.abs(F.col("leg_shares") - F.col("onchain_shares")), 9).alias("d"), leg)
    keys = ["event_key", "username", "market_slug", "tx_hash", "token_id", "price", "side", "onchain_usdc", "onchain_shares"]
    paired = hits.join(legs, "tx_hash", "left").groupBy(*keys).agg(F.min_by(leg, F.when(ok, far)).alias("_leg")).select(
        *keys, F.col("_leg.leg_token").alias("pair_token_id"), F.col("_leg.leg_shares").alias("pair_shares"),
        F.col("_leg.leg_to").alias("pair_counterparty"))
    f = filled.filter("shares_amount > 0").select(
        "tx_hash", F.col("token_id").alias("pair_token_id"), F.col("usdc_amount").alias("f_usdc"), F.col("shares_amount").alias("f_shares"))
    keys2 = [*keys, "pair_token_id", "pair_shares", "pair_counterparty"]
    gap = F.when(F.col("f_shares").isNotNull(), F.struct(F.round(F.abs(F.col("f_shares") - F.col("pair_shares")), 9).alias("d"), F.col("f_usdc")))
    out = paired.join(f, ["tx_hash", "pair_token_id"], "left").groupBy(*keys2).agg(F.min_by("f_usdc", gap).alias("pair_usdc"))
    price = F.round(div("onchain_usdc", "onchain_shares"), 6)
    pair_price = F.round(div("pair_usdc", "pair_shares"), 6)
    return out.withColumns({"onchain_price": price, "pair_price": pair_price}).withColumns({
        "onchain_minus_trade_price": F.round(F.col("onchain_price") - F.col("price"), 6),
        "price_sum": F.round(F.col("onchain_price") + F.col("pair_price"), 6)})


def onchain_match_report(pairs: DataFrame, enriched: DataFrame) -> DataFrame:
    """PnL of matched trades by whether they look like a complete-set mint."""
    joined = pairs.select("event_key", F.col("pair_token_id").isNotNull().alias("complete_set_like")).join(
        enriched.filter("settle_price IS NOT NULL").select("event_key", "realized_pnl"), "event_key")
    n = F.count(F.lit(1))
    return joined.groupBy("complete_set_like").agg(
        n.alias("trades"), F.sum("realized_pnl").alias("pnl"), F.avg("realized_pnl").alias("avg_pnl"),
        (F.count(F.when(F.col("realized_pnl") > 0, 1)) * 100.0 / n).alias("win_rate_pct"))


def top_counterparties(pairs: DataFrame, limit: int = 10) -> DataFrame:
    return pairs.filter("pair_counterparty IS NOT NULL").groupBy("pair_counterparty").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "pair_counterparty").limit(limit)
