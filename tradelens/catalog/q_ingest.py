"""Envelope and projection queries: payloads are written as JSON by Spark and read back typed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.q_reports import rounded
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables, as_of
from tradelens.functions import books
from tradelens.functions.numeric import rnd
from tradelens.operators.latest import latest_per_key
from tradelens.plans import markets, quality
from tradelens.sources import sinks
from tradelens.sources.envelopes import envelope_normalize
from tradelens.sources.projections import project


def messages(t: Tables):
    """Broker rows of the events table: some without a timestamp, source or type."""
    e = t.read("events")
    eid = F.col("event_id")
    stamp = F.when(eid % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        eid % 3 == 1, F.unix_seconds("ts").cast("string")).otherwise("not a time")
    body = F.to_json(F.struct(
        stamp.alias("ts"), F.when(eid % 5 != 0, F.concat(F.lit("feed-"), (eid % 4).cast("string"))).alias("source"),
        F.when(eid % 7 != 0, F.col("event_type")).alias("type"), F.col("value").alias("v")))
    return e.select(
        F.concat(F.lit("k"), eid.cast("string")).alias("key"), body.alias("value"), F.lit("events").alias("topic"),
        (eid % 8).cast("int").alias("partition"), eid.alias("offset"), F.col("ts").alias("timestamp"))


@query("envelope_normalize", """SELECT 'k' || event_id AS kafka_key,
  CASE WHEN event_id % 3 < 2 THEN make_timestamp(CAST(floor(epoch_us(ts)/1000000) AS BIGINT)*1000000) ELSE ts END AS ts,
  CASE WHEN event_id % 5 <> 0 THEN 'feed-' || (event_id % 4) ELSE 'unknown' END AS source,
  CASE WHEN event_id % 7 <> 0 THEN event_type ELSE 'unknown' END AS type, '{}' AS data, event_id AS kafka_offset, CAST(event_id % 8 AS INTEGER) AS kafka_partition FROM events""")
def envelope(t: Tables):
    return envelope_normalize(messages(t)).select("kafka_key", "ts", "source", "type", "data", "kafka_offset", "kafka_partition")


@query("recent_events", """SELECT event_id AS kafka_offset, ts, event_type AS type FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_events(t: Tables):
    e = t.read("events").select("ts", F.col("event_type").alias("type"), F.col("event_id").alias("kafka_offset"))
    return sinks.recent_events(e, 100, "purchase").select("kafka_offset", "ts", "type")


def wrap(df, kind: str, payload, key="event_key", source: str = "feed"):
    """Envelopes around a JSON payload built from table columns."""
    return df.select(
        F.col("ts"), F.lit(source).alias("source"), F.lit(kind).alias("type"), F.to_json(payload).alias("data"),
        F.col(key).alias("kafka_key"), F.lit(0).alias("kafka_partition"), F.col("l_orderkey").alias("kafka_offset"),
        F.col("ts").alias("kafka_timestamp"))


def trade_payload():
    return F.struct(
        F.col("slug").alias("slug"), F.lit("t").alias("title"), F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("asset"),
        F.concat(F.lit("c-"), F.col("slug")).alias("conditionId"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("outcome").alias("outcome"), F.when(F.col("outcome") == "Up", 0).otherwise(1).alias("outcomeIndex"),
        F.col("price").alias("price"), F.col("l_quantity").cast("string").alias("size"), F.concat(F.lit("0xT"), F.col("l_orderkey").cast("string")).alias("transactionHash"))


_TRADE = """slug || ':' || outcome AS token_id, 'c-' || slug AS condition_id, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, outcome,
  CASE WHEN outcome = 'Up' THEN 0 ELSE 1 END AS outcome_index, price, l_quantity AS size, '0xT' || l_orderkey AS transaction_hash"""
_TRADE_COLS = ["token_id", "condition_id", "side", "outcome", "outcome_index", "price", "size", "transaction_hash"]


@query("project_user_trades", f"SELECT ts, event_key, 'u' || l_suppkey AS username, slug AS market_slug, {_TRADE}, l_orderkey AS kafka_offset FROM v_lines")
def project_user_trades(t: Tables):
    payload = F.struct(F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("username"), trade_payload().alias("trade"))
    other = wrap(t.lines(), "venue.other", payload)
    out = project(wrap(t.lines(), "venue.user.trade", payload).unionByName(other), "user_trades")
    return out.select("ts", "event_key", "username", "market_slug", *_TRADE_COLS, "kafka_offset")


@query("project_market_trades", f"SELECT event_key, CASE WHEN l_linenumber % 2 = 0 THEN ts + to_seconds(5) ELSE ts END AS captured_at, slug AS market_slug, {_TRADE}, 'w' || l_suppkey AS proxy_wallet FROM v_lines")
def project_market_trades(t: Tables):
    stamp = F.when(F.col("l_linenumber") % 2 == 0, F.date_format(F.col("ts") + F.expr("INTERVAL 5 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    trade = trade_payload().withField("proxyWallet", F.concat(F.lit("w"), F.col("l_suppkey").cast("string")))
    out = project(wrap(t.lines(), "venue.market.trade", F.struct(stamp.alias("capturedAt"), F.col("slug").alias("marketSlug"), trade.alias("trade"))), "market_trades")
    return out.select("event_key", "captured_at", "market_slug", *_TRADE_COLS, "proxy_wallet")


@query("project_clob_tob", """SELECT event_key, 'k' || l_orderkey AS trade_key, price AS best_bid_price, l_quantity AS best_bid_size, round(price + 0.02, 2) AS best_ask_price,
  l_suppkey AS book_timestamp_ms, l_suppkey % 2 = 0 AS cached, CAST(2 AS INTEGER) AS n_bid_levels, round(price - 0.01, 2) AS second_bid_price, l_quantity*2 AS second_bid_size,
  l_discount AS book_imbalance FROM v_lines""")
def project_clob_tob(t: Tables):
    text = lambda c: F.round(c, 2).cast("string")
    lvl = lambda p, s: F.struct(text(p).alias("price"), s.cast("string").alias("size"))
    price, qty = F.col("price"), F.col("l_quantity")
    payload = F.struct(
        F.struct(F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("tradeKey")).alias("trigger"),
        F.struct(lvl(price, qty).alias("bestBid"), lvl(price + 0.02, qty).alias("bestAsk"), F.col("l_suppkey").alias("timestamp"),
                 F.array(lvl(price, qty), lvl(price - 0.01, qty * 2)).alias("bidLevels"), F.col("l_discount").alias("bookImbalance")).alias("book"),
        (F.col("l_suppkey") % 2 == 0).alias("cached"))
    out = project(wrap(t.lines(), "venue.clob.tob", payload), "clob_tob")
    return out.select("event_key", "trade_key", "best_bid_price", "best_bid_size", "best_ask_price", "book_timestamp_ms", "cached",
                      F.size("bid_levels").alias("n_bid_levels"), F.col("bid_levels")[1]["price"].alias("second_bid_price"),
                      F.col("bid_levels")[1]["size"].alias("second_bid_size"), "book_imbalance")


@query("project_gamma_markets", """SELECT event_key, slug, 'm' || l_partkey AS market_id, l_shipdate AS end_date, l_suppkey % 2 = 0 AS active, FALSE AS closed,
  'Yes|No' AS outcomes, price AS first_price, round(1 - price, 2) AS second_price, slug || ':Up|' || slug || ':Down' AS token_ids, l_extendedprice AS volume_num FROM v_lines""")
def project_gamma_markets(t: Tables):
    quoted = lambda *cs: F.to_json(F.array(*cs))
    as_text = lambda c: F.round(c, 2).cast("string")
    tokens = F.array(F.concat("slug", F.lit(":Up")), F.concat("slug", F.lit(":Down")))
    market = lambda tok: F.struct(
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("endDate"),
        (F.col("l_suppkey") % 2 == 0).alias("active"), quoted(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        quoted(as_text(F.col("price")), as_text(1 - F.col("price"))).alias("outcomePrices"), tok.alias("clobTokenIds"),
        F.col("l_extendedprice").cast("string").alias("volumeNum"))
    li = t.lines()
    # token ids arrive as an array in half of the payloads and as JSON text in the other half
    plain = wrap(li.filter("l_suppkey % 2 = 0"), "venue.gamma.market", F.struct(F.col("slug"), market(tokens).alias("market")))
    nested = wrap(li.filter("l_suppkey % 2 <> 0"), "venue.gamma.market", F.struct(F.col("slug"), market(F.to_json(tokens)).alias("market")))
    out = project(plain.unionByName(nested), "gamma_markets")
    return out.select("event_key", "slug", "market_id", "end_date", "active", "closed", F.array_join("outcomes", "|").alias("outcomes"),
                      F.col("outcome_prices")[0].alias("first_price"), F.col("outcome_prices")[1].alias("second_price"),
                      F.array_join("token_ids", "|").alias("token_ids"), "volume_num")


def receipts_raw(t: Tables):
    o = t.read("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice",
                                "o_orderstatus", F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("event_key"))
    payload = F.struct(
        F.lit(137).alias("chainId"), F.concat(F.lit("0xT"), F.col("l_orderkey").cast("string")).alias("txHash"), F.col("l_orderkey").alias("blockNumber"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("status"), F.concat(F.lit("0xA"), (F.col("o_custkey") % 200).cast("string")).alias("from"),
        F.col("o_custkey").alias("gasUsed"), F.col("l_orderkey").cast("string").alias("effectiveGasPrice"),
        F.struct(F.array(F.struct(F.lit("0xC").alias("address"))).alias("logs")).alias("receipt"))
    return project(wrap(o, "chain.tx.receipt", payload), "tx_receipts")


_RECEIPTS = """SELECT '0xT' || o_orderkey AS tx_hash, CAST(137 AS BIGINT) AS chain_id, o_orderkey AS block_number, o_orderdate AS block_timestamp,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS status, '0xA' || (o_custkey % 200) AS from_address, o_custkey AS gas_used,
  o_orderkey AS effective_gas_price, '{"logs":[{"address":"0xC"}]}' AS receipt_json FROM orders"""
_RECEIPT_COLS = ["tx_hash", "chain_id", "block_number", "block_timestamp", "status", "from_address", "gas_used", "effective_gas_price", "receipt_json"]


@query("project_tx_receipts", _RECEIPTS)
def project_tx_receipts(t: Tables):
    return receipts_raw(t).select(*_RECEIPT_COLS)


@query("tx_receipts_latest", _RECEIPTS)
def tx_receipts_latest(t: Tables):
    again = receipts_raw(t).withColumns({"kafka_offset": F.col("kafka_offset") - 1, "gas_used": F.lit(0).cast("bigint")})
    both = receipts_raw(t).unionByName(again)
    return latest_per_key(both, ["tx_hash"], ["kafka_offset"]).select(*_RECEIPT_COLS)


@query("project_ws_tob", """SELECT event_key, slug AS asset_id, CASE WHEN l_linenumber % 2 = 0 THEN ts + to_milliseconds(250) ELSE ts END AS captured_at, price AS best_bid_price,
  l_quantity AS best_bid_size, l_tax AS last_trade_price FROM v_lines""")
def project_ws_tob(t: Tables):
    stamp = F.when(F.col("l_linenumber") % 2 == 0, (F.unix_millis("ts") + 250).cast("string"))
    payload = F.struct(F.col("slug").alias("assetId"), stamp.alias("updatedAt"), F.col("price").alias("bestBid"), F.col("l_quantity").alias("bestBidSize"),
                       F.col("l_tax").alias("lastTradePrice"))
    return project(wrap(t.lines(), "market_ws.tob", payload), "ws_tob").select(
        "event_key", "asset_id", "captured_at", "best_bid_price", "best_bid_size", "last_trade_price")


@query("project_ws_trades", """SELECT event_key, slug AS asset_id, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, price, l_quantity AS size, l_suppkey AS fee_rate_bps FROM v_lines""")
def project_ws_trades(t: Tables):
    payload = F.struct(F.col("slug").alias("assetId"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("Buy").alias("side"), F.col("price").alias("price"),
                       F.col("l_quantity").alias("size"), F.col("l_suppkey").cast("string").alias("feeRateBps"))
    return project(wrap(t.lines(), "market_ws.trade", payload), "ws_trades").select("event_key", "asset_id", "side", "price", "size", "fee_rate_bps")


@query("project_order_events", """SELECT event_key, 'limit' AS kind, 'o' || l_orderkey AS order_id, nullif(l_discount, 0) AS price, l_quantity AS size, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 2 = 0 END AS neg_risk,
  l_suppkey % 2 = 0 AS success, CASE WHEN l_suppkey % 2 = 1 THEN 'http' END AS error_type FROM v_lines WHERE l_linenumber % 4 = 0
UNION ALL SELECT event_key, 'market', 'o' || l_orderkey, nullif(l_discount, 0), l_quantity, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 2 = 0 END, l_suppkey % 2 = 0, CASE WHEN l_suppkey % 2 = 1 THEN 'http' END FROM v_lines WHERE l_linenumber % 4 = 1
UNION ALL SELECT event_key, 'cancel', 'o' || l_orderkey, NULL, NULL, NULL, l_suppkey % 2 = 0, CASE WHEN l_suppkey % 2 = 1 THEN 'http' END FROM v_lines WHERE l_linenumber % 4 = 2
UNION ALL SELECT event_key, 'strategy', 'o' || l_orderkey, nullif(l_discount, 0), l_quantity, NULL, l_suppkey % 2 = 0, NULL FROM v_lines WHERE l_linenumber % 4 = 3""")
def project_order_events(t: Tables):
    odd = F.col("l_suppkey") % 2 == 1
    payload = F.struct(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("orderId"), F.col("l_discount").alias("price"), F.col("l_quantity").alias("size"),
        F.col("l_quantity").alias("amount"), F.when(F.col("l_suppkey") % 3 == 0, ~odd).alias("negRisk"), (~odd).alias("success"),
        F.when(odd, F.struct(F.lit("http").alias("type"))).alias("error"))
    li = t.lines()
    parts = [("order.limit", 0), ("order.market", 1), ("order.cancel", 2)]
    events = wrap(li.filter("l_linenumber % 4 = 3"), "strategy.x.order", payload)
    for kind, r in parts:
        events = events.unionByName(wrap(li.filter(f"l_linenumber % 4 = {r}"), f"executor.{kind}", payload))
    null = lambda kind: F.lit(None).cast(kind)
    cols = lambda df, kind, price, size, risk, err: df.select(
        "event_key", F.lit(kind).alias("kind"), "order_id", price.alias("price"), size.alias("size"), risk.alias("neg_risk"), "success", err.alias("error_type"))
    c = F.col
    return (
        cols(project(events, "limit_orders"), "limit", c("price"), c("size"), c("neg_risk"), c("error_type"))
        .unionByName(cols(project(events, "market_orders"), "market", c("price"), c("amount"), c("neg_risk"), c("error_type")))
        .unionByName(cols(project(events, "cancel_orders"), "cancel", null("double"), null("double"), null("boolean"), c("error_type")))
        .unionByName(cols(project(events, "strategy_orders"), "strategy", c("price"), c("size"), null("boolean"), null("string"))))


@query("project_order_status", """SELECT event_key, 'o' || l_orderkey AS order_id, nullif(l_discount, 0) AS requested_price, l_quantity AS requested_size, nullif(l_tax, 0) AS matched_size,
  l_linestatus AS exchange_status FROM v_lines""")
def project_order_status(t: Tables):
    payload = F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("orderId"), F.col("l_discount").alias("requestedPrice"),
                       F.col("l_quantity").alias("requestedSize"), F.col("l_tax").alias("matchedSize"), F.col("l_linestatus").alias("exchangeStatus"))
    return project(wrap(t.lines(), "executor.order.status", payload), "order_status").select(
        "event_key", "order_id", "requested_price", "requested_size", "matched_size", "exchange_status")


_GLOBAL = """SELECT event_key AS trade_id, 'w' || l_suppkey AS proxy_address, slug AS market_slug, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  CASE WHEN outcome = 'Up' THEN 0 ELSE 1 END AS outcome_index, price, l_quantity AS size, r6(price*l_quantity) AS notional, l_orderkey*1000 + l_suppkey AS kafka_offset FROM v_lines"""


def global_trades(t: Tables):
    payload = F.struct(
        F.col("event_key").alias("id"), F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("proxyWallet"), F.col("slug"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.when(F.col("outcome") == "Up", "0").otherwise("1").alias("outcomeIndex"),
        F.col("price"), F.col("l_quantity").alias("size"))
    li = t.lines()
    events = wrap(li, "g.global.trade", payload, source="wide-feed").unionByName(wrap(li, "g.global.trade", payload, source="other"))
    stamped = events.withColumn("kafka_offset", F.col("kafka_offset") * 1000 + F.substring(F.get_json_object("data", "$.proxyWallet"), 2, 9).cast("bigint"))
    return project(stamped, "global_trades", source="wide-feed").select(
        "trade_id", "proxy_address", "market_slug", "side", "outcome_index", "price", "size", rnd("notional").alias("notional"), "kafka_offset")


@query("project_global_trades", _GLOBAL)
def project_global_trades(t: Tables):
    return global_trades(t)


@query("global_trades_dedup", f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY kafka_offset DESC, proxy_address DESC, market_slug DESC, side DESC,
  outcome_index DESC, price DESC, size DESC) AS rn FROM ({_GLOBAL})) WHERE rn = 1""")
def global_trades_dedup(t: Tables):
    return latest_per_key(global_trades(t), ["trade_id"], ["kafka_offset"])


# ---- books, markets, retention, labels -------------------------------------------------------


@query("book_depth_metrics", """WITH b AS (SELECT *, coalesce(best_bid_price, 0) AS bid, CASE WHEN best_bid_price > 0 THEN best_bid_size ELSE 0 END AS bid1,
    CASE WHEN round(best_bid_price - 0.01, 2) > 0 THEN best_bid_size*2 ELSE 0 END AS bid2, (best_bid_price + best_ask_price)/2 AS mid0 FROM v_tob)
SELECT trade_key, token_id, captured_at, r6(bid1 + bid2) AS total_bid_volume, r6(best_ask_size*3) AS total_ask_volume, r6((bid1 + bid2 - best_ask_size*3)/(bid1 + bid2 + best_ask_size*3)) AS book_imbalance,
  r6(CASE WHEN mid0 > 0 THEN CASE WHEN bid >= mid0*0.99 THEN bid1 ELSE 0 END + CASE WHEN round(bid - 0.01, 2) >= mid0*0.99 THEN bid2 ELSE 0 END
    + CASE WHEN best_ask_price <= mid0*1.01 THEN best_ask_size ELSE 0 END + CASE WHEN round(best_ask_price + 0.01, 2) <= mid0*1.01 THEN best_ask_size*2 ELSE 0 END END) AS depth_near_mid FROM b""")
def book_depth_metrics(t: Tables):
    return rounded(t.tob().select("trade_key", "token_id", "captured_at", *[
        c.alias(n) for n, c in books.book_metrics("bid_levels", "ask_levels").items()]))


@query("resolution_extract", """SELECT condition_id, NOT active AS is_resolved, CASE WHEN active THEN '' WHEN outcome_prices[1] >= 0.99 THEN 'Up' WHEN outcome_prices[2] >= 0.99 THEN 'Down' ELSE '' END AS winning_outcome,
  CAST(CASE WHEN active THEN -1 WHEN outcome_prices[1] >= 0.99 THEN 0 WHEN outcome_prices[2] >= 0.99 THEN 1 ELSE -1 END AS INTEGER) AS winning_outcome_index, end_date AS end_time FROM v_markets""")
def resolution_extract(t: Tables):
    return markets.resolution_extract(t.markets(), ~F.col("active")).select(
        "condition_id", "is_resolved", "winning_outcome", "winning_outcome_index", "end_time")


@query("token_price_lookup", """SELECT asset_id AS token_id, CASE WHEN best_bid_price > 0 AND best_ask_price > 0 THEN r6((best_bid_price + best_ask_price)/2) ELSE last_trade_price END AS price
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS rn FROM v_ws_unique) WHERE rn = 1 AND asset_id IN (SELECT token_id FROM v_trades)""")
def token_price_lookup(t: Tables):
    return rounded(markets.token_prices(t.ws_tob(), t.trades().select("token_id").distinct()))


@query("ttl_expiry", "SELECT event_key, ts FROM v_trades WHERE ts >= TIMESTAMP '2001-11-10' - INTERVAL 90 DAY")
def ttl_expiry(t: Tables):
    return sinks.unexpired(t.trades().select("event_key", "ts"), "ts", as_of(), 90)


def labels(t: Tables):
    kind = F.when(F.col("version") % 4 == 0, "cluster").when(F.col("version") % 4 == 1, "regime").when(F.col("version") % 4 == 2, "complete_set").otherwise("signal")
    return t.trades_raw().select(
        "username", "event_key", kind.alias("label_type"), F.concat(F.lit("v"), (F.col("version") % 5).cast("string")).alias("label_value"),
        F.col("price").alias("label_score"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("labeled_at"), F.concat(F.lit("m"), (F.col("version") % 3).cast("string")).alias("model_version"))


_LABELS = """lab AS (SELECT username, event_key, CASE version % 4 WHEN 0 THEN 'cluster' WHEN 1 THEN 'regime' WHEN 2 THEN 'complete_set' ELSE 'signal' END AS label_type,
  'v' || (version % 5) AS label_value, price AS label_score, ts + INTERVAL 1 DAY AS labeled_at, 'm' || (version % 3) AS model_version FROM v_trades_raw),
lw AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY username, event_key, label_type ORDER BY labeled_at DESC, label_value DESC, label_score DESC, model_version DESC) AS rn FROM lab) WHERE rn = 1)"""


def stored_labels(t: Tables):
    all_labels = labels(t)
    return sinks.label_write(all_labels.filter("model_version != 'm0'"), all_labels.filter("model_version = 'm0'"))


@query("label_write", f"WITH {_LABELS} SELECT * FROM lw")
def label_write(t: Tables):
    return stored_labels(t)


@query("label_delete", f"WITH {_LABELS} SELECT username, event_key, label_type FROM lw WHERE (username, label_type) NOT IN (SELECT username, 'cluster' FROM v_scores WHERE total_score >= 60)")
def label_delete(t: Tables):
    doomed = t.scores().filter("total_score >= 60").select("username", F.lit("cluster").alias("label_type"))
    return sinks.label_delete(stored_labels(t), doomed).select("username", "event_key", "label_type")


@query("labels_summary", f"""WITH {_LABELS} SELECT username, label_type, count(*) AS label_count, count(DISTINCT label_value) AS unique_values, min(labeled_at) AS first_labeled_at,
  max(labeled_at) AS last_labeled_at, arg_max(model_version, (labeled_at, model_version)) AS latest_model_version FROM lw GROUP BY ALL""")
def labels_summary(t: Tables):
    from tradelens.plans import reports
    return reports.labels_summary(stored_labels(t))


@query("label_pivot_join", f"""WITH {_LABELS} SELECT t.event_key, a.label_value AS cluster_label, r6(a.label_score) AS cluster_score, b.label_value AS research_regime,
  c.label_value AS complete_set_flag, r6(c.label_score) AS complete_set_edge FROM v_trades t LEFT JOIN lw a ON a.event_key = t.event_key AND a.label_type = 'cluster'
LEFT JOIN lw b ON b.event_key = t.event_key AND b.label_type = 'regime' LEFT JOIN lw c ON c.event_key = t.event_key AND c.label_type = 'complete_set'""")
def label_pivot_join(t: Tables):
    from tradelens.plans import enrich
    return rounded(enrich.label_pivot_join(t.trades(), stored_labels(t)).select(
        "event_key", "cluster_label", "cluster_score", "research_regime", "complete_set_flag", "complete_set_edge"))


@query("market_exclusion_filter", """SELECT DISTINCT market_slug FROM v_trades WHERE market_slug NOT LIKE '%updown%'""")
def market_exclusion_filter(t: Tables):
    return t.trades().filter(quality.not_price_market("market_slug")).select("market_slug").distinct()
