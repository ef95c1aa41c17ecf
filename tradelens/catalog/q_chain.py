"""Receipt decoding and on-chain pairing. Receipts with hex logs are built by Spark from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.q_reports import rounded
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables
from tradelens.plans import enrich, onchain


def word(number) -> F.Column:
    """A number as a 64-digit hex word."""
    return F.lower(F.lpad(F.hex(number.cast("bigint")), 64, "0"))


def topic(number) -> F.Column:
    return F.concat(F.lit("0x"), word(number))


def receipts(t: Tables):
    """One receipt per order with one log per line; the line number picks the kind of log."""
    n, sk, pk, qty = (F.col(c) for c in ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity"))
    micro = (qty * 1_000_000).cast("bigint")
    sig = (
        F.when(n == 1, onchain.ERC20_TRANSFER).when(n == 2, onchain.ORDER_FILLED).when(n == 3, onchain.ORDERS_MATCHED)
        .when(n == 4, onchain.TRANSFER_SINGLE).when(n == 5, onchain.TRANSFER_BATCH).otherwise(topic(n)))
    emitter = F.when(n == 1, F.when(sk % 2 == 0, onchain.USDC).otherwise("0xabc")).when(n.isin(2, 3), onchain.EXCHANGE).otherwise(onchain.CONDITIONAL_TOKENS)
    data = F.concat(F.lit("0x"), F.when(n == 1, word(micro)).when(n.isin(2, 3), F.concat(word(F.lit(0)), F.lit("f" * 48), F.right(word(pk), F.lit(16)), word(micro / 2), word(micro), word(F.lit(1))))
                    .when(n == 4, F.concat(word(pk), word(micro))).otherwise(
        F.concat(word(F.lit(64)), word(F.lit(160)), word(F.lit(2)), word(pk), word(pk + 1), word(F.lit(2)), word(micro), word(micro * 2))))
    log = F.struct(F.upper(emitter).alias("address"), F.array(F.upper(sig), topic(sk), topic(sk + 1), topic(sk + 2)).alias("topics"), data.alias("data"))
    lines = t.lines().withColumn("log", log)
    # an order has a handful of lines, so the list is short
    return lines.groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("block_timestamp"), F.to_json(F.struct(F.array_sort(F.collect_list("log")).alias("logs"))).alias("receipt_json")).select(
        F.concat(F.lit("0xT"), F.col("l_orderkey").cast("string")).alias("tx_hash"), "block_timestamp", "receipt_json")


def logs(t: Tables):
    return onchain.receipt_logs(receipts(t)).withColumn("address", F.lower("address"))


_ADDR = lambda e: f"'0x' || right(lpad(lower(hex({e})), 64, '0'), 40)"
_TX = "'0xT' || l_orderkey AS tx_hash"


@query("receipt_logs_explode", "SELECT '0xT' || l_orderkey AS tx_hash, count(*) AS logs, count(DISTINCT l_linenumber) AS kinds FROM v_lines GROUP BY 1")
def receipt_logs_explode(t: Tables):
    sig = F.lower(F.col("topics")[0])
    return logs(t).groupBy("tx_hash").agg(F.count(F.lit(1)).alias("logs"), F.count_distinct(sig).alias("kinds"))


@query("erc20_transfers", f"""SELECT {_TX}, CASE WHEN l_suppkey % 2 = 0 THEN '0x2791bca1f2de4661ed88a30c99a7a9449aa84174' ELSE '0xabc' END AS token_address, {_ADDR('l_suppkey')} AS from_address,
  {_ADDR('l_suppkey + 1')} AS to_address, CAST(l_quantity*1000000 AS BIGINT) AS amount_raw FROM v_lines WHERE l_linenumber = 1""")
def erc20_transfers(t: Tables):
    return onchain.erc20_transfers(logs(t)).select("tx_hash", "token_address", "from_address", "to_address", F.col("amount_raw").cast("bigint").alias("amount_raw"))


@query("usdc_transfers", f"SELECT {_TX}, {_ADDR('l_suppkey')} AS from_address, l_quantity AS amount_usdc FROM v_lines WHERE l_linenumber = 1 AND l_suppkey % 2 = 0")
def usdc_transfers(t: Tables):
    return onchain.usdc_transfers(onchain.erc20_transfers(logs(t))).select("tx_hash", "from_address", "amount_usdc")


@query("order_filled", f"""SELECT {_TX}, '0x' || lpad(lower(hex(l_suppkey)), 64, '0') AS order_hash, {_ADDR('l_suppkey + 1')} AS addr1, {_ADDR('l_suppkey + 2')} AS addr2,
  r6(floor(l_quantity*500000)/1000000) AS usdc_amount, r6(l_quantity) AS shares_amount FROM v_lines WHERE l_linenumber = 2""")
def order_filled(t: Tables):
    return rounded(onchain.order_filled(logs(t)).select("tx_hash", "order_hash", "addr1", "addr2", "usdc_amount", "shares_amount"))


@query("orders_matched", f"""SELECT {_TX}, '0x' || lpad(lower(hex(l_suppkey)), 64, '0') AS match_id, {_ADDR('l_suppkey + 1')} AS user_address, r6(floor(l_quantity*500000)/1000000) AS usdc_amount,
  r6(l_quantity) AS shares_amount FROM v_lines WHERE l_linenumber = 3""")
def orders_matched(t: Tables):
    return rounded(onchain.orders_matched(logs(t)).select("tx_hash", "match_id", "user_address", "usdc_amount", "shares_amount"))


# 2^256 - 2^64: the top 192 bits of the ids are set in the built logs.
HIGH_BITS = str((1 << 256) - (1 << 64))


@query("hex_word_decode", f"""SELECT {_TX}, length('{HIGH_BITS}') AS digits, '{HIGH_BITS[:50]}' AS leading_digits,
  right(CAST({HIGH_BITS[-15:]} + l_partkey AS VARCHAR), 12) AS trailing_digits FROM v_lines WHERE l_linenumber IN (2, 3)""")
def hex_word_decode(t: Tables):
    ids = onchain.order_filled(logs(t)).select("tx_hash", "token_id").unionByName(onchain.orders_matched(logs(t)).select("tx_hash", "token_id"))
    return ids.select("tx_hash", F.length("token_id").cast("bigint").alias("digits"), F.substring("token_id", 1, 50).alias("leading_digits"),
                      F.right("token_id", F.lit(12)).alias("trailing_digits"))


@query("erc1155_single", f"""SELECT {_TX}, {_ADDR('l_suppkey')} AS operator, {_ADDR('l_suppkey + 1')} AS from_address, {_ADDR('l_suppkey + 2')} AS to_address, CAST(l_partkey AS VARCHAR) AS token_id,
  CAST(l_quantity*1000000 AS BIGINT) AS value_raw FROM v_lines WHERE l_linenumber = 4""")
def erc1155_single(t: Tables):
    return onchain.erc1155_single(logs(t)).select("tx_hash", "operator", "from_address", "to_address", "token_id", F.col("value_raw").cast("bigint").alias("value_raw"))


_ITEMS = f"""SELECT {_TX}, CAST(i AS INTEGER) AS item, CAST(l_partkey + i AS VARCHAR) AS token_id, CAST(l_quantity*1000000 AS BIGINT)*(i + 1) AS value_raw FROM v_lines, (VALUES (0), (1)) v(i) WHERE l_linenumber = 5"""


@query("erc1155_batch_items", _ITEMS)
def erc1155_batch_items(t: Tables):
    return onchain.erc1155_batch_items(logs(t)).select("tx_hash", "item", "token_id", F.col("value_raw").cast("bigint").alias("value_raw"))


@query("erc1155_batch", f"""SELECT {_TX}, l_partkey || ',' || (l_partkey + 1) AS ids, count(*) AS copies FROM v_lines WHERE l_linenumber = 5 GROUP BY ALL""")
def erc1155_batch(t: Tables):
    items = onchain.erc1155_batch_items(logs(t)).groupBy("tx_hash", "log_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "token_id"))), lambda x: x["token_id"]), ",").alias("ids"))
    return items.groupBy("tx_hash", "ids").agg(F.count(F.lit(1)).alias("copies"))


@query("union_transfers", f"""SELECT tx_hash, token_id, r6(value_raw/1000000) AS shares_amount FROM (SELECT {_TX}, CAST(l_partkey AS VARCHAR) AS token_id, CAST(l_quantity*1000000 AS BIGINT) AS value_raw FROM v_lines WHERE l_linenumber = 4
  UNION ALL SELECT tx_hash, token_id, value_raw FROM ({_ITEMS}))""")
def union_transfers(t: Tables):
    l = logs(t)  # noqa: E741
    return rounded(onchain.ctf_transfers(onchain.erc1155_single(l), onchain.erc1155_batch_items(l)).select("tx_hash", "token_id", "shares_amount"))


# ---- pairing on tables that share the trades' ids ---------------------------------------------


def chain_tables(t: Tables):
    """Matches, transfers and fills of the trades' transactions."""
    x = t.trades().filter("transaction_hash IS NOT NULL").select(
        F.col("transaction_hash").alias("tx_hash"), F.lower("proxy_address").alias("user_address"), "token_id", "size", "price", "market_slug", "outcome", "version")
    other = F.concat("market_slug", F.lit(":"), F.when(F.col("outcome") == "Up", "Down").otherwise("Up"))
    v = F.col("version")
    matched = x.filter(v % 3 != 0).select("tx_hash", "user_address", "token_id", F.round(F.col("size") * (F.col("price") + 0.01), 6).alias("usdc_amount"), F.col("size").alias("shares_amount")).distinct()
    moved = x.filter(v % 2 == 0).select("tx_hash", F.lit(onchain.EXCHANGE).alias("from_address"), F.concat(F.lit("0xb"), (v % 7).cast("string")).alias("to_address"),
                                        other.alias("token_id"), (F.col("size") + v % 4).alias("shares_amount"))
    filled = moved.select("tx_hash", "token_id", F.round(F.col("shares_amount") * 0.4, 6).alias("usdc_amount"), "shares_amount")
    return matched, moved, filled


_CHAIN = """x AS (SELECT transaction_hash AS tx_hash, lower(proxy_address) AS user_address, token_id, size, price, market_slug, outcome, version FROM v_trades WHERE transaction_hash IS NOT NULL),
mt AS (SELECT DISTINCT tx_hash, user_address, token_id, round(size*(price + 0.01), 6) AS usdc, size AS shares FROM x WHERE version % 3 <> 0),
mv AS (SELECT tx_hash, '0xb' || (version % 7) AS to_address, market_slug || ':' || CASE outcome WHEN 'Up' THEN 'Down' ELSE 'Up' END AS token_id, size + version % 4 AS shares FROM x WHERE version % 2 = 0),
hit AS (SELECT t.event_key, t.username, t.market_slug, t.transaction_hash AS tx_hash, t.token_id, t.price, mt.usdc AS onchain_usdc, mt.shares AS onchain_shares, [t.market_slug || ':Up', t.market_slug || ':Down'] AS toks
  FROM v_trades t JOIN mt ON mt.tx_hash = t.transaction_hash AND mt.user_address = lower(t.proxy_address) AND mt.token_id = t.token_id),
lg AS (SELECT hit.*, mv.token_id AS pt, mv.shares AS ps, mv.to_address AS pc, row_number() OVER (PARTITION BY event_key, onchain_usdc, onchain_shares ORDER BY (mv.tx_hash IS NULL), round(abs(mv.shares - onchain_shares), 9), mv.token_id, mv.shares, mv.to_address) AS rn
  FROM hit LEFT JOIN mv ON mv.tx_hash = hit.tx_hash AND mv.token_id <> hit.token_id AND list_contains(toks, mv.token_id)),
pr AS (SELECT p.*, (SELECT min(round(f.shares*0.4, 6)) FROM mv f WHERE f.tx_hash = p.tx_hash AND f.token_id = p.pt AND round(abs(f.shares - p.ps), 9) = 0) AS pu FROM lg p WHERE rn = 1),
pairs AS (SELECT event_key, username, market_slug, token_id, onchain_usdc, onchain_shares, pt AS pair_token_id, ps AS pair_shares, pc AS pair_counterparty, pu AS pair_usdc, round(onchain_usdc/onchain_shares, 6) AS onchain_price, price,
  round(pu/ps, 6) AS pair_price FROM pr)"""


def pairs(t: Tables):
    matched, moved, filled = chain_tables(t)
    return onchain.onchain_pair(t.trades(), matched, moved, filled, t.markets())


@query("onchain_pair", f"""WITH {_CHAIN} SELECT event_key, r6(onchain_usdc) AS onchain_usdc, r6(onchain_shares) AS onchain_shares, r6(onchain_price) AS onchain_price, r6(round(onchain_price - price, 6)) AS onchain_minus_trade_price,
  pair_token_id, r6(pair_shares) AS pair_shares, pair_counterparty, r6(pair_usdc) AS pair_usdc, r6(pair_price) AS pair_price, r6(round(onchain_price + pair_price, 6)) AS price_sum FROM pairs""")
def onchain_pair(t: Tables):
    return rounded(pairs(t).select("event_key", "onchain_usdc", "onchain_shares", "onchain_price", "onchain_minus_trade_price", "pair_token_id", "pair_shares",
                                   "pair_counterparty", "pair_usdc", "pair_price", "price_sum"))


@query("onchain_match_report", f"""WITH {_CHAIN} SELECT pair_token_id IS NOT NULL AS complete_set_like, count(*) AS trades, r6(sum(realized_pnl)) AS pnl, r6(avg(realized_pnl)) AS avg_pnl, r6(count(*) FILTER (realized_pnl > 0)*100.0/count(*)) AS win_rate_pct
FROM pairs JOIN (SELECT event_key, realized_pnl, settle_price FROM v_enriched) USING (event_key) WHERE settle_price IS NOT NULL GROUP BY 1""")
def onchain_match_report(t: Tables):
    return rounded(onchain.onchain_match_report(pairs(t), t.enriched()))


@query("onchain_top_counterparties", f"WITH {_CHAIN} SELECT pair_counterparty, count(*) AS n FROM pairs WHERE pair_counterparty IS NOT NULL GROUP BY 1 ORDER BY n DESC, pair_counterparty LIMIT 10")
def onchain_top_counterparties(t: Tables):
    return onchain.top_counterparties(pairs(t))


@query("tx_cash_reconcile", """WITH e AS (SELECT username, proxy_address, transaction_hash AS tx_hash, count(*) AS trade_count, coalesce(sum(price*size) FILTER (side = 'BUY'), 0) AS eo, coalesce(sum(price*size) FILTER (side = 'SELL'), 0) AS ei
  FROM v_trades WHERE transaction_hash IS NOT NULL GROUP BY ALL),
u AS (SELECT transaction_hash AS tx_hash, CASE side WHEN 'BUY' THEN lower(proxy_address) ELSE '0xpool' END AS f, CASE side WHEN 'BUY' THEN '0xpool' ELSE lower(proxy_address) END AS g, round(price*size + 0.01*(version % 2), 6) AS amt FROM v_trades WHERE transaction_hash IS NOT NULL),
a AS (SELECT e.username, e.proxy_address, e.tx_hash, sum(CASE WHEN u.f = lower(e.proxy_address) THEN amt ELSE 0 END) AS ao, sum(CASE WHEN u.g = lower(e.proxy_address) THEN amt ELSE 0 END) AS ai FROM e JOIN u USING (tx_hash) GROUP BY ALL)
SELECT username, proxy_address, tx_hash, trade_count, r6(eo) AS expected_usdc_out, r6(ei) AS expected_usdc_in, r6(ei - eo) AS expected_usdc_net, r6(coalesce(ao, 0)) AS actual_usdc_out, r6(coalesce(ai, 0)) AS actual_usdc_in,
  r6(coalesce(ai, 0) - coalesce(ao, 0)) AS actual_usdc_net, r6(coalesce(ao, 0) - eo) AS usdc_out_diff, r6(coalesce(ai, 0) - ei) AS usdc_in_diff FROM e LEFT JOIN a USING (username, proxy_address, tx_hash)""")
def tx_cash_reconcile(t: Tables):
    x = t.trades().filter("transaction_hash IS NOT NULL")
    me, buy = F.lower("proxy_address"), F.col("side") == "BUY"
    usdc = x.select(F.col("transaction_hash").alias("tx_hash"), F.when(buy, me).otherwise("0xpool").alias("from_address"), F.when(buy, "0xpool").otherwise(me).alias("to_address"),
                    F.round(F.col("price") * F.col("size") + F.lit(0.01) * (F.col("version") % 2), 6).alias("amount_usdc"))
    return onchain.tx_cash_reconcile(t.trades(), usdc)


@query("trade_enrich_v2", f"""WITH {_CHAIN}, rc AS (SELECT '0xT' || o_orderkey AS h, o_orderkey AS bn, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS st FROM orders)
SELECT e.event_key, rc.bn AS tx_block_number, CAST(rc.st AS INTEGER) AS tx_status, p.event_key IS NOT NULL AS onchain_matched, p.pair_token_id AS onchain_pair_token_id, p.pair_token_id IS NOT NULL AS complete_set_like,
  r6(1 - round(p.onchain_price + p.pair_price, 6)) AS complete_set_edge, r6((total_bid_volume - total_ask_volume)/(total_bid_volume + total_ask_volume)) AS full_book_imbalance,
  CAST(floor(epoch(r.resolution_time)) - epoch(e.ts) AS BIGINT) AS seconds_to_resolution,
  CASE WHEN best_ask_price > 0 AND side = 'BUY' AND e.price >= best_ask_price - 0.001 THEN 'TAKER_LIKE' WHEN best_bid_price > 0 AND side = 'BUY' AND e.price <= best_bid_price + 0.001 THEN 'MAKER_LIKE'
    WHEN best_bid_price > 0 AND side = 'SELL' AND e.price <= best_bid_price + 0.001 THEN 'TAKER_LIKE' WHEN best_ask_price > 0 AND side = 'SELL' AND e.price >= best_ask_price - 0.001 THEN 'MAKER_LIKE' WHEN mid > 0 THEN 'INSIDE' ELSE 'UNKNOWN' END AS exec_type
FROM v_enriched e LEFT JOIN rc ON rc.h = e.transaction_hash LEFT JOIN pairs p ON p.event_key = e.event_key LEFT JOIN v_resolutions r ON r.market_slug = e.market_slug""")
def trade_enrich_v2(t: Tables):
    rec = t.read("orders").select(F.concat(F.lit("0xT"), F.col("o_orderkey").cast("string")).alias("tx_hash"), F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("block_timestamp"),
                                  F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("status"), F.col("o_custkey").alias("gas_used"))
    out = enrich.enrich_v2(t.enriched(), rec, pairs(t), t.resolutions())
    return rounded(out.select("event_key", "tx_block_number", "tx_status", "onchain_matched", "onchain_pair_token_id", "complete_set_like", "complete_set_edge", "full_book_imbalance",
                              "seconds_to_resolution", "exec_type"))
