"""The projections of ``tables.py`` stated in DuckDB SQL, one CTE body per name."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["v_lines"] = """
SELECT *,
  CASE WHEN l_partkey % 2 = 0
       THEN (CASE WHEN l_partkey % 4 = 0 THEN 'btc' ELSE 'eth' END) || '-updown-15m-' || CAST(epoch(l_shipdate) AS BIGINT)
       ELSE 'topic-' || (l_partkey % 40) END AS slug,
  CASE WHEN l_linestatus = 'O' THEN 'Up' ELSE 'Down' END AS outcome,
  l_shipdate + to_seconds((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % CASE WHEN l_partkey % 2 = 0 THEN 900 ELSE 86400 END) AS ts,
  'evt-' || l_orderkey || '-' || l_linenumber AS event_key,
  round(0.05 + 9*l_discount, 2) AS price,
  l_orderkey*10 + l_linenumber AS seq
FROM lineitem
"""

VIEWS["v_trades_raw"] = """
SELECT 'u' || (o_custkey % 200) AS username, event_key, '0xA' || (o_custkey % 200) AS proxy_address, ts,
  l_suppkey AS version, slug AS market_slug,
  CASE WHEN l_partkey % 2 = 0 THEN upper(split_part(slug, '-', 1)) || ' 15m'
       WHEN (l_partkey % 40) % 3 = 0 THEN 'Topic ' || (l_partkey % 40) || ' Up or Down'
       ELSE 'Topic ' || (l_partkey % 40) END AS title,
  slug || ':' || outcome AS token_id, 'c-' || slug AS condition_id,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, outcome,
  CASE WHEN outcome = 'Up' THEN 0 ELSE 1 END AS outcome_index,
  price, l_quantity AS size, price*l_quantity AS notional,
  CASE WHEN l_linenumber <> 7 THEN '0xT' || l_orderkey END AS transaction_hash
FROM v_lines JOIN orders ON l_orderkey = o_orderkey
"""

VIEWS["v_trades"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY username, event_key ORDER BY version DESC, proxy_address DESC, ts DESC,
    market_slug DESC, title DESC, token_id DESC, condition_id DESC, side DESC, outcome DESC, outcome_index DESC,
    price DESC, size DESC, notional DESC) AS rn
  FROM v_trades_raw) WHERE rn = 1
"""

VIEWS["v_tob_raw"] = """
SELECT *, round((best_ask_price + best_bid_price)/2, 4) AS mid, round(best_ask_price - best_bid_price, 4) AS spread,
  best_bid_size*3 AS total_bid_volume, best_ask_size*3 AS total_ask_volume
FROM (SELECT event_key AS trade_key, slug || ':' || outcome AS token_id,
    ts + to_microseconds((l_suppkey*37 % 4000)*1000) AS captured_at, slug AS market_slug, outcome,
    CASE WHEN l_suppkey % 11 <> 0 THEN round(price - 0.01*(l_suppkey % 4), 2) END AS best_bid_price,
    l_quantity AS best_bid_size,
    round(price - 0.01*(l_suppkey % 4) + 0.02, 2) AS best_ask_price,
    CAST(l_partkey % 30 + 1 AS DOUBLE) AS best_ask_size
  FROM v_lines WHERE l_suppkey % 5 <> 0)
"""

VIEWS["v_tob"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_key, token_id ORDER BY captured_at DESC, market_slug DESC, outcome DESC,
    best_bid_price DESC NULLS LAST, best_bid_size DESC, best_ask_price DESC, best_ask_size DESC) AS rn
  FROM v_tob_raw) WHERE rn = 1
"""

VIEWS["v_ws_tob"] = """
SELECT slug || ':' || outcome AS asset_id, l_shipdate + to_seconds((l_orderkey*31 + l_partkey*17) % 900) AS ts,
  round(price - 0.01*(l_suppkey % 2), 2) AS best_bid_price, l_quantity AS best_bid_size,
  round(round(price - 0.01*(l_suppkey % 2), 2) + 0.01, 2) AS best_ask_price, l_quantity + 1 AS best_ask_size,
  price AS last_trade_price, seq, l_suppkey AS "offset"
FROM v_lines
"""

VIEWS["v_ws_unique"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, ts ORDER BY seq DESC, "offset" DESC, best_bid_price DESC,
    best_bid_size DESC, best_ask_price DESC, best_ask_size DESC, last_trade_price DESC) AS rn
  FROM v_ws_tob) WHERE rn = 1
"""

VIEWS["v_market_trades"] = """
SELECT slug || ':' || outcome AS token_id, slug AS market_slug,
  l_shipdate + to_seconds((l_orderkey*13 + l_linenumber*7) % 900) AS ts,
  CASE WHEN l_linenumber % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side, price, l_quantity AS size, event_key
FROM v_lines
"""

VIEWS["v_markets_raw"] = """
SELECT slug, l_shipdate + to_seconds(l_suppkey) AS captured_at, 'm-' || slug AS market_id, 'c-' || slug AS condition_id,
  CASE WHEN l_partkey % 2 = 1 THEN TIMESTAMP '2001-01-01' + to_seconds(kind*86400)
       WHEN kind % 2 = 0 THEN l_shipdate + to_seconds(900) END AS end_date,
  ['Up', 'Down'] AS outcomes,
  CASE kind % 3 WHEN 0 THEN [1.0::DOUBLE, 0.0::DOUBLE] WHEN 1 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [0.5::DOUBLE, 0.5::DOUBLE] END AS outcome_prices,
  [slug || ':Up', slug || ':Down'] AS token_ids, kind % 3 = 2 AS active, l_extendedprice AS volume_num, seq
FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) ELSE l_partkey % 40 END AS kind
      FROM v_lines)
"""

VIEWS["v_markets"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY captured_at DESC, market_id DESC, condition_id DESC,
    end_date DESC NULLS LAST, volume_num DESC, seq DESC) AS rn
  FROM v_markets_raw) WHERE rn = 1
"""

VIEWS["v_resolutions"] = """
SELECT condition_id, slug AS market_slug, TRUE AS is_resolved,
  CASE WHEN outcome_prices[1] = 1 THEN 'Up' ELSE 'Down' END AS winning_outcome,
  CASE WHEN outcome_prices[1] = 1 THEN 0 ELSE 1 END AS winning_outcome_index,
  coalesce(end_date, CASE WHEN slug LIKE '%updown-15m-%' THEN make_timestamp((CAST(split_part(slug, '-', 4) AS BIGINT) + 900)*1000000) END, captured_at) AS resolution_time
FROM v_markets WHERE outcome_prices[1] <> 0.5
"""

VIEWS["v_customers"] = """
SELECT 'u' || (c_custkey % 200) AS username, '0xA' || (c_custkey % 200) AS proxy_address, c_custkey, c_acctbal, c_mktsegment, c_nationkey
FROM customer
"""

VIEWS["v_score_history"] = """
SELECT proxy_address, username, c_custkey AS version, CAST(30 + c_custkey*13 % 70 AS INTEGER) AS total_score,
  CASE WHEN 30 + c_custkey*13 % 70 >= 80 THEN 'DIAMOND' WHEN 30 + c_custkey*13 % 70 >= 60 THEN 'GOLD'
       WHEN 30 + c_custkey*13 % 70 >= 40 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ARBITRAGEUR' WHEN 'MACHINERY' THEN 'MARKET_MAKER'
       WHEN 'AUTOMOBILE' THEN 'DIRECTIONAL_FUNDAMENTAL' WHEN 'HOUSEHOLD' THEN 'HYBRID' ELSE 'UNKNOWN' END AS strategy_type,
  round(c_acctbal/2500, 4) AS sharpe_ratio, round((c_custkey*29 % 100)/100.0::DOUBLE, 2) AS strategy_confidence,
  TIMESTAMP '2001-09-01' + to_seconds(c_custkey % 70 * 86400) AS calculated_at
FROM v_customers
"""

VIEWS["v_scores"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY version DESC) AS rn FROM v_score_history) WHERE rn = 1
"""

VIEWS["v_profiles"] = """
SELECT proxy_address, max(username) AS username, count(*) AS total_trades, sum(notional) AS total_volume_usd,
  count(DISTINCT market_slug) AS unique_markets, min(ts) AS first_trade_at, max(ts) AS last_trade_at,
  CAST(datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS INTEGER) AS days_active
FROM v_trades GROUP BY proxy_address
"""

VIEWS["v_trader_pnl"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY version DESC) AS rn FROM (
  SELECT proxy_address, c_custkey AS version, round(c_acctbal*3 - 9000, 2) AS total_realized_pnl,
    c_custkey % 40 + 1 AS closed_positions, round((c_custkey*17 % 101)/100.0::DOUBLE, 2) AS win_rate
  FROM v_customers WHERE c_custkey % 9 <> 0)) WHERE rn = 1
"""

VIEWS["v_ml_scores"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY version DESC) AS rn FROM (
  SELECT proxy_address, c_custkey AS version, CAST(20 + c_custkey*31 % 80 AS DOUBLE) AS ml_score,
    CASE WHEN c_custkey*31 % 80 >= 60 THEN 'DIAMOND' WHEN c_custkey*31 % 80 >= 40 THEN 'GOLD'
         WHEN c_custkey*31 % 80 >= 20 THEN 'SILVER' ELSE 'BRONZE' END AS ml_tier,
    round(c_acctbal/4000, 4) AS predicted_sharpe, 'v' || (c_custkey % 3 + 1) AS model_version,
    CAST(c_custkey % 8 AS INTEGER) AS cluster_id, round((c_custkey*7 % 100)/100.0::DOUBLE, 2) AS anomaly_score
  FROM v_customers WHERE c_custkey % 4 <> 0)) WHERE rn = 1
"""

VIEWS["v_quotes"] = """
SELECT CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS asset_id, ts,
  round(0.05 + (event_id % 80)/100.0::DOUBLE, 2) AS bid, round(round(0.05 + (event_id % 80)/100.0::DOUBLE, 2) + 0.02, 2) AS ask,
  value AS bid_size, event_id
FROM events WHERE event_type IN ('view', 'click')
"""

VIEWS["v_prints"] = """
SELECT CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS asset_id, ts, value AS size, event_id
FROM events WHERE event_type = 'purchase'
"""

VIEWS["v_enriched"] = """
SELECT *, CAST(floor(epoch_us(end_date)/1000000) AS BIGINT) - CAST(floor(epoch_us(ts)/1000000) AS BIGINT) AS seconds_to_end,
  price - mid AS price_minus_mid,
  CASE WHEN is_resolved THEN outcomes[list_position(outcome_prices, list_max(outcome_prices))] END AS resolved_outcome,
  size * CASE WHEN side = 'SELL' THEN price - settle_price ELSE settle_price - price END AS realized_pnl
FROM (SELECT t.*, b.captured_at AS tob_captured_at, b.best_bid_price, b.best_bid_size, b.best_ask_price, b.best_ask_size, b.mid,
    b.spread, b.total_bid_volume, b.total_ask_volume,
    m.market_id, coalesce(m.end_date, CASE WHEN t.market_slug LIKE '%updown-15m-%'
      THEN make_timestamp((CAST(split_part(t.market_slug, '-', 4) AS BIGINT) + 900)*1000000) END) AS end_date,
    m.active, m.outcomes, m.outcome_prices, m.token_ids, m.volume_num,
    list_max(m.outcome_prices) >= 0.999 AND list_min(m.outcome_prices) <= 0.001 AS is_resolved,
    CASE WHEN list_max(m.outcome_prices) >= 0.999 AND list_min(m.outcome_prices) <= 0.001
         THEN m.outcome_prices[list_position(m.outcomes, t.outcome)] END AS settle_price
  FROM v_trades t LEFT JOIN v_tob b ON b.trade_key = t.event_key AND b.token_id = t.token_id
  LEFT JOIN v_markets m ON m.slug = t.market_slug)
"""

VIEWS["v_research"] = """
SELECT *, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour_utc, price*size AS notional_usd,
  CASE WHEN market_slug LIKE '%updown-15m-%' THEN 'updown-15m' WHEN lower(title) LIKE '%up or down%' THEN 'up-or-down'
       WHEN lower(market_slug) LIKE '%updown%' THEN 'updown' ELSE 'other' END AS series,
  CASE WHEN market_slug LIKE '%updown-15m-%' THEN upper(split_part(market_slug, '-', 1)) ELSE '' END AS asset,
  CASE WHEN NOT tob_known THEN 'UNKNOWN'
       WHEN side = 'BUY' AND price >= best_ask_price - 1e-6 THEN 'TAKER_LIKE'
       WHEN side = 'BUY' AND price <= best_bid_price + 1e-6 THEN 'MAKER_LIKE'
       WHEN side = 'SELL' AND price <= best_bid_price + 1e-6 THEN 'TAKER_LIKE'
       WHEN side = 'SELL' AND price >= best_ask_price - 1e-6 THEN 'MAKER_LIKE'
       WHEN price > best_bid_price + 1e-6 AND price < best_ask_price - 1e-6 THEN 'INSIDE' ELSE 'OUTSIDE' END AS exec_type,
  CASE WHEN tob_known THEN CASE side WHEN 'BUY' THEN mid - price ELSE price - mid END END AS edge_vs_mid,
  CASE WHEN tob_known THEN 2*abs(price - mid) END AS effective_spread,
  CASE WHEN tob_known AND spread > 0 THEN 2*abs(price - mid)/spread END AS effective_spread_ratio,
  CAST(floor(epoch_us(tob_captured_at)/1000) AS BIGINT) - CAST(floor(epoch_us(ts)/1000) AS BIGINT) AS tob_lag_millis,
  CASE WHEN tob_known THEN (best_bid_size - best_ask_size)/(best_bid_size + best_ask_size) END AS tob_imbalance
FROM (SELECT *, coalesce(tob_captured_at IS NOT NULL AND best_bid_price > 0 AND best_ask_price > 0, FALSE) AS tob_known FROM v_enriched)
"""

VIEWS["v_enriched_ws"] = """
SELECT *, CASE WHEN ws_best_bid_price > 0 AND ws_best_ask_price > 0 THEN (ws_best_bid_price + ws_best_ask_price)/2 END AS ws_mid,
  CASE WHEN ws_best_bid_price > 0 AND ws_best_ask_price > 0 THEN ws_best_ask_price - ws_best_bid_price END AS ws_spread,
  CASE WHEN ws_best_ask_price > 0 AND side = 'BUY' AND price >= ws_best_ask_price - 0.001 THEN 'TAKER_LIKE'
       WHEN ws_best_bid_price > 0 AND side = 'BUY' AND price <= ws_best_bid_price + 0.001 THEN 'MAKER_LIKE'
       WHEN ws_best_bid_price > 0 AND side = 'SELL' AND price <= ws_best_bid_price + 0.001 THEN 'TAKER_LIKE'
       WHEN ws_best_ask_price > 0 AND side = 'SELL' AND price >= ws_best_ask_price - 0.001 THEN 'MAKER_LIKE'
       WHEN ws_best_bid_price > 0 AND ws_best_ask_price > 0 THEN 'INSIDE' ELSE 'UNKNOWN' END AS ws_exec_type
FROM (SELECT e.*, w.ts AS ws_tob_captured_at, nullif(w.best_bid_price, 0) AS ws_best_bid_price, nullif(w.best_bid_size, 0) AS ws_best_bid_size,
    nullif(w.best_ask_price, 0) AS ws_best_ask_price, nullif(w.best_ask_size, 0) AS ws_best_ask_size,
    nullif(w.last_trade_price, 0) AS ws_last_trade_price,
    CAST(floor(epoch_us(e.ts)/1000) - floor(epoch_us(w.ts)/1000) AS BIGINT) AS ws_tob_lag_millis
  FROM v_enriched e ASOF LEFT JOIN v_ws_unique w ON e.token_id = w.asset_id AND e.ts >= w.ts)
"""

VIEWS["v_enriched_opp"] = """
SELECT *, CASE WHEN ws_best_ask_price > 0 AND ws_opp_best_ask_price > 0 THEN ws_best_ask_price + ws_opp_best_ask_price END AS ws_complete_set_ask_sum,
  CASE WHEN ws_best_ask_price > 0 AND ws_opp_best_ask_price > 0 THEN 1 - (ws_best_ask_price + ws_opp_best_ask_price) END AS ws_complete_set_edge_ask
FROM (SELECT e.*, w.ts AS ws_opp_tob_captured_at, w.best_bid_price AS ws_opp_best_bid_price, w.best_bid_size AS ws_opp_best_bid_size,
    w.best_ask_price AS ws_opp_best_ask_price, w.best_ask_size AS ws_opp_best_ask_size,
    CAST(floor(epoch_us(e.ts)/1000) - floor(epoch_us(w.ts)/1000) AS BIGINT) AS ws_opp_tob_lag_millis
  FROM (SELECT *, token_ids[3 - list_position(outcomes, outcome)] AS opposite_token_id FROM v_enriched_ws) e
  ASOF LEFT JOIN v_ws_unique w ON e.opposite_token_id = w.asset_id AND e.ts >= w.ts)
"""

VIEWS["v_order_lines"] = """
SELECT 'o' || l_orderkey AS order_id, TIMESTAMP '2000-01-01' + to_seconds(l_orderkey % 1000 * 3600) AS base,
  event_key || '-' || l_suppkey || '-' || l_partkey AS event_key, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus, l_quantity, price,
  slug AS market_slug, slug || ':' || outcome AS token_id, upper(outcome) AS direction FROM v_lines
"""

VIEWS["v_strategy_orders"] = """
SELECT order_id, event_key, market_slug, token_id, direction,
  CASE WHEN l_linenumber = 1 THEN 'PLACE' WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'CANCEL' ELSE 'REPLACE' END AS action,
  base + to_milliseconds(l_linenumber*700 + l_suppkey % 100) AS ts, price, l_quantity AS size, 0.01::DOUBLE AS tick_size,
  round(price - 0.01*(l_partkey % 3), 2) AS best_bid_price, round(round(price - 0.01*(l_partkey % 3), 2) + 0.05, 2) AS best_ask_price, l_suppkey % 9 <> 0 AS success
FROM v_order_lines WHERE l_linenumber <= 3
"""

VIEWS["v_order_status"] = """
SELECT order_id, event_key, base + to_milliseconds(l_linenumber*900 + l_partkey % 300) AS ts, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
  price AS requested_price, 60.0::DOUBLE AS requested_size, CASE WHEN l_returnflag <> 'R' THEN CAST((l_linenumber - 1)*10 AS DOUBLE) END AS matched_size, l_linestatus AS exchange_status
FROM v_order_lines WHERE l_linenumber >= 2
"""

VIEWS["v_clean"] = """
SELECT * FROM (SELECT *, CASE WHEN market_slug LIKE 'btc-updown-15m-%' THEN 'btc-15m' WHEN market_slug LIKE 'eth-updown-15m-%' THEN 'eth-15m' ELSE 'other' END AS series,
  coalesce(ws_best_bid_price, best_bid_price) AS our_best_bid, coalesce(ws_best_ask_price, best_ask_price) AS our_best_ask, coalesce(ws_mid, mid) AS our_mid,
  ws_opp_best_bid_price AS other_best_bid, CASE WHEN ws_best_bid_price > 0 THEN 'WS' ELSE 'REST' END AS tob_source,
  1 - coalesce(ws_best_bid_price, best_bid_price) - ws_opp_best_bid_price AS complete_set_edge FROM v_enriched_opp)
WHERE series <> 'other' AND seconds_to_end >= 0 AND our_best_bid > 0 AND other_best_bid > 0
"""

VIEWS["v_lifecycle"] = """
SELECT p.*, e.first_fill_ts, e.filled_size, e.first_matched_size, e.requested_size, e.last_exchange_status, epoch_ms(first_fill_ts) - epoch_ms(placed_ts) AS fill_latency_ms,
  epoch_ms(cancel_ts) - epoch_ms(placed_ts) AS cancel_latency_ms, CAST(floor(round((placed_price - bid_at_place)/0.01, 6)) AS BIGINT) AS ticks_above_best_bid
FROM (SELECT order_id, arg_max(market_slug, (ts, event_key)) AS market_slug, min(ts) FILTER (success AND action = 'PLACE') AS placed_ts,
    arg_min(price, (ts, event_key)) FILTER (success AND action = 'PLACE') AS placed_price, arg_min(best_bid_price, (ts, event_key)) FILTER (success AND action = 'PLACE') AS bid_at_place,
    arg_min(best_ask_price, (ts, event_key)) FILTER (success AND action = 'PLACE') AS ask_at_place, min(ts) FILTER (success AND action = 'CANCEL') AS cancel_ts,
    count(*) FILTER (success AND action = 'REPLACE') AS replace_count FROM v_strategy_orders GROUP BY 1) p
LEFT JOIN (SELECT order_id, coalesce(max(matched_size), 0) AS filled_size, min(ts) FILTER (matched_size > 0) AS first_fill_ts,
    arg_min(matched_size, (ts, event_key)) FILTER (matched_size > 0) AS first_matched_size, max(requested_size) AS requested_size,
    arg_max(exchange_status, (ts, event_key, exchange_status)) AS last_exchange_status FROM v_order_status GROUP BY 1) e USING (order_id)
"""
