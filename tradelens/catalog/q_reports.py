"""Per-user reports, positions, complete sets, microstructure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.operators.ordering import top_per
from tradelens.catalog.registry import query
from tradelens.catalog.tables import AS_OF, Tables, as_of
from tradelens.functions import columns as C
from tradelens.functions.numeric import rnd
from tradelens.plans import enrich, positions, reports
from tradelens.session import checkpointed


def rounded(df, digits: int = 6):
    """Round every double column of a report."""
    return df.select(*[rnd(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query("user_trade_stats", """
SELECT username, count(*) AS trades, min(ts) AS first_trade_at, max(ts) AS last_trade_at, count(DISTINCT market_slug) AS unique_markets,
  count(DISTINCT token_id) AS unique_assets, r6(sum(size*price)) AS notional_usd, r6(avg(price)) AS avg_price, r6(avg(size)) AS avg_size
FROM v_trades GROUP BY username""")
def user_trade_stats(t: Tables):
    return rounded(reports.user_trade_stats(t.trades()))


@query("side_outcome_breakdown", """
SELECT username, 'side' AS dimension, side AS name, count(*) AS trades FROM v_trades GROUP BY username, side
UNION ALL SELECT username, 'outcome', outcome, count(*) FROM v_trades GROUP BY username, outcome""")
def side_outcome_breakdown(t: Tables):
    return reports.breakdown(t.trades(), ["side", "outcome"])


@query("top_markets", """
SELECT username, market_slug AS slug, max(title) AS title, count(*) AS trades FROM v_trades GROUP BY username, market_slug
QUALIFY row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, market_slug) <= 20""")
def top_markets(t: Tables):
    return reports.top_markets(t.trades())


_TIMED = """timed AS (SELECT *, CAST(split_part(market_slug, '-', 4) AS BIGINT) + 900 - CAST(epoch(ts) AS BIGINT) AS seconds_to_end,
    upper(split_part(market_slug, '-', 1)) AS asset FROM v_trades WHERE market_slug LIKE '%updown-15m-%')"""


def _quantile_sql(keys: str, where: str = "TRUE", high: int = 3600) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""WITH {_TIMED},
ranked AS (SELECT *, row_number() OVER ({part} ORDER BY seconds_to_end) - 1 AS i, count(*) OVER ({part}) AS n
  FROM timed WHERE {where} AND seconds_to_end BETWEEN -60 AND {high})
SELECT {k}count(*) AS trades, min(seconds_to_end) AS min_seconds_to_end, max(seconds_to_end) AS max_seconds_to_end,
  r6(avg(seconds_to_end)) AS avg_seconds_to_end,
  max(CASE WHEN i = least(floor(0.1::DOUBLE*n), n - 1) THEN seconds_to_end END) AS p10_seconds_to_end,
  max(CASE WHEN i = least(floor(0.5::DOUBLE*n), n - 1) THEN seconds_to_end END) AS p50_seconds_to_end,
  max(CASE WHEN i = least(floor(0.9::DOUBLE*n), n - 1) THEN seconds_to_end END) AS p90_seconds_to_end
FROM ranked {group}"""


@query("timing_quantiles", _quantile_sql("username"))
def timing_quantiles(t: Tables):
    return rounded(reports.timing_quantiles(reports.with_timing(t.trades()), ["username"]))


@query("timing_quantiles_by_asset", _quantile_sql("username, asset", "asset <> ''", 900))
def timing_quantiles_by_asset(t: Tables):
    timed = reports.with_timing(t.trades(), high=900).filter("asset != ''")
    return rounded(reports.timing_quantiles(timed, ["username", "asset"]))


@query("timing_quantiles_by_outcome", _quantile_sql("username, outcome", high=900))
def timing_quantiles_by_outcome(t: Tables):
    return rounded(reports.timing_quantiles(reports.with_timing(t.trades(), high=900), ["username", "outcome"]))


@query("timing_quantiles_by_market", _quantile_sql("username, market_slug", high=900))
def timing_quantiles_by_market(t: Tables):
    return rounded(reports.timing_quantiles(reports.with_timing(t.trades(), high=900), ["username", "market_slug"]))


@query("timing_quantiles_daily", f"""WITH {_TIMED},
ranked AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY username, CAST(ts AS DATE), asset ORDER BY seconds_to_end) - 1 AS i,
  count(*) OVER (PARTITION BY username, CAST(ts AS DATE), asset) AS n FROM timed WHERE asset <> '' AND seconds_to_end BETWEEN 0 AND 900)
SELECT username, day, asset, count(*) AS trades, r6(avg(seconds_to_end)) AS avg_seconds_to_end,
  max(CASE WHEN i = least(floor(0.5::DOUBLE*n), n - 1) THEN seconds_to_end END) AS p50_seconds_to_end FROM ranked GROUP BY username, day, asset""")
def timing_quantiles_daily(t: Tables):
    timed = reports.with_timing(t.trades(), 0, 900).filter("asset != ''").withColumn("day", F.to_date("ts"))
    return rounded(reports.timing_quantiles(timed, ["username", "day", "asset"])).select(
        "username", "day", "asset", "trades", "avg_seconds_to_end", "p50_seconds_to_end")


@query("timing_buckets", f"""WITH {_TIMED}
SELECT username, seconds_to_end // 60 * 60 AS bucket_start, seconds_to_end // 60 * 60 + 60 AS bucket_end, count(*) AS trades,
  r6(avg(price)) AS avg_price, r6(avg(size)) AS avg_size FROM timed WHERE seconds_to_end BETWEEN 0 AND 900 GROUP BY ALL""")
def timing_buckets(t: Tables):
    return rounded(reports.timing_buckets(reports.with_timing(t.trades(), 0, 900)))


@query("timing_pnl_buckets", """
SELECT username, s // 60 * 60 AS bucket_start, s // 60 * 60 + 60 AS bucket_end, count(realized_pnl) AS resolved_trades,
  r6(coalesce(sum(realized_pnl), 0)) AS realized_pnl_usd, r6(coalesce(sum(realized_pnl)/nullif(count(realized_pnl), 0), 0)) AS avg_pnl_per_trade,
  r6(coalesce(count(*) FILTER (realized_pnl > 0)/nullif(count(realized_pnl), 0), 0)) AS win_rate
FROM (SELECT *, CAST(split_part(market_slug, '-', 4) AS BIGINT) + 900 - CAST(epoch(ts) AS BIGINT) AS s FROM v_enriched
  WHERE market_slug LIKE '%updown-15m-%') WHERE s BETWEEN 0 AND 900 GROUP BY ALL""")
def timing_pnl_buckets(t: Tables):
    return rounded(reports.timing_pnl_buckets(reports.with_timing(t.enriched(), 0, 900)))


_BOTH = """
SELECT {keys}, max(title) AS title, sum(CASE WHEN up THEN size ELSE 0 END) AS up_shares, sum(CASE WHEN up THEN size*price ELSE 0 END) AS up_cost,
  count(*) FILTER (up) AS up_trades, sum(CASE WHEN NOT up THEN size ELSE 0 END) AS down_shares,
  sum(CASE WHEN NOT up THEN size*price ELSE 0 END) AS down_cost, count(*) FILTER (NOT up) AS down_trades,
  min(ts) AS first_trade_at, max(ts) AS last_trade_at
FROM (SELECT *, outcome = 'Up' AS up, time_bucket(INTERVAL 60 SECOND, ts) AS window_start FROM v_trades WHERE side = 'BUY') GROUP BY {keys}"""


def _sets(keys: str, having: bool) -> str:
    return f"""sets AS (SELECT *, least(up_shares, down_shares) AS matched_shares, 1 - (up_p + down_p) AS edge_per_share,
  least(up_shares, down_shares)*(1 - (up_p + down_p)) AS edge_pnl FROM (SELECT *, coalesce(up_cost/nullif(up_shares, 0), 0) AS up_p,
  coalesce(down_cost/nullif(down_shares, 0), 0) AS down_p FROM ({_BOTH.format(keys=keys)})) {"WHERE up_shares > 0 AND down_shares > 0" if having else ""})"""


@query("complete_set_stats", f"""WITH {_sets("username, market_slug", False)}
SELECT username, count(*) AS markets_traded, count(*) FILTER (matched_shares > 0) AS markets_with_complete_sets,
  r6(sum(matched_shares)) AS complete_set_shares_total, r6(sum(edge_pnl)) AS total_implied_edge_usd,
  r6(coalesce(sum(edge_pnl)/nullif(sum(matched_shares), 0), 0)) AS avg_implied_edge_per_share FROM sets GROUP BY username""")
def complete_set_stats(t: Tables):
    return rounded(positions.complete_set_stats(t.trades()))


@query("complete_set_markets", f"""WITH {_sets("username, market_slug", False)}
SELECT username, market_slug, title, r6(up_shares) AS up_shares, r6(down_shares) AS down_shares, r6(matched_shares) AS matched_shares,
  r6(up_p) AS avg_up_price, r6(down_p) AS avg_down_price, r6(edge_per_share) AS edge_per_share, r6(edge_pnl) AS edge_pnl FROM sets
QUALIFY row_number() OVER (PARTITION BY username ORDER BY sets.matched_shares DESC, market_slug) <= 200""")
def complete_set_markets(t: Tables):
    cols = ["username", "market_slug", "title", "up_shares", "down_shares", "matched_shares", "avg_up_price", "avg_down_price",
            "edge_per_share", "edge_pnl"]
    sets = positions.both_sides(t.trades(), ["username", "market_slug"])
    return rounded(top_per(sets, ["username"], [F.desc("matched_shares"), F.asc("market_slug")], 200).select(*cols))


@query("complete_sets_by_market", f"""WITH {_sets("username, market_slug", True)}
SELECT username, market_slug, r6(up_shares) AS up_shares, up_trades, r6(down_shares) AS down_shares, down_trades,
  r6(matched_shares) AS matched_shares, r6(edge_per_share) AS edge_per_share, r6(edge_pnl) AS edge_pnl, first_trade_at, last_trade_at FROM sets""")
def complete_sets_by_market(t: Tables):
    return rounded(positions.complete_sets_by_market(t.trades()).select(
        "username", "market_slug", "up_shares", "up_trades", "down_shares", "down_trades", "matched_shares", "edge_per_share",
        "edge_pnl", "first_trade_at", "last_trade_at"))


@query("complete_sets_summary", f"""WITH {_sets("username, market_slug", True)}
SELECT username, count(*) AS total_markets, count(*) FILTER (round(edge_per_share, 9) > 0) AS positive_edge_markets,
  r6(sum(matched_shares)) AS total_matched_shares, r6(sum(edge_pnl)) AS total_edge_pnl,
  r6(sum(edge_pnl)/sum(matched_shares)) AS avg_edge_per_share, r6(avg(up_trades + down_trades)) AS avg_trades_per_market
FROM sets GROUP BY username""")
def complete_sets_summary(t: Tables):
    return rounded(positions.complete_sets_summary(positions.complete_sets_by_market(t.trades())))


@query("windowed_complete_sets", f"""WITH {_sets("username, market_slug, window_start", True)}
SELECT username, count(DISTINCT market_slug) AS markets_with_sets, count(*) AS windows_with_both_sides, r6(sum(matched_shares)) AS detected_shares,
  r6(sum(edge_pnl)) AS total_implied_edge_usd, r6(sum(edge_pnl)/sum(matched_shares)) AS avg_implied_edge_per_share FROM sets GROUP BY username""")
def windowed_complete_sets(t: Tables):
    return rounded(positions.windowed_rollup(positions.windowed_complete_sets(t.trades()), ["username"]))


@query("windowed_complete_sets_by_market", f"""WITH {_sets("username, market_slug, window_start", True)}
SELECT username, market_slug, count(DISTINCT market_slug) AS markets_with_sets, count(*) AS windows_with_both_sides,
  r6(sum(matched_shares)) AS detected_shares, r6(sum(edge_pnl)) AS total_implied_edge_usd,
  r6(sum(edge_pnl)/sum(matched_shares)) AS avg_implied_edge_per_share FROM sets GROUP BY username, market_slug""")
def windowed_complete_sets_by_market(t: Tables):
    return rounded(positions.windowed_rollup(positions.windowed_complete_sets(t.trades()), ["username", "market_slug"]))


@query("complete_set_pairs", """
SELECT a.username, a.market_slug, a.ts AS ts_1, a.event_key AS event_key_1, a.outcome AS outcome_1, a.price AS price_1, a.size AS size_1,
  b.ts AS ts_2, b.event_key AS event_key_2, b.outcome AS outcome_2, b.price AS price_2, b.size AS size_2,
  CAST(epoch(b.ts) - epoch(a.ts) AS BIGINT) AS time_gap_sec, least(a.size, b.size) AS matched_size, r6(a.price + b.price) AS combined_cost,
  r6(1 - (a.price + b.price)) AS edge_per_share, r6(least(a.size, b.size)*(1 - (a.price + b.price))) AS edge_pnl
FROM v_trades a JOIN v_trades b ON a.username = b.username AND a.market_slug = b.market_slug AND a.condition_id = b.condition_id
WHERE a.side = 'BUY' AND b.side = 'BUY' AND a.outcome <> b.outcome AND a.ts <= b.ts AND a.event_key < b.event_key
  AND epoch(b.ts) - epoch(a.ts) <= 60""")
def complete_set_pairs(t: Tables):
    return rounded(positions.complete_set_pairs(t.trades()))


_PNL = """count(realized_pnl) AS resolved_trades, r6(coalesce(sum(realized_pnl), 0)) AS realized_pnl_usd,
  r6(coalesce(sum(realized_pnl)/nullif(count(realized_pnl), 0), 0)) AS avg_pnl_per_trade,
  r6(coalesce(count(*) FILTER (realized_pnl > 0)/nullif(count(realized_pnl), 0), 0)) AS win_rate"""


@query("realized_pnl_stats", f"""SELECT username, {_PNL},
  count(DISTINCT CASE WHEN realized_pnl IS NOT NULL THEN market_slug END) AS resolved_markets, count(DISTINCT market_slug) AS total_markets
FROM v_enriched GROUP BY username""")
def realized_pnl_stats(t: Tables):
    return rounded(reports.realized_pnl_stats(t.enriched()))


@query("realized_pnl_by_market", f"""SELECT username, market_slug, {_PNL}, r6(sum(size*price)) AS notional_usd FROM v_enriched
GROUP BY username, market_slug HAVING count(realized_pnl) > 0""")
def realized_pnl_by_market(t: Tables):
    return rounded(reports.realized_pnl_by(t.enriched(), ["username", "market_slug"]))


@query("realized_pnl_by_execution_type", f"""SELECT username, side, exec_type, {_PNL}, r6(sum(size*price)) AS notional_usd FROM v_research
WHERE tob_known GROUP BY username, side, exec_type HAVING count(realized_pnl) > 0""")
def realized_pnl_by_execution_type(t: Tables):
    return rounded(reports.realized_pnl_by(t.research().filter("tob_known"), ["username", "side", "exec_type"]))


@query("realized_pnl_by_series", f"""SELECT username, series, {_PNL}, r6(sum(size*price)) AS notional_usd FROM v_research
GROUP BY username, series HAVING count(realized_pnl) > 0""")
def realized_pnl_by_series(t: Tables):
    return rounded(reports.realized_pnl_by(t.research(), ["username", "series"]))


@query("execution_quality", """
SELECT username, count(*) AS trades, count(*) FILTER (tob_known) AS trades_with_tob, r6(count(*) FILTER (tob_known)/count(*)) AS tob_coverage,
  count(*) FILTER (tob_known AND side = 'BUY' AND price >= best_ask_price - 1e-6) AS buy_taker_like,
  count(*) FILTER (tob_known AND side = 'BUY' AND price <= best_bid_price + 1e-6) AS buy_maker_like,
  count(*) FILTER (tob_known AND side = 'BUY' AND price > best_bid_price + 1e-6 AND price < best_ask_price - 1e-6) AS buy_inside,
  r6(avg(spread) FILTER (tob_known)) AS avg_spread, r6(avg(price_minus_mid) FILTER (tob_known)) AS avg_price_minus_mid
FROM v_research GROUP BY username""")
def execution_quality(t: Tables):
    return rounded(reports.execution_quality(t.enriched()))


@query("execution_report", """
WITH k AS (SELECT *, 2*abs(price - mid) AS eff FROM v_research WHERE tob_known AND mid > 0 AND spread > 0),
m AS (SELECT username, 'ALL' AS scope, 'spread' AS measure, round(spread, 6) AS v FROM k
  UNION ALL SELECT username, 'ALL', 'tob_lag', CAST(tob_lag_millis AS DOUBLE) FROM k
  UNION ALL SELECT username, side, 'edge', round(CASE side WHEN 'BUY' THEN mid - price ELSE price - mid END, 6) FROM k
  UNION ALL SELECT username, side, 'eff_spread', round(eff, 6) FROM k
  UNION ALL SELECT username, side, 'eff_ratio', round(eff/spread, 6) FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY username, scope, measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY username, scope, measure) AS c FROM m)
SELECT username, scope, measure, count(*) AS n, r6(avg(v)) AS avg_value, r6(min(v)) AS min_value, r6(max(v)) AS max_value,
  r6(max(CASE WHEN i = floor(0.1::DOUBLE*c) THEN v END)) AS p10, r6(max(CASE WHEN i = floor(0.5::DOUBLE*c) THEN v END)) AS p50,
  r6(max(CASE WHEN i = floor(0.9::DOUBLE*c) THEN v END)) AS p90 FROM r GROUP BY username, scope, measure""")
def execution_report(t: Tables):
    return rounded(reports.execution_report(t.enriched()))


@query("hourly_activity", """SELECT username, CAST(hour(ts) AS INTEGER) AS hour_utc, count(*) AS trades, r6(sum(size*price)) AS notional_usd,
  r6(avg(price)) AS avg_price, r6(avg(size)) AS avg_size FROM v_trades GROUP BY username, hour(ts)""")
def hourly_activity(t: Tables):
    return rounded(reports.activity_by(t.trades(), ["username", F.hour("ts").alias("hour_utc")]))


@query("asset_activity", """SELECT username, upper(split_part(market_slug, '-', 1)) AS asset, count(*) AS trades, r6(sum(size*price)) AS notional_usd,
  r6(avg(price)) AS avg_price, r6(avg(size)) AS avg_size FROM v_trades WHERE market_slug LIKE '%updown-15m-%' GROUP BY ALL""")
def asset_activity(t: Tables):
    rows = t.trades().withColumn("asset", C.asset_of("market_slug")).filter("asset != ''")
    return rounded(reports.activity_by(rows, ["username", "asset"]))


@query("series_activity", """SELECT username, series, count(*) AS trades, r6(sum(size*price)) AS notional_usd,
  r6(avg(price)) AS avg_price, r6(avg(size)) AS avg_size FROM v_research GROUP BY ALL""")
def series_activity(t: Tables):
    rows = t.trades().withColumn("series", C.series_of("market_slug", "title"))
    return rounded(reports.activity_by(rows, ["username", "series"]))


@query("selection_summary", """
WITH c AS (SELECT username, market_slug, count(*) AS n FROM v_trades GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY n DESC, market_slug) AS rn FROM c)
SELECT username, CAST(sum(n) AS BIGINT) AS trades, count(*) AS unique_markets, max(n) FILTER (rn = 1) AS top1_trades,
  r6(max(n) FILTER (rn = 1)/sum(n)) AS top1_share, CAST(sum(n) FILTER (rn <= 5) AS BIGINT) AS top5_trades,
  r6(sum(n) FILTER (rn <= 5)/sum(n)) AS top5_share, CAST(sum(n) FILTER (rn <= 10) AS BIGINT) AS top10_trades,
  r6(sum(n) FILTER (rn <= 10)/sum(n)) AS top10_share, r6(sum(n*n)/pow(sum(n), 2)) AS market_hhi FROM r GROUP BY username""")
def selection_summary(t: Tables):
    return rounded(reports.selection_summary(t.trades()))


@query("market_churn", """
WITH g AS (SELECT *, row_number() OVER w AS rn, lag(market_slug) OVER w AS pm, CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) AS delta
  FROM v_trades WINDOW w AS (PARTITION BY username ORDER BY ts, event_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY username, delta IS NULL ORDER BY delta) - 1 AS i, count(delta) OVER (PARTITION BY username) AS c FROM g)
SELECT username, count(*) AS trades, count(*) FILTER (rn > 1 AND market_slug <> pm) AS market_switches,
  r6(coalesce(count(*) FILTER (rn > 1 AND market_slug <> pm)/nullif(count(*) - 1, 0), 0)) AS market_switch_rate,
  r6(avg(delta)) AS avg_seconds_between_trades,
  max(CASE WHEN i = floor(0.5::DOUBLE*c) THEN delta END) AS p50_seconds_between_trades,
  max(CASE WHEN i = floor(0.9::DOUBLE*c) THEN delta END) AS p90_seconds_between_trades FROM r GROUP BY username""")
def market_churn(t: Tables):
    return rounded(reports.market_churn(t.trades()))


_FINAL = """pos AS (SELECT username, market_slug, token_id, arg_max(title, (ts, event_key)) AS title, arg_max(outcome, (ts, event_key)) AS outcome, count(*) AS trades, min(ts) AS first_trade_at,
  max(ts) AS last_trade_at, coalesce(sum(size) FILTER (side = 'BUY'), 0) AS buy_shares, coalesce(sum(size) FILTER (side = 'SELL'), 0) AS sell_shares,
  coalesce(sum(size) FILTER (side = 'BUY'), 0) - coalesce(sum(size) FILTER (side = 'SELL'), 0) AS net_shares,
  coalesce(sum(price*size) FILTER (side = 'BUY'), 0) AS buy_cost_usd, coalesce(sum(price*size) FILTER (side = 'SELL'), 0) AS sell_proceeds_usd,
  coalesce(sum(price*size) FILTER (side = 'BUY'), 0) - coalesce(sum(price*size) FILTER (side = 'SELL'), 0) AS net_cost_usd
  FROM v_trades GROUP BY username, market_slug, token_id)"""
_MARKS = """marks AS (SELECT market_slug, token_id, captured_at AS latest_tob_at, best_bid_price, best_ask_price, mid, spread FROM (
  SELECT *, row_number() OVER (PARTITION BY market_slug, token_id ORDER BY captured_at DESC, trade_key DESC, best_bid_price DESC NULLS LAST, best_ask_price DESC, mid DESC NULLS LAST) AS rn FROM v_tob_raw) WHERE rn = 1)"""
_SETTLED = f"""{_FINAL}, {_MARKS}, settled AS (SELECT s.*, settle_price*net_shares - net_cost_usd AS realized_pnl_usd,
  CASE WHEN k.mid > 0 THEN k.mid*net_shares - net_cost_usd END AS mtm_pnl_usd, k.mid, k.latest_tob_at, k.best_bid_price, k.best_ask_price, k.spread
  FROM (SELECT p.*, m.end_date, list_max(m.outcome_prices) >= 0.999 AS is_resolved,
      CASE WHEN list_max(m.outcome_prices) >= 0.999 THEN m.outcome_prices[list_position(m.outcomes, p.outcome)] END AS settle_price,
      CASE WHEN list_max(m.outcome_prices) >= 0.999 THEN m.outcomes[list_position(m.outcome_prices, 1.0::DOUBLE)] END AS resolved_outcome
    FROM pos p LEFT JOIN v_markets m ON m.slug = p.market_slug) s LEFT JOIN marks k ON k.market_slug = s.market_slug AND k.token_id = s.token_id)"""


def _settled(t: Tables):
    return positions.settled_positions(positions.position_final(t.trades()), t.markets(), positions.latest_marks(t.tob_raw()))


@query("position_final", f"""WITH {_FINAL} SELECT username, market_slug, token_id, title, outcome, trades, first_trade_at, last_trade_at,
  r6(buy_shares) AS buy_shares, r6(sell_shares) AS sell_shares, r6(net_shares) AS net_shares, r6(buy_cost_usd) AS buy_cost_usd,
  r6(sell_proceeds_usd) AS sell_proceeds_usd, r6(net_cost_usd) AS net_cost_usd, r6(buy_cost_usd/nullif(buy_shares, 0)) AS avg_buy_price,
  r6(sell_proceeds_usd/nullif(sell_shares, 0)) AS avg_sell_price FROM pos""")
def position_final(t: Tables):
    return rounded(positions.position_final(t.trades()))


@query("position_summary", f"""WITH {_SETTLED} SELECT username, count(DISTINCT market_slug) AS markets,
  count(DISTINCT CASE WHEN NOT is_resolved THEN market_slug END) AS open_markets, count(DISTINCT CASE WHEN is_resolved THEN market_slug END) AS resolved_markets,
  r6(coalesce(sum(net_cost_usd) FILTER (NOT is_resolved AND net_shares <> 0), 0)) AS open_net_cost_usd,
  r6(coalesce(sum(mtm_pnl_usd) FILTER (NOT is_resolved AND net_shares <> 0 AND mid > 0), 0)) AS open_mtm_pnl_usd,
  r6(coalesce(sum(realized_pnl_usd) FILTER (is_resolved), 0)) AS realized_pnl_usd FROM settled GROUP BY username""")
def position_summary(t: Tables):
    return rounded(positions.position_summary(t.trades(), _settled(t)))


_TOKEN_COLS = ["username", "market_slug", "token_id", "outcome", "trades", "net_shares", "net_cost_usd", "latest_tob_at", "mid", "is_resolved",
               "settle_price", "realized_pnl_usd", "mtm_pnl_usd"]


def _token_sql(where: str, order: str) -> str:
    return f"""WITH {_SETTLED} SELECT username, market_slug, token_id, outcome, trades, r6(net_shares) AS net_shares, r6(net_cost_usd) AS net_cost_usd,
  latest_tob_at, r6(mid) AS mid, is_resolved, r6(settle_price) AS settle_price, r6(realized_pnl_usd) AS realized_pnl_usd, r6(mtm_pnl_usd) AS mtm_pnl_usd
FROM settled WHERE {where} QUALIFY row_number() OVER (PARTITION BY username ORDER BY {order} DESC NULLS LAST, market_slug, token_id) <= 200"""


@query("token_positions_open", _token_sql("net_shares <> 0 AND NOT is_resolved", "round(abs(settled.net_cost_usd), 6)"))
def token_positions_open(t: Tables):
    s = _settled(t).withColumn("net_cost_usd", F.round("net_cost_usd", 6))
    return rounded(positions.token_positions(s, "OPEN").select(*_TOKEN_COLS))


@query("token_positions_resolved", _token_sql("is_resolved", "round(settled.realized_pnl_usd, 6)"))
def token_positions_resolved(t: Tables):
    s = _settled(t).withColumn("realized_pnl_usd", F.round("realized_pnl_usd", 6))
    return rounded(positions.token_positions(s, "RESOLVED").select(*_TOKEN_COLS))


@query("market_positions", f"""WITH {_SETTLED} SELECT username, market_slug, end_date, is_resolved, resolved_outcome, CAST(sum(trades) AS BIGINT) AS trades,
  min(first_trade_at) AS first_trade_at, max(last_trade_at) AS last_trade_at, count(*) AS token_positions, r6(sum(net_cost_usd)) AS net_cost_usd,
  r6(CASE WHEN is_resolved THEN coalesce(sum(realized_pnl_usd), 0) END) AS realized_pnl_usd,
  r6(CASE WHEN NOT is_resolved THEN coalesce(sum(mtm_pnl_usd), 0) END) AS mtm_pnl_usd
FROM settled GROUP BY username, market_slug, end_date, is_resolved, resolved_outcome""")
def market_positions(t: Tables):
    return rounded(positions.market_positions(_settled(t)))


@query("market_positions_top", f"""WITH {_SETTLED} SELECT username, market_slug, r6(sum(realized_pnl_usd)) AS realized_pnl_usd, count(*) AS token_positions
FROM settled WHERE is_resolved GROUP BY username, market_slug
QUALIFY row_number() OVER (PARTITION BY username ORDER BY round(sum(settled.realized_pnl_usd), 6) DESC NULLS LAST, market_slug) <= 200""")
def market_positions_top(t: Tables):
    rolled = positions.market_positions(_settled(t)).withColumn("realized_pnl_usd", F.round("realized_pnl_usd", 6))
    return rounded(positions.top_market_positions(rolled, "RESOLVED").select(
        "username", "market_slug", "realized_pnl_usd", "token_positions"))


@query("token_positions_all", _token_sql("true", "settled.last_trade_at"))
def token_positions_all(t: Tables):
    return rounded(positions.token_positions(_settled(t), "ALL").select(*_TOKEN_COLS))


@query("market_positions_open", f"""WITH {_SETTLED} SELECT username, market_slug, r6(sum(net_cost_usd)) AS net_cost_usd, count(*) AS token_positions
FROM settled WHERE NOT is_resolved GROUP BY username, market_slug
QUALIFY row_number() OVER (PARTITION BY username ORDER BY abs(round(sum(settled.net_cost_usd), 6)) DESC NULLS LAST, market_slug) <= 200""")
def market_positions_open(t: Tables):
    rolled = positions.market_positions(_settled(t)).withColumn("net_cost_usd", F.round("net_cost_usd", 6))
    return rounded(positions.top_market_positions(rolled, "OPEN").select("username", "market_slug", "net_cost_usd", "token_positions"))


@query("market_positions_all", f"""WITH {_SETTLED} SELECT username, market_slug, max(settled.last_trade_at) AS last_trade_at, count(*) AS token_positions
FROM settled GROUP BY username, market_slug
QUALIFY row_number() OVER (PARTITION BY username ORDER BY max(settled.last_trade_at) DESC NULLS LAST, market_slug) <= 200""")
def market_positions_all(t: Tables):
    return positions.top_market_positions(positions.market_positions(_settled(t)), "ALL").select("username", "market_slug", "last_trade_at", "token_positions")


@query("asset_roi", f"""WITH {_SETTLED} SELECT username, upper(split_part(market_slug, '-', 1)) AS asset, count(*) AS token_positions,
  r6(sum(net_cost_usd)) AS net_cost_usd, r6(sum(realized_pnl_usd)) AS realized_pnl_usd,
  r6(CASE WHEN round(sum(net_cost_usd), 9) > 0 THEN sum(realized_pnl_usd)/sum(net_cost_usd) ELSE 0 END) AS roi
FROM settled WHERE market_slug LIKE '%updown-15m-%' AND realized_pnl_usd IS NOT NULL GROUP BY ALL""")
def asset_roi(t: Tables):
    return rounded(positions.asset_roi(_settled(t)))


@query("entry_bucket_pnl", f"""WITH {_SETTLED} SELECT username, CAST(s//60*60 AS BIGINT) AS bucket_start, CAST(s//60*60 + 60 AS BIGINT) AS bucket_end, count(*) AS token_positions,
  r6(sum(net_cost_usd)) AS net_cost_usd, r6(sum(realized_pnl_usd)) AS realized_pnl_usd,
  r6(CASE WHEN round(sum(net_cost_usd), 9) > 0 THEN sum(realized_pnl_usd)/sum(net_cost_usd) ELSE 0 END) AS roi
FROM (SELECT *, CAST(split_part(market_slug, '-', 4) AS BIGINT) + 900 - CAST(epoch(first_trade_at) AS BIGINT) AS s FROM settled
  WHERE market_slug LIKE '%updown-15m-%') WHERE s BETWEEN 0 AND 900 AND realized_pnl_usd IS NOT NULL GROUP BY ALL""")
def entry_bucket_pnl(t: Tables):
    return rounded(positions.entry_buckets(_settled(t)))


_BARS = """bars AS (SELECT token_id, date_trunc('minute', ts) AS minute, count(*) AS trade_count, sum(size) AS volume, sum(size*price) AS notional,
  avg(price) AS avg_price, sum(size*price)/sum(size) AS vwap, min(price) AS low_price, max(price) AS high_price, max(price) - min(price) AS price_range,
  stddev_pop(price) AS price_volatility, coalesce(sum(size) FILTER (side = 'BUY'), 0) AS buy_volume, coalesce(sum(size) FILTER (side = 'SELL'), 0) AS sell_volume,
  count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side = 'SELL') AS sell_count,
  (coalesce(sum(size) FILTER (side = 'BUY'), 0) - coalesce(sum(size) FILTER (side = 'SELL'), 0))/sum(size) AS flow_imbalance,
  min(ts) AS first_trade_at, max(ts) AS last_trade_at FROM v_market_trades GROUP BY 1, 2)"""
_FLOW = f"""{_BARS}, flow AS (SELECT u.*, a.volume AS volume_1m_before, a.trade_count AS trades_1m_before, a.flow_imbalance AS flow_imbalance_1m_before,
  a.price_volatility AS volatility_1m_before, a.vwap AS vwap_1m_before, a.price_range AS price_range_1m_before, z.volume AS volume_1m_after,
  z.trade_count AS trades_1m_after, z.flow_imbalance AS flow_imbalance_1m_after,
  CASE WHEN a.volume > 0 AND b.volume > 0 THEN (a.volume - b.volume)/b.volume END AS volume_acceleration,
  CASE WHEN a.vwap > 0 THEN u.price - a.vwap END AS price_vs_vwap
  FROM v_research u LEFT JOIN bars a ON a.token_id = u.token_id AND a.minute = date_trunc('minute', u.ts) - INTERVAL 1 MINUTE
  LEFT JOIN bars b ON b.token_id = u.token_id AND b.minute = date_trunc('minute', u.ts) - INTERVAL 2 MINUTE
  LEFT JOIN bars z ON z.token_id = u.token_id AND z.minute = date_trunc('minute', u.ts) + INTERVAL 1 MINUTE)"""
_FLOW_COLS = ["event_key", "volume_1m_before", "trades_1m_before", "flow_imbalance_1m_before", "volatility_1m_before", "vwap_1m_before",
              "volume_1m_after", "trades_1m_after", "flow_imbalance_1m_after", "volume_acceleration", "price_vs_vwap"]


@query("minute_bars", f"""WITH {_BARS} SELECT token_id, minute, trade_count, r6(volume) AS volume, r6(notional) AS notional, r6(avg_price) AS avg_price,
  r6(vwap) AS vwap, low_price + 0.0 AS low_price, high_price + 0.0 AS high_price, r6(price_range) AS price_range, first_trade_at, last_trade_at FROM bars""")
def minute_bars(t: Tables):
    return rounded(enrich.minute_bars(t.market_trades()).select(
        "token_id", "minute", "trade_count", "volume", "notional", "avg_price", "vwap", "low_price", "high_price", "price_range",
        "first_trade_at", "last_trade_at"))


@query("minute_bars_enhanced", f"""WITH {_BARS} SELECT token_id, minute, trade_count, r6(price_volatility) AS price_volatility, r6(buy_volume) AS buy_volume,
  r6(sell_volume) AS sell_volume, buy_count, sell_count, r6(flow_imbalance) AS flow_imbalance FROM bars""")
def minute_bars_enhanced(t: Tables):
    return rounded(enrich.minute_bars(t.market_trades()).select(
        "token_id", "minute", "trade_count", "price_volatility", "buy_volume", "sell_volume", "buy_count", "sell_count", "flow_imbalance"))


_FLOW_SELECT = ", ".join(["event_key"] + [f"r6({c}) AS {c}" for c in _FLOW_COLS[1:]])


def _flow(t: Tables, base):
    return enrich.minute_lag_join(base, enrich.minute_bars(t.market_trades()))


@query("minute_lag_join", f"WITH {_FLOW} SELECT {_FLOW_SELECT} FROM flow")
def minute_lag_join(t: Tables):
    out = _flow(t, t.trades()).select(*_FLOW_COLS)
    return out.select("event_key", *[rnd(c).alias(c) for c in _FLOW_COLS[1:]])


@query("research_v2", f"""WITH {_FLOW} SELECT event_key, exec_type, r6(realized_pnl) AS realized_pnl, r6(volume_1m_before) AS volume_1m_before,
  r6(price_vs_vwap) AS price_vs_vwap, r6(volume_acceleration) AS volume_acceleration FROM flow""")
def research_v2(t: Tables):
    flow = _flow(t, t.research()).select(
        "event_key", "exec_type", "realized_pnl", "volume_1m_before", "price_vs_vwap", "volume_acceleration")
    return rounded(flow)


_MICRO = """count(*) AS trades, r6(avg(volume_1m_before)) AS avg_volume_1m_before, r6(avg(trades_1m_before)) AS avg_trade_count_1m_before,
  r6(avg(volume_1m_after)) AS avg_volume_1m_after, r6(avg(vwap_1m_before)) AS avg_vwap_1m_before, r6(avg(price)) AS avg_trade_price,
  r6(avg(price - vwap_1m_before)) AS avg_price_vs_vwap, r6(avg(price_range_1m_before)) AS avg_price_range_1m_before,
  count(*) FILTER (volume_1m_before > 0) AS trades_with_prior_activity, r6(count(*) FILTER (volume_1m_before > 0)/count(*)) AS prior_activity_coverage"""


@query("microstructure_summary", f"WITH {_FLOW} SELECT username, {_MICRO} FROM flow GROUP BY username")
def microstructure_summary(t: Tables):
    return rounded(reports.microstructure_summary(_flow(t, t.trades()), ["username"]))


@query("microstructure_by_asset", f"WITH {_FLOW} SELECT username, asset, {_MICRO} FROM flow WHERE asset <> '' GROUP BY username, asset")
def microstructure_by_asset(t: Tables):
    base = t.trades().withColumn("asset", C.asset_of("market_slug")).filter("asset != ''")
    return rounded(reports.microstructure_summary(_flow(t, base), ["username", "asset"]))


# ---- mergeable states ------------------------------------------------------------------------


@query("sketch_report", f"""SELECT username, count(*) AS trades, r4(sum(notional)) AS notional, TRUE AS median_within, TRUE AS markets_within FROM v_trades
WHERE CAST(ts AS DATE) > DATE '{AS_OF[:10]}' - INTERVAL 400 DAY AND CAST(ts AS DATE) <= DATE '{AS_OF[:10]}' GROUP BY username""")
def sketch_report(t: Tables):
    """Reports of 400 days from daily states, held against exact figures: the rank of the median within 5 %, the number of markets within 6 % or 2."""
    from tradelens.plans import sketches
    states = checkpointed(sketches.daily_states(t.trades(), ["username"], F.col("price"), F.col("market_slug")))
    found = sketches.merged_report(states, ["username"], as_of(), 400, {"median": 0.5})
    day = F.to_date("ts")
    recent = t.trades().filter((day > F.to_date(as_of()) - 400) & (day <= F.to_date(as_of()))).select("username", "price", "market_slug")
    exact = recent.join(found.select("username", "median"), "username").groupBy("username").agg(
        F.avg((F.col("price") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("price") <= F.col("median")).cast("int")).alias("upto"), F.count_distinct("market_slug").alias("markets"))
    out = found.join(exact, "username").select(
        "username", "trades", "notional", ((F.col("below") <= 0.55) & (F.col("upto") >= 0.45)).alias("median_within"),
        (F.abs(F.col("distinct_estimate") - F.col("markets")) <= F.greatest(F.lit(2.0), F.col("markets") * 0.06)).alias("markets_within"))
    return rounded(out, 4)
