"""Trader aggregates, scoring, indices, categories, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.operators.ordering import ranked
from tradelens.catalog.q_reports import rounded
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables, as_of
from tradelens.functions import columns as C
from tradelens.operators import keysets
from tradelens.operators.latest import latest_per_key, latest_ties
from tradelens.session import checkpointed
from tradelens.plans import scoring, traders

T0 = "TIMESTAMP '2001-11-10 00:00:00'"


@query("activity_summary", f"""SELECT proxy_address, username, count(*) AS trades_total, count(*) FILTER (ts >= {T0} - INTERVAL 1 DAY) AS trades_24h,
  count(*) FILTER (ts >= {T0} - INTERVAL 7 DAY) AS trades_7d, count(*) FILTER (ts >= {T0} - INTERVAL 30 DAY) AS trades_30d, r6(sum(notional)) AS volume_total,
  r6(coalesce(sum(notional) FILTER (ts >= {T0} - INTERVAL 1 DAY), 0)) AS volume_24h, r6(coalesce(sum(notional) FILTER (ts >= {T0} - INTERVAL 7 DAY), 0)) AS volume_7d,
  count(DISTINCT market_slug) AS unique_markets, min(ts) AS first_trade, max(ts) AS last_trade FROM v_trades GROUP BY ALL""")
def activity_summary(t: Tables):
    return rounded(traders.activity_summary(t.trades(), as_of()))


@query("daily_stats", """SELECT CAST(ts AS DATE) AS bucket, count(*) AS trade_count, count(DISTINCT proxy_address) AS unique_traders,
  r6(sum(notional)) AS total_volume, count(DISTINCT market_slug) AS unique_markets FROM v_trades GROUP BY 1""")
def daily_stats(t: Tables):
    return rounded(traders.platform_stats(t.trades(), F.to_date("ts")))


@query("hourly_stats", """SELECT date_trunc('hour', ts) AS bucket, count(*) AS trade_count, count(DISTINCT proxy_address) AS unique_traders,
  r6(sum(notional)) AS total_volume, count(DISTINCT market_slug) AS unique_markets FROM v_trades GROUP BY 1""")
def hourly_stats(t: Tables):
    return rounded(traders.platform_stats(t.trades(), F.date_trunc("hour", "ts")))


@query("ingestion_health", f"""WITH b AS (SELECT count(*) FILTER (ts >= {T0} - INTERVAL 1 HOUR) AS trades_last_hour,
  count(*) FILTER (ts >= {T0} - INTERVAL 1 DAY) AS trades_last_24h, count(DISTINCT CASE WHEN ts >= {T0} - INTERVAL 1 DAY THEN proxy_address END) AS traders_last_24h,
  count(DISTINCT CASE WHEN ts >= {T0} - INTERVAL 1 DAY THEN market_slug END) AS markets_covered, max(ts) AS latest_trade_at FROM v_trades)
SELECT *, CAST(epoch({T0}) - epoch(latest_trade_at) AS BIGINT) AS ingestion_lag_seconds, round(trades_last_24h/24.0::DOUBLE, 1) AS avg_trades_per_hour,
  CASE WHEN epoch({T0}) - epoch(latest_trade_at) > 900 OR trades_last_hour = 0 THEN 'unhealthy'
       WHEN epoch({T0}) - epoch(latest_trade_at) > 300 OR (trades_last_hour < trades_last_24h/48.0 AND trades_last_24h > 0) THEN 'degraded' ELSE 'healthy' END AS status,
  CASE WHEN epoch({T0}) - epoch(latest_trade_at) <= 60 THEN 'fresh' WHEN epoch({T0}) - epoch(latest_trade_at) <= 300 THEN 'recent'
       WHEN epoch({T0}) - epoch(latest_trade_at) <= 900 THEN 'stale' ELSE 'very_stale' END AS freshness FROM b""")
def ingestion_health(t: Tables):
    return traders.ingestion_health(t.trades(), as_of())


_POS = """pp AS (SELECT p.*, r.resolution_time, CASE WHEN p.outcome_index = r.winning_outcome_index THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS settlement_price,
  CASE WHEN p.outcome_index = r.winning_outcome_index THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END*net_shares - net_cost AS realized_pnl
  FROM (SELECT proxy_address, username, condition_id, market_slug, outcome, outcome_index, sum(CASE side WHEN 'BUY' THEN size ELSE -size END) AS net_shares,
    sum(CASE side WHEN 'BUY' THEN notional ELSE -notional END) AS net_cost,
    coalesce(sum(notional) FILTER (side = 'BUY')/nullif(sum(size) FILTER (side = 'BUY'), 0), 0) AS avg_entry_price,
    count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side = 'SELL') AS sell_count, min(ts) AS first_trade_at, max(ts) AS last_trade_at
    FROM v_trades GROUP BY ALL) p JOIN v_resolutions r ON p.condition_id = r.condition_id
  WHERE abs(net_shares) > 0.001 OR abs(net_cost) > 0.01)"""
_TPNL = f"""{_POS}, tp AS (SELECT proxy_address, max(username) AS username, sum(realized_pnl) AS total_realized_pnl, count(*) AS total_positions_closed,
  count(*) FILTER (round(realized_pnl, 9) > 0) AS winning_positions, count(*) FILTER (round(realized_pnl, 9) < 0) AS losing_positions,
  count(*) FILTER (round(realized_pnl, 9) > 0)/count(*) AS win_rate FROM pp GROUP BY proxy_address)"""


def _positions(t: Tables):
    return traders.position_pnl(t.trades(), t.resolutions())


def _pnl(t: Tables):
    return traders.trader_pnl(_positions(t))


@query("position_pnl", f"""WITH {_POS} SELECT proxy_address, username, condition_id, market_slug, outcome, outcome_index, r6(net_shares) AS net_shares,
  r6(net_cost) AS net_cost, r6(avg_entry_price) AS avg_entry_price, settlement_price + 0.0 AS settlement_price, r6(realized_pnl) AS realized_pnl, buy_count, sell_count,
  first_trade_at, last_trade_at, resolution_time FROM pp""")
def position_pnl(t: Tables):
    return rounded(_positions(t))


@query("trader_pnl", f"""WITH {_TPNL} SELECT proxy_address, username, r6(total_realized_pnl) AS total_realized_pnl, total_positions_closed, winning_positions,
  losing_positions, r6(win_rate) AS win_rate FROM tp""")
def trader_pnl(t: Tables):
    return rounded(_pnl(t))


@query("pnl_summary", f"""WITH {_TPNL} SELECT count(*) AS total_traders, r6(sum(total_realized_pnl)) AS total_pnl, r6(avg(total_realized_pnl)) AS avg_pnl,
  count(*) FILTER (round(total_realized_pnl, 9) > 0) AS profitable_traders, count(*) FILTER (round(total_realized_pnl, 9) < 0) AS losing_traders,
  r6(avg(win_rate)) AS avg_win_rate FROM tp""")
def pnl_summary(t: Tables):
    return rounded(traders.pnl_summary(_pnl(t)))


@query("pnl_top_traders", f"""WITH {_TPNL} SELECT proxy_address, r6(total_realized_pnl) AS total_realized_pnl, total_positions_closed, r6(win_rate) AS win_rate
FROM tp ORDER BY tp.total_realized_pnl DESC, proxy_address LIMIT 20""")
def pnl_top_traders(t: Tables):
    return rounded(traders.top_traders(_pnl(t)).select("proxy_address", "total_realized_pnl", "total_positions_closed", "win_rate"))


@query("resolution_stats", """SELECT count(*) AS total_markets, count(*) FILTER (outcome_prices[1] <> 0.5) AS resolved_markets,
  count(*) FILTER (outcome_prices[1] = 1) AS yes_winners, count(*) FILTER (outcome_prices[1] = 0) AS no_winners FROM v_markets""")
def resolution_stats(t: Tables):
    return traders.resolution_stats(t.markets(), C.is_resolved(), C.resolved_outcome())


_METRICS = f"""{_TPNL}, met AS (SELECT g.*, coalesce(tp.total_realized_pnl, 0) AS total_pnl FROM (SELECT proxy_address, username, count(*) AS total_trades,
  sum(notional) AS total_volume_usd, count(DISTINCT market_slug) AS unique_markets, min(ts) AS first_trade_at, max(ts) AS last_trade_at,
  CAST(datediff('day', min(ts), max(ts)) + 1 AS INTEGER) AS days_active, count(*) FILTER (side = 'BUY') AS buy_count, count(*) FILTER (side = 'SELL') AS sell_count,
  avg(notional) AS avg_trade_size, avg(price) AS avg_price FROM v_trades GROUP BY ALL HAVING count(*) >= 10) g LEFT JOIN tp ON tp.proxy_address = g.proxy_address)"""
_INDICATORS = """ind AS (SELECT proxy_address, count(*) FILTER (outcomes >= 2)/count(*) AS complete_set_ratio,
  coalesce(sum(first_buys)/nullif(sum(buys), 0), 0.5) AS direction_bias FROM (SELECT proxy_address, condition_id, count(DISTINCT outcome_index) AS outcomes,
    count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'BUY' AND outcome_index = 0) AS first_buys FROM v_trades GROUP BY ALL) GROUP BY proxy_address)"""


@query("trader_metrics", f"""WITH {_METRICS} SELECT proxy_address, username, total_trades, r6(total_volume_usd) AS total_volume_usd, unique_markets, first_trade_at,
  last_trade_at, days_active, buy_count, sell_count, r6(avg_trade_size) AS avg_trade_size, r6(avg_price) AS avg_price, r6(total_pnl) AS total_pnl FROM met""")
def trader_metrics(t: Tables):
    return rounded(traders.trader_metrics(t.trades(), _pnl(t)))


@query("strategy_indicators", f"WITH {_INDICATORS} SELECT proxy_address, r6(complete_set_ratio) AS complete_set_ratio, r6(direction_bias) AS direction_bias FROM ind")
def strategy_indicators(t: Tables):
    return rounded(traders.strategy_indicators(t.trades()))


def _ladder_sql(v: str, steps, rest: str, op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {v} {op} {b} THEN {r}" for b, r in steps) + f" ELSE {rest} END"


_SCORE = f"""{_METRICS}, {_INDICATORS},
peers AS (SELECT proxy_address, (rank() OVER (ORDER BY total_pnl) - 1)/count(*) OVER () AS share, count(*) OVER () AS np FROM met WHERE total_pnl <> 0),
j AS (SELECT met.*, coalesce(ind.complete_set_ratio, 0) AS csr, coalesce(ind.direction_bias, 0.5) AS bias,
  CASE WHEN (SELECT count(*) FROM peers) > 10 THEN peers.share*100 END AS pct FROM met LEFT JOIN ind USING (proxy_address) LEFT JOIN peers USING (proxy_address)),
k AS (SELECT *, least(100.0::DOUBLE, csr*100 + CASE WHEN total_trades > 500 THEN 20 ELSE 0 END) AS arb,
  least(100.0::DOUBLE, (1 - abs(0.5 - buy_count/(buy_count + sell_count))*2)*50 + CASE WHEN total_trades > 500 THEN 30 ELSE 0 END) AS mm,
  least(100.0::DOUBLE, abs(bias - 0.5)*100 + CASE WHEN unique_markets < 50 THEN 30 ELSE 0 END) AS dirs FROM j),
s AS (SELECT *, greatest(arb, mm, dirs) AS s1, arb + mm + dirs - greatest(arb, mm, dirs) - least(arb, mm, dirs) AS s2,
  CASE WHEN total_pnl <= 0 THEN greatest(0.0::DOUBLE, 20 + total_pnl/100) ELSE coalesce(least(pct, 95.0::DOUBLE), {_ladder_sql("total_pnl", scoring.PNL_LADDER, "35 + total_pnl/1000*10")}) END AS prof,
  least(100.0::DOUBLE, 50 + CASE WHEN avg_trade_size <= 0 THEN 0 WHEN avg_trade_size <= 100 THEN 20 WHEN avg_trade_size <= 500 THEN 15 WHEN avg_trade_size <= 1000 THEN 10 ELSE 5 END
    + {_ladder_sql("unique_markets", scoring.MARKET_RISK_LADDER, "10.0::DOUBLE")}) AS rsk,
  CASE WHEN total_trades < 50 THEN total_trades/50*30 ELSE least(100.0::DOUBLE, {_ladder_sql("total_trades/days_active", scoring.TRADE_RATE_LADDER, "10.0::DOUBLE")}
    + least(buy_count, sell_count)/((buy_count + sell_count)/2)*35 + {_ladder_sql("days_active", scoring.DAYS_CONSISTENCY_LADDER, "days_active/30*20")}) END AS con,
  least(100.0::DOUBLE, {_ladder_sql("days_active", scoring.DAYS_RECORD_LADDER, "days_active/30*15")} + {_ladder_sql("total_volume_usd", scoring.VOLUME_LADDER, "5.0::DOUBLE")}
    + {_ladder_sql("unique_markets", scoring.MARKET_RECORD_LADDER, "5.0::DOUBLE")}) AS trk FROM k),
st AS (SELECT *, CASE WHEN round(s1 - s2, 9) < 15 THEN 'HYBRID' WHEN s1 < 30 THEN 'UNKNOWN' WHEN s1 = arb THEN 'ARBITRAGEUR' WHEN s1 = mm THEN 'MARKET_MAKER'
  ELSE 'DIRECTIONAL_MOMENTUM' END AS strategy_type, CASE WHEN round(s1 - s2, 9) < 15 THEN s1*0.7 ELSE s1 END AS strategy_confidence FROM s),
adj AS (SELECT *, CASE WHEN strategy_type = 'ARBITRAGEUR' THEN CASE WHEN con < 70 THEN con*0.8 ELSE least(100.0::DOUBLE, con*1.1) END ELSE con END AS con2,
  CASE WHEN strategy_type = 'DIRECTIONAL_MOMENTUM' AND prof > 60 THEN least(100.0::DOUBLE, prof*1.1) ELSE prof END AS prof2 FROM st),
sc AS (SELECT *, CAST(greatest(0, least(100, round_even(round(prof2*0.4 + rsk*0.3 + con2*0.2 + trk*0.1, 9), 0))) AS INTEGER) AS total_score FROM adj)"""


def _scored(t: Tables):
    """Trades are narrowed and written once; PnL, metrics and indicators read that."""
    trades = checkpointed(t.trades().select("proxy_address", "username", "condition_id", "market_slug", "outcome", "outcome_index", "side", "price", "size", "notional", "ts"))
    metrics = checkpointed(traders.trader_metrics(trades, traders.trader_pnl(traders.position_pnl(trades, t.resolutions())), limit=None))
    return scoring.smart_money_score(metrics, traders.strategy_indicators(trades))


@query("smart_money_score", f"""WITH {_SCORE} SELECT proxy_address, total_score, CASE WHEN total_score >= 80 THEN 'DIAMOND' WHEN total_score >= 60 THEN 'GOLD'
  WHEN total_score >= 40 THEN 'SILVER' ELSE 'BRONZE' END AS tier, r6(prof2) AS profitability_score, r6(rsk) AS risk_adjusted_score, r6(con2) AS consistency_score,
  r6(trk) AS track_record_score FROM sc""")
def smart_money_score(t: Tables):
    return rounded(_scored(t).select("proxy_address", "total_score", "tier", "profitability_score", "risk_adjusted_score",
                                     "consistency_score", "track_record_score"))


@query("strategy_classify", f"WITH {_SCORE} SELECT proxy_address, strategy_type, r6(strategy_confidence) AS strategy_confidence FROM st")
def strategy_classify(t: Tables):
    joined = traders.trader_metrics(t.trades(), _pnl(t), limit=None).join(traders.strategy_indicators(t.trades()), "proxy_address", "left")
    return rounded(scoring.strategy_classify(joined).select("proxy_address", "strategy_type", "strategy_confidence"))


@query("score_tier", f"""WITH {_SCORE} SELECT CASE WHEN total_score >= 80 THEN 'DIAMOND' WHEN total_score >= 60 THEN 'GOLD' WHEN total_score >= 40 THEN 'SILVER'
  ELSE 'BRONZE' END AS tier, CASE WHEN total_trades >= 50 THEN 'good' ELSE 'limited' END AS data_quality, count(*) AS traders FROM sc GROUP BY 1, 2""")
def score_tier(t: Tables):
    return _scored(t).groupBy("tier", "data_quality").agg(F.count(F.lit(1)).alias("traders"))


@query("score_rank", """SELECT proxy_address, total_score, row_number() OVER (ORDER BY total_score DESC, proxy_address) AS rank FROM v_scores""")
def score_rank(t: Tables):
    rows = t.scores().select("proxy_address", "total_score")
    return ranked(rows, "total_score", "proxy_address")


@query("daily_sharpe", f"""WITH {_POS}, d AS (SELECT proxy_address, CAST(resolution_time AS DATE) AS d, max(username) AS username, sum(realized_pnl) AS pnl FROM pp
  WHERE round(realized_pnl, 9) <> 0 GROUP BY ALL),
g AS (SELECT proxy_address, max(username) AS username, avg(pnl) AS m, stddev_pop(pnl) AS s, count(*) AS days_with_pnl, sum(pnl) AS total_pnl, min(pnl) AS worst
  FROM d GROUP BY proxy_address HAVING count(*) >= 5 AND round(stddev_pop(pnl), 9) > 0)
SELECT proxy_address, username, r4(m) AS mean_daily_pnl, r4(s) AS std_daily_pnl, days_with_pnl, r4(total_pnl) AS total_pnl, r4(worst) AS worst_day_pnl,
  r4(m/s*sqrt(365)) AS sharpe_ratio, r4(least(m/s*sqrt(365), 10)) AS sharpe_ratio_capped,
  r4(least(CASE WHEN m > 0 THEN abs(least(worst, 0)/m) ELSE 0 END, 1)) AS max_drawdown, r4(least(days_with_pnl/30, 1)) AS confidence FROM g""")
def daily_sharpe(t: Tables):
    return rounded(scoring.daily_sharpe(_positions(t)), 4)


# ---- leaderboards and indices ----------------------------------------------------------------

_ELIGIBLE = """el AS (SELECT s.*, coalesce(p.total_trades, 0) AS total_trades, coalesce(p.total_volume_usd, 0) AS total_volume_usd, coalesce(p.days_active, 0) AS days_active,
  coalesce(p.unique_markets, 0) AS unique_markets, p.first_trade_at, p.last_trade_at, coalesce(n.total_realized_pnl, 0) AS total_realized_pnl, coalesce(n.win_rate, 0) AS win_rate,
  coalesce(n.closed_positions, 0) AS closed_positions, m.ml_score, m.ml_tier, m.predicted_sharpe
  FROM v_scores s LEFT JOIN v_profiles p USING (proxy_address) LEFT JOIN v_trader_pnl n USING (proxy_address) LEFT JOIN v_ml_scores m USING (proxy_address))"""


def eligible(t: Tables):
    return traders.eligible_traders(t.scores(), t.profiles(), t.trader_pnl(), t.ml_scores())


@query("eligible_traders", f"""WITH {_ELIGIBLE} SELECT proxy_address, username, total_score, strategy_type, total_trades, r6(total_volume_usd) AS total_volume_usd, days_active,
  unique_markets, r6(total_realized_pnl) AS total_realized_pnl, r6(win_rate) AS win_rate, closed_positions, r6(sharpe_ratio) AS sharpe_ratio FROM el""")
def eligible_traders(t: Tables):
    return rounded(eligible(t).select("proxy_address", "username", "total_score", "strategy_type", "total_trades", "total_volume_usd", "days_active",
                                      "unique_markets", "total_realized_pnl", "win_rate", "closed_positions", "sharpe_ratio"))


@query("leaderboard", """SELECT proxy_address, s.username, s.total_score, s.tier, r6(p.total_volume_usd) AS total_volume_usd, p.total_trades
FROM v_scores s LEFT JOIN v_profiles p USING (proxy_address)""")
def leaderboard(t: Tables):
    return rounded(traders.leaderboard(t.scores(), t.profiles()).select(
        "proxy_address", "username", "total_score", "tier", "total_volume_usd", "total_trades"))


@query("leaderboard_pnl", """SELECT proxy_address, s.total_score, r6(coalesce(n.total_realized_pnl, 0)) AS realized_pnl, r6(coalesce(n.win_rate, 0)) AS win_rate,
  coalesce(n.closed_positions, 0) AS closed_positions FROM v_scores s LEFT JOIN v_profiles p USING (proxy_address) LEFT JOIN v_trader_pnl n USING (proxy_address)""")
def leaderboard_pnl(t: Tables):
    return rounded(traders.leaderboard_pnl(t.scores(), t.profiles(), t.trader_pnl()).select(
        "proxy_address", "total_score", "realized_pnl", "win_rate", "closed_positions"))


@query("leaderboard_ml", """SELECT proxy_address, r6(coalesce(m.ml_score, s.total_score)) AS smart_money_score, coalesce(m.ml_tier, s.tier) AS tier,
  r6(coalesce(m.predicted_sharpe, 0)) AS predicted_sharpe, coalesce(m.model_version, 'rule-based') AS model_version
FROM v_scores s LEFT JOIN v_ml_scores m USING (proxy_address)""")
def leaderboard_ml(t: Tables):
    return rounded(traders.leaderboard_ml(t.scores(), t.profiles(), t.ml_scores()).select(
        "proxy_address", "smart_money_score", "tier", "predicted_sharpe", "model_version"))


@query("leaderboard_page", """SELECT proxy_address, total_score, tier FROM v_scores ORDER BY total_score DESC, proxy_address LIMIT 25 OFFSET 50""")
def leaderboard_page(t: Tables):
    rows = t.scores().select("proxy_address", "total_score", "tier")
    return traders.page(rows, [F.desc("total_score"), F.asc("proxy_address")], 25, 50)


@query("traders_enriched", """SELECT proxy_address, s.username, s.total_score, s.tier, s.strategy_type, m.cluster_id, r6(m.anomaly_score) AS anomaly_score,
  coalesce(m.anomaly_score >= 0.9, FALSE) AS is_anomaly, r6(p.total_volume_usd) AS total_volume_usd
FROM v_scores s LEFT JOIN v_profiles p USING (proxy_address) LEFT JOIN v_ml_scores m USING (proxy_address)""")
def traders_enriched(t: Tables):
    out = traders.leaderboard(t.scores(), t.profiles()).join(
        t.ml_scores().select("proxy_address", "cluster_id", "anomaly_score"), "proxy_address", "left")
    return rounded(out.withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") >= 0.9, F.lit(False))).select(
        "proxy_address", "username", "total_score", "tier", "strategy_type", "cluster_id", "anomaly_score", "is_anomaly", "total_volume_usd"))


def _index_sql(c: scoring.IndexConfig) -> str:
    where = [f"total_score >= {c.min_score}", f"total_trades >= {c.min_trades}", f"days_active >= {c.min_days}",
             f"total_volume_usd >= {c.min_volume}", f"sharpe_ratio >= {c.min_sharpe}"]
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    if c.allowed:
        where.append(f"strategy_type IN ('UNKNOWN', {names(c.allowed)})")
    if c.excluded:
        where.append(f"strategy_type NOT IN ({names(c.excluded)})")
    if c.categories:
        where.append(f"proxy_address IN (SELECT proxy_address FROM dist WHERE category IN ({names(c.categories)}) GROUP BY 1 HAVING sum(concentration) >= {c.min_category_share})")
    raw = {"EQUAL": "1.0::DOUBLE/count(*) OVER ()",
           "SHARPE": f"least(coalesce(greatest(0, sharpe_ratio)/nullif(sum(greatest(0, sharpe_ratio)) OVER (), 0), 0), {c.max_weight})",
           "SCORE": f"least(total_score/sum(total_score) OVER (), {c.max_weight})"}[c.weighting]
    return f"""SELECT '{c.name}' AS index_type, proxy_address, username, r6(raw/sum(raw) OVER ()) AS weight, total_score, r6(sharpe_ratio) AS sharpe_ratio, strategy_type, index_rank
FROM (SELECT *, {raw} AS raw FROM (SELECT *, CAST(row_number() OVER (ORDER BY total_score DESC, proxy_address) AS INTEGER) AS index_rank FROM el
  WHERE {' AND '.join(where)} ORDER BY total_score DESC, proxy_address LIMIT {c.size}))"""


_CLASSES = """cls AS (SELECT market_slug, CASE WHEN market_slug LIKE 'btc%' OR market_slug LIKE 'eth%' THEN 'CRYPTO' WHEN market_slug LIKE 'topic-1%' THEN 'POLITICS'
  WHEN market_slug LIKE 'topic-2%' THEN 'NEWS' ELSE NULL END AS category FROM (SELECT DISTINCT market_slug FROM v_trades))"""
_DIST = f"""{_CLASSES}, dist AS (SELECT *, volume/sum(volume) OVER (PARTITION BY proxy_address) AS concentration FROM (SELECT t.proxy_address, t.username,
  coalesce(c.category, 'OTHER') AS category, sum(notional) AS volume, count(*) AS trade_count FROM v_trades t LEFT JOIN cls c USING (market_slug) GROUP BY ALL))"""


def classes(t: Tables):
    s = F.col("market_slug")
    category = F.when(s.startswith("btc") | s.startswith("eth"), "CRYPTO").when(s.startswith("topic-1"), "POLITICS").when(
        s.startswith("topic-2"), "NEWS")
    return t.trades().select("market_slug").distinct().withColumn("category", category).filter("category IS NOT NULL")


CATALOG_INDICES = tuple(c if c.name != "NEWS" else scoring.IndexConfig(**{**c.__dict__, "min_category_share": 0.2}) for c in scoring.DEFAULT_INDICES)


@query("index_build", f"WITH {_ELIGIBLE}, {_DIST}\n" + "\nUNION ALL\n".join(f"SELECT * FROM ({_index_sql(c)})" for c in CATALOG_INDICES))
def index_build(t: Tables):
    inputs = scoring.IndexInputs(eligible(t), categories=traders.category_distribution(t.trades(), classes(t)))
    return rounded(scoring.index_build_all(inputs, CATALOG_INDICES))


@query("index_build_cluster", f"""WITH {_ELIGIBLE}, top AS (SELECT el.*, coalesce('c' || m.cluster_id, 'UNKNOWN') AS cl FROM el LEFT JOIN v_ml_scores m USING (proxy_address)
  WHERE el.total_score >= 40 AND total_trades >= 5 AND days_active >= 1 AND total_volume_usd >= 500 AND sharpe_ratio >= 0 ORDER BY el.total_score DESC, proxy_address LIMIT 30)
SELECT 'BALANCED' AS index_type, proxy_address, username, r6(raw/sum(raw) OVER ()) AS weight FROM (SELECT *,
  least(total_score/sum(total_score) OVER (PARTITION BY cl)/(SELECT count(DISTINCT cl) FROM top), 0.2) AS raw FROM top)""")
def index_build_cluster(t: Tables):
    clusters = t.ml_scores().select("proxy_address", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("strategy_cluster"))
    config = scoring.IndexConfig("BALANCED", 30, "CLUSTER", 40, 5, 1, 500)
    return rounded(scoring.index_build(scoring.IndexInputs(eligible(t), clusters=clusters), config).select(
        "index_type", "proxy_address", "username", "weight"))


@query("index_rebalance_diff", """WITH h AS (SELECT proxy_address, arg_max(total_score, version) AS total_score FROM v_score_history
  WHERE calculated_at < TIMESTAMP '2001-10-15' GROUP BY 1),
o AS (SELECT proxy_address FROM h ORDER BY total_score DESC, proxy_address LIMIT 25), n AS (SELECT proxy_address FROM v_scores ORDER BY total_score DESC, proxy_address LIMIT 25)
SELECT 'TOP_25' AS index_type, proxy_address, 'ADD' AS change FROM n WHERE proxy_address NOT IN (SELECT proxy_address FROM o)
UNION ALL SELECT 'TOP_25', proxy_address, 'REMOVE' FROM o WHERE proxy_address NOT IN (SELECT proxy_address FROM n)""")
def index_rebalance_diff(t: Tables):
    order = [F.desc("total_score"), F.asc("proxy_address")]
    old = latest_per_key(t.score_history().filter("calculated_at < '2001-10-15'"), ["proxy_address"], ["version"])
    members = lambda s: s.orderBy(*order).limit(25).withColumn("index_type", F.lit("TOP_25"))
    return scoring.index_rebalance_diff(members(old), members(t.scores()))


@query("index_rank", f"""WITH {_ELIGIBLE} SELECT proxy_address, r6(w) AS weight, row_number() OVER (ORDER BY w DESC, proxy_address) AS index_rank
FROM (SELECT *, total_score/100.0::DOUBLE AS w FROM el)""")
def index_rank(t: Tables):
    rows = eligible(t).select("proxy_address", (F.col("total_score") / F.lit(100.0)).alias("weight"))
    return rounded(ranked(rows, "weight", "proxy_address", "index_rank"))


# ---- categories ------------------------------------------------------------------------------


@query("category_distribution", f"""WITH {_DIST} SELECT proxy_address, username, category, r6(volume) AS volume, trade_count, r6(concentration) AS concentration FROM dist""")
def category_distribution(t: Tables):
    return rounded(traders.category_distribution(t.trades(), classes(t)))


@query("share_of_total", f"""WITH {_DIST} SELECT category, r6(sum(volume)) AS volume, r6(avg(concentration)) AS avg_concentration, r6(max(concentration)) AS max_concentration FROM dist GROUP BY 1""")
def share_of_total(t: Tables):
    d = traders.category_distribution(t.trades(), classes(t))
    return rounded(d.groupBy("category").agg(F.sum("volume").alias("volume"), F.avg("concentration").alias("avg_concentration"),
                                             F.max("concentration").alias("max_concentration")))


@query("category_profiles", f"""WITH {_DIST} SELECT proxy_address, string_agg(category || '=' || printf('%.4f', concentration), ';' ORDER BY category) AS profile FROM dist GROUP BY 1""")
def category_profiles(t: Tables):
    p = traders.category_profiles(traders.category_distribution(t.trades(), classes(t)))
    text = F.transform(F.map_entries("profile"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return p.select("proxy_address", F.array_join(text, ";").alias("profile"))


@query("category_concentration_filter", f"""WITH {_DIST} SELECT proxy_address, r6(sum(concentration)) AS category_concentration FROM dist WHERE category IN ('NEWS', 'POLITICS')
GROUP BY 1 HAVING sum(concentration) >= 0.25""")
def category_concentration_filter(t: Tables):
    return rounded(traders.concentrated_in(traders.category_distribution(t.trades(), classes(t)), ["NEWS", "POLITICS"], 0.25))


@query("category_stats", f"""WITH {_CLASSES} SELECT coalesce(category, 'UNCLASSIFIED') AS category, count(*) AS trade_count, count(DISTINCT proxy_address) AS unique_traders,
  count(DISTINCT market_slug) AS unique_markets, r6(sum(notional)) AS total_volume, min(ts) AS first_trade, max(ts) AS last_trade FROM v_trades LEFT JOIN cls USING (market_slug) GROUP BY 1""")
def category_stats(t: Tables):
    return rounded(traders.category_stats(t.trades(), classes(t)))


# Test-only vocabulary over part names; a job passes its own patterns.
PART_PATTERNS = {"TOOLS": ["widget", "gear", r"\bbolt\b"], "METAL": [r"ring\b", "steel", "copper"], "COLOUR": ["red", "blue", "small", "large"]}


def _hits(ps):
    return " + ".join(f"CAST(regexp_matches(txt, '{p}') AS INTEGER)" for p in ps)


@query("market_category_classify", f"""WITH p AS (SELECT DISTINCT replace(p_name, ' ', '-') AS market_slug FROM part), x AS (SELECT market_slug, replace(market_slug, '-', ' ') || ' ' AS txt FROM p),
h AS (SELECT market_slug, {_hits(PART_PATTERNS['TOOLS'])} AS a, {_hits(PART_PATTERNS['METAL'])} AS b, {_hits(PART_PATTERNS['COLOUR'])} AS c FROM x)
SELECT market_slug, CASE WHEN greatest(a, b, c) = 0 THEN 'OTHER' WHEN a >= b AND a >= c THEN 'TOOLS' WHEN b >= c THEN 'METAL' ELSE 'COLOUR' END AS category,
  least(1.0::DOUBLE, greatest(a, b, c)*0.25) AS confidence FROM h""")
def market_category_classify(t: Tables):
    markets = t.read("part").select(F.regexp_replace("p_name", " ", "-").alias("market_slug"))
    return traders.classify_markets(markets, PART_PATTERNS).select("market_slug", "category", "confidence")


# ---- clusters, tiers -------------------------------------------------------------------------


@query("cluster_summary", """SELECT cluster_id, count(*) AS trader_count, count(*) FILTER (anomaly_score >= 0.9) AS anomaly_count, r6(avg(anomaly_score)) AS avg_anomaly_score FROM v_ml_scores GROUP BY 1""")
def cluster_summary(t: Tables):
    return rounded(traders.cluster_summary(t.ml_scores()))


@query("cluster_performance", """SELECT cluster_id, count(*) AS trader_count, r6(avg(total_realized_pnl)) AS avg_pnl, r6(sum(total_realized_pnl)) AS total_pnl,
  r6(avg(total_score)) AS avg_smart_money_score, r6(avg(total_volume_usd)) AS avg_volume, count(*) FILTER (total_realized_pnl > 0) AS profitable_traders,
  r6(count(*) FILTER (total_realized_pnl > 0)/count(*)) AS profitable_ratio
FROM v_ml_scores m LEFT JOIN v_profiles USING (proxy_address) LEFT JOIN v_scores USING (proxy_address) LEFT JOIN v_trader_pnl USING (proxy_address) GROUP BY 1""")
def cluster_performance(t: Tables):
    return rounded(traders.cluster_performance(t.ml_scores(), t.profiles(), t.scores(), t.trader_pnl()))


@query("replicability", """WITH c AS (SELECT strategy_type, count(*) AS n FROM v_scores GROUP BY 1)
SELECT strategy_type NOT IN ('ARBITRAGEUR', 'MARKET_MAKER', 'SCALPER') AS is_replicable, count(*) AS cluster_count, CAST(sum(n) AS BIGINT) AS total_traders,
  string_agg(strategy_type, ', ' ORDER BY strategy_type) AS strategy_types FROM c GROUP BY 1""")
def replicability(t: Tables):
    c = t.scores().groupBy("strategy_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_replicable", ~F.col("strategy_type").isin(*scoring.NOT_COPYABLE))
    return traders.replicability(c, "is_replicable", "strategy_type", "n")


@query("tier_distribution", """WITH tiers AS (SELECT * FROM (VALUES (1, 'DIAMOND'), (2, 'GOLD'), (3, 'SILVER'), (4, 'BRONZE')) v(tier_order, tier))
SELECT tier_order, tier, count(proxy_address) AS trader_count, r6(avg(total_score)) AS avg_score, r6(count(proxy_address)*100.0/(SELECT count(*) FROM v_scores)) AS percentage
FROM tiers LEFT JOIN v_scores USING (tier) GROUP BY 1, 2""")
def tier_distribution(t: Tables):
    return rounded(traders.tier_distribution(t.scores()))


@query("ml_health", f"""WITH b AS (SELECT count(*) AS scored_traders, count(m.proxy_address) AS enriched_traders, max(calculated_at) AS last_scored_at
  FROM v_scores s LEFT JOIN v_ml_scores m ON s.proxy_address = m.proxy_address)
SELECT *, r6(enriched_traders/scored_traders) AS coverage, r6((epoch({T0}) - epoch(last_scored_at))/3600) AS hours_since_scoring,
  CASE WHEN (epoch({T0}) - epoch(last_scored_at))/3600 <= 24 THEN 'fresh' WHEN (epoch({T0}) - epoch(last_scored_at))/3600 <= 72 THEN 'stale' ELSE 'outdated' END AS freshness FROM b""")
def ml_health(t: Tables):
    return rounded(traders.ml_health(t.scores(), t.ml_scores(), as_of()))


@query("recent_activity", """SELECT event_key, t.proxy_address, ts, market_slug, side, r6(notional) AS notional, s.total_score, s.tier FROM v_trades t JOIN v_scores s USING (proxy_address)
WHERE s.total_score >= 80 ORDER BY ts DESC, event_key LIMIT 100""")
def recent_activity(t: Tables):
    return rounded(traders.recent_activity(t.trades(), t.scores(), 80, 100).select(
        "event_key", "proxy_address", "ts", "market_slug", "side", "notional", "total_score", "tier"))


# ---- key sets --------------------------------------------------------------------------------


@query("semi_join_filter", "SELECT event_key, username, market_slug, ts FROM v_trades WHERE proxy_address IN (SELECT proxy_address FROM v_scores WHERE total_score >= 70)")
def semi_join_filter(t: Tables):
    return keysets.only_keys(t.trades(), t.scores().filter("total_score >= 70"), ["proxy_address"]).select("event_key", "username", "market_slug", "ts")


@query("anti_join_unclassified", f"WITH {_CLASSES} SELECT DISTINCT market_slug FROM v_trades WHERE market_slug NOT IN (SELECT market_slug FROM cls WHERE category IS NOT NULL)")
def anti_join_unclassified(t: Tables):
    return keysets.without_keys(t.trades().select("market_slug").distinct(), classes(t), ["market_slug"])


@query("pending_resolution_keys", "SELECT DISTINCT condition_id FROM v_trades WHERE condition_id NOT IN (SELECT condition_id FROM v_resolutions)")
def pending_resolution_keys(t: Tables):
    return keysets.without_keys(t.trades().select("condition_id").distinct(), t.resolutions(), ["condition_id"])


@query("missing_receipt_backlog", """SELECT transaction_hash, max(ts) AS last_seen FROM v_trades WHERE transaction_hash IS NOT NULL
  AND transaction_hash NOT IN (SELECT '0xT' || o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 ORDER BY last_seen DESC, transaction_hash LIMIT 200""")
def missing_receipt_backlog(t: Tables):
    known = t.read("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("0xT"), F.col("o_orderkey").cast("string")).alias("transaction_hash"))
    return keysets.newest_missing(t.trades(), known, "transaction_hash", "ts", 200)


@query("cross_join_benchmarks", """WITH b AS (SELECT avg(total_score) AS avg_score, avg(sharpe_ratio) AS avg_sharpe FROM v_scores)
SELECT proxy_address, total_score, r6(avg_score) AS avg_score, r6(total_score/avg_score) AS score_vs_avg, r6(sharpe_ratio - avg_sharpe) AS sharpe_gap FROM v_scores CROSS JOIN b""")
def cross_join_benchmarks(t: Tables):
    s = t.scores()
    out = keysets.with_benchmark(s, s.agg(F.avg("total_score").alias("avg_score"), F.avg("sharpe_ratio").alias("avg_sharpe")))
    return rounded(out.select("proxy_address", "total_score", "avg_score", (F.col("total_score") / F.col("avg_score")).alias("score_vs_avg"),
                              (F.col("sharpe_ratio") - F.col("avg_sharpe")).alias("sharpe_gap")))


@query("fund_nav_latest", """WITH n AS (SELECT strategy_type AS fund_type, calculated_at, proxy_address, total_score FROM v_score_history)
SELECT * FROM n WHERE (fund_type, calculated_at) IN (SELECT fund_type, max(calculated_at) FROM n GROUP BY 1)""")
def fund_nav_latest(t: Tables):
    n = t.score_history().select(F.col("strategy_type").alias("fund_type"), "calculated_at", "proxy_address", "total_score")
    return latest_ties(n, ["fund_type"], "calculated_at").select("fund_type", "calculated_at", "proxy_address", "total_score")


@query("latest_model_rows", """SELECT proxy_address, ml_score, model_version FROM v_ml_scores WHERE model_version = (SELECT model_version FROM v_ml_scores ORDER BY version DESC LIMIT 1)""")
def latest_model_rows(t: Tables):
    ml = t.ml_scores()
    newest = ml.agg(F.max_by("model_version", "version").alias("v"))
    return ml.filter(F.col("model_version") == newest.scalar()).select("proxy_address", "ml_score", "model_version")
