"""Discovery screens, consensus, suspicious flow, edge decay, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.q_reports import rounded
from tradelens.catalog.q_traders import _ELIGIBLE, T0, eligible
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables, as_of
from tradelens.functions.numeric import rnd
from tradelens.plans import discovery, edge, integrity, ledgers, markets, signals

# ---- discovery -------------------------------------------------------------------------------

_SCREEN = f"""{_ELIGIBLE}, scr AS (SELECT *, percent_rank() OVER (ORDER BY sharpe_ratio) AS sp, percent_rank() OVER (ORDER BY win_rate) AS wp,
  percent_rank() OVER (ORDER BY total_realized_pnl) AS pp, percent_rank() OVER (ORDER BY round(total_volume_usd, 6) DESC) AS vp
  FROM el WHERE sharpe_ratio >= 1.5 AND total_volume_usd <= 50000 AND total_trades >= 30)"""


@query("percentile_screens", f"WITH {_SCREEN} SELECT proxy_address, r6(sp) AS sharpe_percentile, r6(wp) AS winrate_percentile, r6(pp) AS pnl_percentile, r6(vp) AS visibility_percentile FROM scr")
def percentile_screens(t: Tables):
    return rounded(discovery.percentile_screens(eligible(t)).select(
        "proxy_address", "sharpe_percentile", "winrate_percentile", "pnl_percentile", "visibility_percentile"))


@query("hidden_gems", f"""WITH {_SCREEN} SELECT proxy_address, r6((sp + wp + pp)/3 - (1 - vp)) AS composite, r6(least(100, (1 - vp)*100)) AS visibility_score, r6(sp*40 + wp*30 + pp*30) AS quality_score,
  r6(least(100, least(50, sharpe_ratio*20) + 50 - least(100, (1 - vp)*100)/2)) AS discovery_score, r6(least(0.9, 0.5 + total_trades/greatest(1, days_active)*0.05 + win_rate*0.2)) AS edge_persistence
FROM scr WHERE (sp >= 0.7 OR wp >= 0.7 OR pp >= 0.7) AND vp >= 0.5 ORDER BY round((sp + wp + pp)/3 - (1 - vp), 9) DESC, proxy_address LIMIT 50""")
def hidden_gems(t: Tables):
    return rounded(discovery.hidden_gems(discovery.percentile_screens(eligible(t))).select(
        "proxy_address", "composite", "visibility_score", "quality_score", "discovery_score", "edge_persistence"))


_STAR = f"""{_ELIGIBLE}, b AS (SELECT avg(sharpe_ratio) AS avs, avg(win_rate) AS avw, avg(total_realized_pnl/greatest(days_active, 1)) AS avp FROM el WHERE days_active >= 2400),
st AS (SELECT *, sharpe_ratio/greatest(avs, 0.1) AS s, win_rate/greatest(avw, 0.1) AS w FROM el CROSS JOIN b WHERE days_active <= 2450 AND win_rate >= 0.5 AND sharpe_ratio >= 1.0
  AND total_trades >= 10 AND (sharpe_ratio >= avs*1.2 OR win_rate >= avw*1.1)),
sx AS (SELECT *, least(1, greatest(0, (s - 1)*0.5) + greatest(0, (w - 1)*0.5)) AS acc, least(20, (s - 1)*10 + (w - 1)*10) AS bonus FROM st)"""


@query("rising_stars", f"""WITH {_STAR} SELECT proxy_address, r6((s + w)*(1 + (2450 - days_active)/2450)) AS composite, r6(s) AS sharpe_vs_avg, r6(w) AS winrate_vs_avg,
  r6(total_realized_pnl/greatest(days_active, 1)/greatest(avp, 1)) AS pnl_vs_avg, r6(least(100, least(100, greatest(0, 30 - days_active) + win_rate*40 + sharpe_ratio*20) + bonus)) AS discovery_score,
  r6(acc) AS acceleration, r6(least(0.7, 0.3 + win_rate*0.3 + acc*0.2)) AS edge_persistence FROM sx ORDER BY round((s + w)*(1 + (2450 - days_active)/2450), 9) DESC, proxy_address LIMIT 50""")
def rising_stars(t: Tables):
    out = discovery.rising_stars(eligible(t), max_days=2450, min_win_rate=0.5, established_days=2400)
    return rounded(out.select("proxy_address", "composite", "sharpe_vs_avg", "winrate_vs_avg", "pnl_vs_avg", "discovery_score", "acceleration", "edge_persistence"))


@query("niche_specialists", f"""WITH {_ELIGIBLE} SELECT proxy_address, unique_markets, r6(sharpe_ratio) AS sharpe_ratio, r6(least(100, sharpe_ratio*30 + 40.0/greatest(1, unique_markets))) AS discovery_score
FROM el WHERE unique_markets <= 150 AND total_trades >= 20 AND sharpe_ratio >= 1 ORDER BY el.sharpe_ratio DESC, proxy_address LIMIT 50""")
def niche_specialists(t: Tables):
    return rounded(discovery.niche_specialists(eligible(t), max_markets=150).select("proxy_address", "unique_markets", "sharpe_ratio", "discovery_score"))


@query("contrarians", f"""WITH {_ELIGIBLE} SELECT proxy_address, r6(total_realized_pnl) AS total_realized_pnl, r6(least(100, sharpe_ratio*30 + log10(greatest(1, total_realized_pnl))*10)) AS discovery_score
FROM el WHERE strategy_type IN ('DIRECTIONAL_FUNDAMENTAL', 'EVENT_DRIVEN') AND total_realized_pnl > 0 AND sharpe_ratio >= 0.5 AND total_trades >= 20
ORDER BY el.total_realized_pnl DESC, proxy_address LIMIT 50""")
def contrarians(t: Tables):
    return rounded(discovery.contrarians(eligible(t)).select("proxy_address", "total_realized_pnl", "discovery_score"))


@query("discovery_lists", f"""WITH {_ELIGIBLE} SELECT * FROM (SELECT 'hidden_gem' AS list, proxy_address, total_score FROM el WHERE total_score >= 60 AND total_volume_usd < 5000 ORDER BY total_score DESC, proxy_address LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'rising_star', proxy_address, total_score FROM el WHERE days_active <= 2450 AND total_score >= 50 ORDER BY total_score DESC, proxy_address LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'niche', proxy_address, total_score FROM el WHERE unique_markets <= 150 AND total_score >= 50 ORDER BY total_score DESC, proxy_address LIMIT 20)""")
def discovery_lists(t: Tables):
    e = eligible(t)

    def top(name, cond):
        return e.filter(cond).orderBy(F.desc("total_score"), "proxy_address").limit(20).select(F.lit(name).alias("list"), "proxy_address", "total_score")

    return top("hidden_gem", "total_score >= 60 AND total_volume_usd < 5000").unionByName(
        top("rising_star", "days_active <= 2450 AND total_score >= 50")).unionByName(top("niche", "unique_markets <= 150 AND total_score >= 50"))


# ---- consensus -------------------------------------------------------------------------------

H = 24 * 400
_SINCE = f"ts >= {T0} - INTERVAL {H} HOUR"


@query("consensus_signals", f"""WITH net AS (SELECT market_slug, username, max(total_score) AS score, sum(CASE WHEN y THEN notional ELSE 0 END) AS yes, sum(CASE WHEN y THEN 0 ELSE notional END) AS no,
    sum(notional) AS volume, max(ts) AS lt FROM (SELECT t.*, s.total_score, (side = 'BUY') = (outcome = 'Up') AS y FROM v_trades t JOIN v_scores s USING (username) WHERE s.total_score >= 60 AND {_SINCE})
    GROUP BY ALL HAVING round(sum(CASE WHEN y THEN notional ELSE -notional END), 9) <> 0),
m AS (SELECT market_slug, count(*) FILTER (yes > no) AS ny, count(*) FILTER (yes < no) AS nn, coalesce(sum(volume) FILTER (yes > no), 0) AS vy, coalesce(sum(volume) FILTER (yes < no), 0) AS vn,
    coalesce(sum(score) FILTER (yes > no), 0) AS sy, coalesce(sum(score) FILTER (yes < no), 0) AS sn, coalesce(sum(volume*score) FILTER (yes > no), 0) AS wy, coalesce(sum(volume*score) FILTER (yes < no), 0) AS wn,
    max(lt) AS last_trade_at FROM net GROUP BY 1),
d AS (SELECT *, greatest(ny, nn)/(ny + nn) AS agr, CASE WHEN nn > ny THEN vn ELSE vy END AS vf, CASE WHEN nn > ny THEN vy ELSE vn END AS va,
    CASE WHEN nn > ny THEN sn/nn ELSE sy/nullif(ny, 0) END AS qs, CASE WHEN nn > ny THEN wn/vn ELSE wy/nullif(vy, 0) END AS sq FROM m WHERE ny + nn >= 3 AND vy + vn >= 20)
SELECT market_slug, CASE WHEN ny > nn THEN 'YES' WHEN nn > ny THEN 'NO' ELSE 'SPLIT' END AS direction, r6(agr) AS agreement_pct, ny + nn AS num_traders, r6(vf) AS volume_for, r6(va) AS volume_against,
  CASE WHEN agr >= 0.85 THEN 'VERY_STRONG' WHEN agr >= 0.75 THEN 'STRONG' WHEN agr >= 0.65 THEN 'MODERATE' ELSE 'WEAK' END AS strength, r6(sq) AS signal_quality,
  r6(least(100, (0.3*least(1, ln(ny + nn + 1)/ln(21)) + 0.4*vf/(vf + va) + 0.3*qs/100)*100)) AS confidence_score, r6(vf/(vf + va) - 0.5) AS implied_prob_shift, last_trade_at FROM d WHERE agr >= 0.55""")
def consensus_signals(t: Tables):
    out = signals.consensus_signals(t.trades(), t.scores(), as_of(), hours=H, min_volume=20.0)
    return rounded(out.select("market_slug", "direction", "agreement_pct", "num_traders", "volume_for", "volume_against", "strength", "signal_quality",
                              "confidence_score", "implied_prob_shift", "last_trade_at"))


@query("consensus_screen", f"""SELECT market_slug, outcome, count(DISTINCT username) AS num_traders, r6(sum(notional)) AS total_volume, r6(avg(s.total_score)) AS avg_score, max(ts) AS last_trade_at
FROM v_trades t JOIN v_scores s USING (username) WHERE side = 'BUY' AND s.total_score >= 60 AND {_SINCE} GROUP BY ALL HAVING count(DISTINCT username) >= 2""")
def consensus_screen(t: Tables):
    return rounded(signals.consensus_screen(t.trades(), t.scores(), as_of(), H, 60, 2))


# ---- suspicious flow -------------------------------------------------------------------------


@query("new_account_whale", f"""WITH bets AS (SELECT proxy_address, username, market_slug, side, sum(notional) AS bet FROM v_trades WHERE {_SINCE} GROUP BY ALL),
st AS (SELECT proxy_address, username, sum(bet) AS total_volume, count(DISTINCT market_slug) AS unique_markets, max(bet) AS bet_size,
  arg_max(market_slug, (round(bet, 6), market_slug, side)) AS market_slug, arg_max(side, (round(bet, 6), market_slug, side)) AS direction FROM bets GROUP BY ALL),
a AS (SELECT st.*, bet_size/total_volume AS share, CAST(datediff('day', f, DATE '2001-11-10') AS INTEGER) AS account_age_days FROM st JOIN (SELECT proxy_address, CAST(min(ts) AS DATE) AS f FROM v_trades GROUP BY 1) USING (proxy_address))
SELECT 'NEW_ACCOUNT_WHALE' AS signal_type, proxy_address, username, market_slug, direction, r6(bet_size) AS bet_size, r6(total_volume) AS total_volume, unique_markets, account_age_days, r6(share) AS share, 'LOW' AS severity, r6(0.5) AS confidence
FROM a WHERE account_age_days <= 2450 AND bet_size >= 40 AND round(share, 9) >= 0.05""")
def new_account_whale(t: Tables):
    return rounded(signals.new_account_whale(t.trades(), as_of(), H, max_age_days=2450, min_bet=40, min_share=0.05))


@query("volume_spike", f"""WITH v AS (SELECT market_slug, coalesce(sum(notional) FILTER ({_SINCE}), 0) AS rv, coalesce(sum(notional) FILTER ({_SINCE} AND side = 'BUY' AND outcome_index = 0), 0) AS yv,
  coalesce(sum(notional) FILTER ({_SINCE} AND side = 'BUY' AND outcome_index = 1), 0) AS nv, count(DISTINCT CASE WHEN {_SINCE} THEN proxy_address END) AS unique_traders,
  sum(notional) FILTER (NOT ({_SINCE}))/1200 AS av FROM v_trades WHERE ts >= {T0} - INTERVAL 1200 DAY GROUP BY 1),
x AS (SELECT *, rv/(av*400) AS s, coalesce(abs(yv - nv)/nullif(yv + nv, 0), 0) AS tilt FROM v WHERE rv >= 100 AND av > 0)
SELECT 'VOLUME_SPIKE' AS signal_type, market_slug, r6(rv) AS recent_volume, r6(av) AS avg_daily_volume, r6(s) AS spike_ratio, r6(yv) AS yes_volume, r6(nv) AS no_volume, unique_traders, r6(tilt) AS imbalance,
  CASE WHEN s >= 50 AND tilt >= 0.7 THEN 'CRITICAL' WHEN s >= 20 THEN 'HIGH' WHEN s >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity, r6(least(1, 0.3 + s/50 + tilt*0.3)) AS confidence,
  CASE WHEN round(yv - nv, 9) > 0 THEN 'YES' ELSE 'NO' END AS direction FROM x WHERE round(s, 9) >= 1.2""")
def volume_spike(t: Tables):
    return rounded(signals.volume_spike(t.trades(), as_of(), H, days=1200, ratio=1.2, min_volume=100))


@query("smart_money_divergence", f"""WITH top AS (SELECT proxy_address FROM v_scores ORDER BY total_score DESC, proxy_address LIMIT 100),
b AS (SELECT market_slug, outcome_index, sum(notional) AS smart_volume, count(DISTINCT proxy_address) AS num_traders FROM v_trades WHERE {_SINCE} AND side = 'BUY' AND proxy_address IN (SELECT * FROM top)
  GROUP BY ALL HAVING count(DISTINCT proxy_address) >= 2),
m AS (SELECT market_slug, coalesce(sum(notional) FILTER (outcome_index = 0), 0) AS yes_volume, coalesce(sum(notional) FILTER (outcome_index = 1), 0) AS no_volume FROM v_trades WHERE ts >= {T0} - INTERVAL 400 DAY GROUP BY 1),
x AS (SELECT *, CAST(CASE WHEN round(yes_volume - no_volume, 9) > 0 THEN 0 ELSE 1 END AS INTEGER) AS consensus_outcome, greatest(yes_volume, no_volume)/(yes_volume + no_volume) AS share FROM b JOIN m USING (market_slug))
SELECT 'SMART_MONEY_DIVERGENCE' AS signal_type, market_slug, outcome_index, r6(smart_volume) AS smart_volume, num_traders, r6(yes_volume) AS yes_volume, r6(no_volume) AS no_volume, consensus_outcome, r6(share) AS consensus_pct,
  CASE WHEN num_traders >= 5 AND share >= 0.7 THEN 'CRITICAL' WHEN num_traders >= 3 AND share >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, r6(least(1, 0.4 + num_traders*0.1 + smart_volume/50000)) AS confidence,
  CASE WHEN outcome_index = 0 THEN 'YES' ELSE 'NO' END AS direction FROM x WHERE outcome_index <> consensus_outcome""")
def smart_money_divergence(t: Tables):
    return rounded(signals.smart_money_divergence(t.trades(), t.scores(), as_of(), H, min_traders=2, sentiment_days=400))


_CLUSTER = f"""cl AS (SELECT market_slug, outcome_index, count(DISTINCT proxy_address) AS num_traders, sum(notional) AS total_volume, min(ts) AS cluster_start, max(ts) AS cluster_end,
  CAST(datediff('minute', min(ts), max(ts)) AS BIGINT) AS window_minutes FROM v_trades WHERE {_SINCE} AND side = 'BUY' GROUP BY ALL HAVING count(DISTINCT proxy_address) >= 3 AND datediff('minute', min(ts), max(ts)) <= 120 AND round(sum(notional), 6) >= 20)"""


@query("coordinated_entry", f"""WITH {_CLUSTER} SELECT 'COORDINATED_ENTRY' AS signal_type, market_slug, outcome_index, num_traders, r6(total_volume) AS total_volume, cluster_start, cluster_end, window_minutes,
  CASE WHEN num_traders >= 5 AND window_minutes <= 30 THEN 'CRITICAL' WHEN num_traders >= 4 AND window_minutes <= 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  r6(least(1, 0.3 + num_traders*0.1 + num_traders/greatest(1, window_minutes)*0.2)) AS confidence, CASE WHEN outcome_index = 0 THEN 'YES' ELSE 'NO' END AS direction FROM cl""")
def coordinated_entry(t: Tables):
    return rounded(signals.coordinated_entry(t.trades(), as_of(), H, min_volume=20))


@query("coordinated_entry_members", f"""WITH {_CLUSTER}, e AS (SELECT market_slug, outcome_index, username, min(ts) AS entry FROM v_trades SEMI JOIN cl USING (market_slug, outcome_index) WHERE {_SINCE} AND side = 'BUY' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market_slug, outcome_index ORDER BY entry, username) AS rn FROM e)
SELECT market_slug, outcome_index, string_agg(username, ',' ORDER BY rn) AS traders FROM r GROUP BY ALL""")
def coordinated_entry_members(t: Tables):
    found = signals.coordinated_entry(t.trades(), as_of(), H, min_volume=20)
    return signals.cluster_members(t.trades(), found, as_of(), H).withColumn("traders", F.array_join("traders", ","))


@query("late_entry_conviction", f"""WITH act AS (SELECT market_slug FROM v_trades WHERE ts >= {T0} - INTERVAL 400 DAY GROUP BY 1 HAVING round(sum(notional), 6) >= 50),
b AS (SELECT proxy_address, username, market_slug, side, outcome_index, sum(notional) AS bet_size, min(ts) AS first_bet, count(*) AS num_bets FROM v_trades WHERE {_SINCE} AND market_slug IN (SELECT * FROM act)
  GROUP BY ALL HAVING round(sum(notional), 6) >= 30),
h AS (SELECT proxy_address, market_slug, sum(notional) AS historical_volume FROM v_trades WHERE NOT ({_SINCE}) GROUP BY ALL)
SELECT 'LATE_ENTRY_CONVICTION' AS signal_type, proxy_address, username, market_slug, side, outcome_index, r6(bet_size) AS bet_size, first_bet, num_bets, r6(historical_volume) AS historical_volume,
  historical_volume IS NULL AS is_new_to_market, 'LOW' AS severity, r6(0.4 + CASE WHEN historical_volume IS NULL THEN 0.25 ELSE 0 END) AS confidence
FROM b LEFT JOIN h USING (proxy_address, market_slug) WHERE historical_volume IS NULL OR bet_size > historical_volume*2""")
def late_entry_conviction(t: Tables):
    return rounded(signals.late_entry_conviction(t.trades(), as_of(), H, min_bet=30, active_days=400, min_market_volume=50))


@query("whale_anomaly", f"""WITH w AS (SELECT proxy_address FROM v_trades GROUP BY 1 HAVING round(sum(notional), 6) >= 2600),
k AS (SELECT DISTINCT proxy_address, market_slug FROM v_trades WHERE NOT ({_SINCE}))
SELECT 'WHALE_ANOMALY' AS signal_type, proxy_address, username, market_slug, side, outcome_index, r6(sum(notional)) AS bet_size, min(ts) AS first_bet, count(*) AS num_bets, 'LOW' AS severity,
  r6(0.4 + sum(notional)/50000) AS confidence, CASE WHEN outcome_index = 0 THEN 'YES' ELSE 'NO' END AS direction
FROM v_trades WHERE {_SINCE} AND proxy_address IN (SELECT * FROM w) AND (proxy_address, market_slug) NOT IN (SELECT proxy_address, market_slug FROM k)
GROUP BY proxy_address, username, market_slug, side, outcome_index HAVING round(sum(notional), 6) >= 20""")
def whale_anomaly(t: Tables):
    return rounded(signals.whale_anomaly(t.trades(), as_of(), H, whale_volume=2600, min_bet=20))


_RULES = (("top_position", "POSITION_ENTRY", 80.0, 20.0, "HIGH"), ("whale_trade", "LARGE_TRADE", 0.0, 40.0, "HIGH"))


@query("alert_rules", """WITH s AS (SELECT t.*, coalesce(s.total_score, 0) AS total_score FROM v_trades t LEFT JOIN v_scores s USING (username))
SELECT event_key, username, market_slug, ts, r6(notional) AS notional, total_score, 'top_position' AS rule_id, 'POSITION_ENTRY' AS alert_type, 'HIGH' AS priority FROM s WHERE total_score >= 80 AND notional >= 20
UNION ALL SELECT event_key, username, market_slug, ts, r6(notional), total_score, 'whale_trade', 'LARGE_TRADE', 'HIGH' FROM s WHERE notional >= 40""")
def alert_rules(t: Tables):
    return rounded(signals.alert_rules(t.trades(), t.scores(), _RULES))


@query("arb_scan", """WITH q AS (SELECT asset_id, best_ask_price, best_ask_size FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, seq DESC) AS rn FROM v_ws_unique) WHERE rn = 1),
m AS (SELECT slug, coalesce(end_date, CASE WHEN slug LIKE '%updown-15m-%' THEN make_timestamp((CAST(split_part(slug, '-', 4) AS BIGINT) + 900)*1000000) END) AS end_date, token_ids FROM v_markets WHERE active)
SELECT slug, m.end_date, r6(y.best_ask_price) AS yes_ask, r6(y.best_ask_size) AS yes_size, r6(n.best_ask_price) AS no_ask, r6(n.best_ask_size) AS no_size, r6(1 - (y.best_ask_price + n.best_ask_price)) AS edge,
  r6(least(y.best_ask_size, n.best_ask_size)) AS max_shares FROM m JOIN q y ON y.asset_id = token_ids[1] JOIN q n ON n.asset_id = token_ids[2]
WHERE m.end_date > TIMESTAMP '1995-01-01' AND m.end_date <= TIMESTAMP '1995-01-01' + INTERVAL 5000 DAY AND round(1 - (y.best_ask_price + n.best_ask_price), 9) >= 0.02 AND y.best_ask_size >= 5 AND n.best_ask_size >= 5""")
def arb_scan(t: Tables):
    when = F.to_timestamp(F.lit("1995-01-01 00:00:00"))
    return rounded(markets.arb_scan(t.markets(), t.ws_tob(), when, days=5000, min_size=5))


# ---- alert tables ----------------------------------------------------------------------------


def alert_table(t: Tables):
    """An alert of every trade."""
    n = F.col("version")
    return t.trades().select(
        F.col("event_key").alias("alert_id"), "username", "proxy_address", "market_slug", F.when(n % 2 == 0, "VOLUME_SPIKE").otherwise("WHALE_ANOMALY").alias("signal_type"),
        F.when(n % 10 == 0, "CRITICAL").when(n % 5 == 1, "HIGH").when(n % 5 == 2, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(n % 3 == 0, F.lit(None).cast("boolean")).otherwise(n % 3 == 1).alias("was_correct"), F.round(F.col("price"), 2).alias("confidence"),
        F.col("notional").alias("total_volume_usd"), F.when(F.col("outcome") == "Up", "YES").otherwise("NO").alias("direction"), F.col("ts").alias("detected_at"),
        F.when(n % 4 == 0, "ACTIVE").when(n % 4 == 1, "RESOLVED").otherwise("INVESTIGATING").alias("status"))


_ALERTS = """al AS (SELECT event_key AS alert_id, username, proxy_address, market_slug, CASE WHEN version % 2 = 0 THEN 'VOLUME_SPIKE' ELSE 'WHALE_ANOMALY' END AS signal_type,
  CASE WHEN version % 10 = 0 THEN 'CRITICAL' WHEN version % 5 = 1 THEN 'HIGH' WHEN version % 5 = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN version % 3 = 0 THEN NULL ELSE version % 3 = 1 END AS was_correct, price AS confidence, notional AS total_volume_usd, CASE WHEN outcome = 'Up' THEN 'YES' ELSE 'NO' END AS direction, ts AS detected_at,
  CASE version % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'RESOLVED' ELSE 'INVESTIGATING' END AS status FROM v_trades)"""


@query("insider_detection_performance", f"""WITH {_ALERTS} SELECT signal_type, severity, count(*) AS total_alerts, count(*) FILTER (was_correct) AS correct_predictions, count(*) FILTER (NOT was_correct) AS incorrect_predictions,
  count(*) FILTER (was_correct IS NULL) AS unresolved, r6(coalesce(count(*) FILTER (was_correct)/nullif(count(was_correct), 0), 0)) AS accuracy, r6(avg(confidence)) AS avg_confidence, r6(sum(total_volume_usd)) AS total_volume_flagged FROM al GROUP BY ALL""")
def insider_detection_performance(t: Tables):
    return rounded(signals.detection_performance(alert_table(t)))


@query("insider_daily_summary", f"""WITH {_ALERTS} SELECT CAST(detected_at AS DATE) AS date, count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical_alerts, count(*) FILTER (severity = 'HIGH') AS high_alerts,
  count(*) FILTER (severity = 'MEDIUM') AS medium_alerts, r6(sum(total_volume_usd)) AS total_suspicious_volume, count(DISTINCT market_slug) AS unique_markets, r6(avg(confidence)) AS avg_confidence FROM al GROUP BY 1""")
def insider_daily_summary(t: Tables):
    return rounded(signals.daily_summary(alert_table(t)))


@query("top_suspicious_markets", f"""WITH {_ALERTS} SELECT market_slug, arg_max(signal_type, (detected_at, alert_id)) AS latest_signal, arg_max(severity, (detected_at, alert_id)) AS latest_severity,
  arg_max(direction, (detected_at, alert_id)) AS predicted_direction, count(*) AS total_signals, r6(max(confidence)) AS max_confidence, r6(sum(total_volume_usd)) AS total_suspicious_volume, max(detected_at) AS last_alert_at
FROM al GROUP BY 1 ORDER BY max(al.confidence) DESC, total_signals DESC, market_slug LIMIT 100""")
def top_suspicious_markets(t: Tables):
    return rounded(signals.top_suspicious_markets(alert_table(t)))


@query("repeat_suspects", f"""WITH {_ALERTS}, f AS (SELECT al.*, CASE WHEN r.winning_outcome = 'Up' THEN 'YES' WHEN r.winning_outcome = 'Down' THEN 'NO' END AS mo FROM al LEFT JOIN v_resolutions r USING (market_slug))
SELECT proxy_address, username, count(*) AS times_flagged, count(*) FILTER (mo IS NOT NULL AND direction = mo) AS correct_bets, count(mo) AS resolved_bets,
  r6(coalesce(count(*) FILTER (mo IS NOT NULL AND direction = mo)/nullif(count(mo), 0), 0)) AS success_rate, r6(sum(total_volume_usd)) AS total_suspicious_volume,
  string_agg(DISTINCT signal_type, ',' ORDER BY signal_type) AS signal_types FROM f GROUP BY ALL HAVING count(*) >= 2""")
def repeat_suspects(t: Tables):
    res = t.resolutions().select("market_slug", F.when(F.col("winning_outcome") == "Up", "YES").otherwise("NO").alias("market_outcome"))
    flagged = alert_table(t).join(res, "market_slug", "left").withColumnsRenamed({"direction": "bet_direction", "total_volume_usd": "bet_size_usd"})
    return rounded(signals.repeat_suspects(flagged))


@query("active_anomalies", f"""WITH {_ALERTS} SELECT alert_id, al.username, severity, status, detected_at, s.total_score, s.tier FROM al LEFT JOIN v_scores s USING (proxy_address) WHERE status = 'INVESTIGATING'""")
def active_anomalies(t: Tables):
    return alert_table(t).filter("status = 'INVESTIGATING'").join(t.scores().select("proxy_address", "total_score", "tier"), "proxy_address", "left").select(
        "alert_id", "username", "severity", "status", "detected_at", "total_score", "tier")


@query("ledger_lists", f"""WITH {_ALERTS} SELECT alert_id, severity, detected_at, market_slug FROM al WHERE status = 'ACTIVE'
ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, detected_at DESC, alert_id LIMIT 100""")
def ledger_lists(t: Tables):
    return signals.active_alerts(alert_table(t), ["ACTIVE"], 100).select("alert_id", "severity", "detected_at", "market_slug")


@query("open_anomalies", f"""WITH {_ALERTS} SELECT alert_id, severity, detected_at, market_slug, CAST(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS INTEGER) AS severity_rank
FROM al WHERE status = 'INVESTIGATING'""")
def open_anomalies(t: Tables):
    return ledgers.open_anomalies(alert_table(t).withColumn("version", F.lit(1))).select("alert_id", "severity", "detected_at", "market_slug", "severity_rank")


def consensus_log(t: Tables):
    """Two versions of a signal per (market, outcome): the first batch of buyers and all of them."""
    rows = t.trades().filter("side = 'BUY'").groupBy("market_slug", "outcome").agg(F.count_distinct("username").alias("n"), F.max("ts").alias("at"))
    versions = rows.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    seen = F.when(F.col("version") == 1, F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    return versions.select(
        F.concat_ws(":", "market_slug", "outcome").alias("signal_id"), "version", "market_slug", "outcome", seen.alias("traders"),
        F.when(seen >= 30, "EXTREME").when(seen >= 6, "STRONG").when(seen >= 3, "MODERATE").otherwise("WEAK").alias("strength"), (F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"))


@query("live_consensus", """SELECT market_slug || ':' || outcome AS signal_id, n AS traders, CASE WHEN n >= 30 THEN 'EXTREME' ELSE 'STRONG' END AS strength, last_buy + INTERVAL 30 DAY AS valid_until
FROM (SELECT market_slug, outcome, count(DISTINCT username) AS n, max(ts) AS last_buy FROM v_trades WHERE side = 'BUY' GROUP BY ALL) WHERE n >= 6 AND last_buy + INTERVAL 30 DAY > TIMESTAMP '1998-06-01'""")
def live_consensus(t: Tables):
    return ledgers.live_consensus(consensus_log(t), F.to_timestamp(F.lit("1998-06-01"))).select("signal_id", "traders", "strength", "valid_until")


@query("latest_discoveries", """SELECT proxy_address, discovery_score, calculated_at AS discovered_at FROM (SELECT *, total_score + 0 AS discovery_score FROM v_scores)
WHERE calculated_at > TIMESTAMP '2001-11-10' - INTERVAL 60 DAY ORDER BY discovery_score DESC, proxy_address LIMIT 50""")
def latest_discoveries(t: Tables):
    found = t.score_history().select("proxy_address", "version", F.col("total_score").alias("discovery_score"), F.col("calculated_at").alias("discovered_at"))
    return ledgers.latest_discoveries(found, as_of(), days=60).select("proxy_address", "discovery_score", "discovered_at")


@query("current_index", """WITH h AS (SELECT strategy_type AS index_type, proxy_address, total_score, date_trunc('month', calculated_at) AS rebalanced_at FROM v_score_history)
SELECT index_type, proxy_address, total_score, rebalanced_at FROM h WHERE (index_type, rebalanced_at) IN (SELECT index_type, max(rebalanced_at) FROM h GROUP BY 1)""")
def current_index(t: Tables):
    history = t.score_history().select(F.col("strategy_type").alias("index_type"), "proxy_address", "total_score", F.date_trunc("month", "calculated_at").alias("rebalanced_at"))
    return ledgers.current_index(history)


def fund_positions(t: Tables):
    """Positions of ten funds: what the trades of their users left in each token; sales beyond what is held close a position."""
    signed = F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    return t.trades().groupBy((F.substring("username", 2, 9).cast("bigint") % 10).cast("string").alias("fund_type"), "token_id").agg(
        F.sum(signed).alias("shares"), F.avg("price").alias("avg_entry_price"), F.max_by("price", F.struct("ts", "event_key")).alias("current_price")).withColumn("version", F.lit(1))


_FUND = "CAST(CAST(substr(username, 2) AS BIGINT) % 10 AS VARCHAR)"


@query("valued_positions", f"""WITH p AS (SELECT {_FUND} AS fund_type, token_id, sum(CASE side WHEN 'BUY' THEN size ELSE -size END) AS shares, avg(price) AS e, arg_max(price, (ts, event_key)) AS c FROM v_trades GROUP BY ALL)
SELECT fund_type, token_id, r4(shares) AS shares, r4(shares*c) AS current_value, r4(shares*c - shares*e) AS unrealized_pnl, r4(coalesce((shares*c - shares*e)*100/nullif(shares*e, 0), 0)) AS unrealized_pnl_pct FROM p WHERE shares > 0""")
def valued_positions(t: Tables):
    return rounded(ledgers.valued_positions(fund_positions(t)).select("fund_type", "token_id", "shares", "current_value", "unrealized_pnl", "unrealized_pnl_pct"), 4)


def fund_trades(t: Tables):
    return t.trades().select((F.substring("username", 2, 9).cast("bigint") % 10).cast("string").alias("fund_type"), "event_key", "ts", "username", "market_slug", "side", "price", "size", "notional",
                             F.concat(F.col("username"), F.lit("-"), F.col("event_key")).alias("trade_id"))


@query("newest_fund_trades", f"""SELECT fund_type, trade_id, ts, side, r4(notional) AS notional FROM (SELECT *, {_FUND} AS fund_type, username || '-' || event_key AS trade_id FROM v_trades)
QUALIFY row_number() OVER (PARTITION BY fund_type ORDER BY ts DESC, trade_id) <= 50""")
def newest_fund_trades(t: Tables):
    return rounded(ledgers.newest_per_fund(fund_trades(t), "ts", "trade_id", 50).select("fund_type", "trade_id", "ts", "side", "notional"), 4)


def fund_executions(t: Tables):
    """An execution a second after every third trade."""
    return fund_trades(t).filter(F.unix_seconds("ts") % 3 == 0).withColumn("executed_at", F.col("ts") + F.expr("INTERVAL 1 SECOND"))


@query("newest_fund_executions", f"""SELECT fund_type, trade_id, ts + INTERVAL 1 SECOND AS executed_at FROM (SELECT *, {_FUND} AS fund_type, username || '-' || event_key AS trade_id FROM v_trades WHERE CAST(floor(epoch(ts)) AS BIGINT) % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY fund_type ORDER BY ts DESC, trade_id) <= 20""")
def newest_fund_executions(t: Tables):
    return ledgers.newest_per_fund(fund_executions(t), "executed_at", "trade_id", 20).select("fund_type", "trade_id", "executed_at")


@query("fund_day_counters", f"""WITH f AS (SELECT *, {_FUND} AS fund_type FROM v_trades), a AS (SELECT TIMESTAMP '1998-06-01 12:00:00' AS z)
SELECT fund_type, count(*) FILTER (ts >= z - INTERVAL 24 HOUR AND ts <= z) AS trades_24h, r4(coalesce(sum(notional) FILTER (ts >= z - INTERVAL 24 HOUR AND ts <= z), 0)) AS volume_24h,
  count(*) FILTER (CAST(floor(epoch(ts)) AS BIGINT) % 3 = 0 AND ts + INTERVAL 1 SECOND >= z - INTERVAL 24 HOUR AND ts + INTERVAL 1 SECOND <= z) AS signals_24h FROM f, a GROUP BY fund_type""")
def fund_day_counters(t: Tables):
    return rounded(ledgers.day_counters(fund_trades(t), fund_executions(t), F.to_timestamp(F.lit("1998-06-01 12:00:00"))), 4)


@query("drift_trend", """SELECT CAST(ts AS DATE) AS date, r6(avg(value/500)) AS avg_drift_ratio, r6(max(value/500)) AS max_drift_ratio, count(*) FILTER (event_type = 'view') AS warning_count,
  count(*) FILTER (event_type = 'error') AS critical_count, count(*) FILTER (user_id % 10 = 0) AS retrains_triggered FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1""")
def drift_trend(t: Tables):
    e = t.read("events").filter("ts >= TIMESTAMP '2024-01-01'")
    return rounded(signals.drift_trend(e.select(
        F.col("ts").alias("checked_at"), (F.col("value") / 500).alias("drift_ratio"), (F.col("user_id") % 10 == 0).alias("retrain_triggered"),
        F.when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "error", "critical").otherwise("ok").alias("alert_level"))))


# ---- edge ------------------------------------------------------------------------------------


def returns(t: Tables):
    return t.enriched().filter("realized_pnl IS NOT NULL").select("username", "ts", "event_key", "market_slug", F.col("realized_pnl").alias("ret"))


def _window(tag: str, days: int) -> str:
    w = f"ts >= {T0} - INTERVAL {days} DAY"
    return (f"count(*) FILTER ({w}) AS {tag}_n, avg(realized_pnl) FILTER ({w}) AS {tag}_mean, stddev_pop(realized_pnl) FILTER ({w}) AS {tag}_std, "
            f"count(*) FILTER ({w} AND realized_pnl > 0)/nullif(count(*) FILTER ({w}), 0) AS {tag}_win")


_STATS = f"""st0 AS (SELECT username, {_window('h', 1800)}, {_window('r', 600)} FROM v_enriched WHERE realized_pnl IS NOT NULL AND ts >= {T0} - INTERVAL 1800 DAY GROUP BY 1),
st AS (SELECT *, CASE WHEN round(h_std, 9) > 0 THEN h_mean/h_std ELSE 0 END AS h_sharpe, CASE WHEN round(r_std, 9) > 0 THEN r_mean/r_std ELSE 0 END AS r_sharpe FROM st0)"""


def edge_stats(t: Tables):
    return edge.window_stats(returns(t), as_of(), long_days=1800, recent_days=600)


def _cdf(z: str) -> str:
    u = f"(1/(1 + 0.3275911::DOUBLE*abs({z})/sqrt(2)))"
    poly = f"((((1.061405429::DOUBLE*{u} - 1.453152027::DOUBLE)*{u} + 1.421413741::DOUBLE)*{u} - 0.284496736::DOUBLE)*{u} + 0.254829592::DOUBLE)*{u}"
    return f"least(1, greatest(0, 1 - 0.5*(1 + (1 - {poly}*exp(-({z})*({z})/2)))))"


def _conf(p: str, a, b, c, d) -> str:
    return f"CASE WHEN {p} < 0.01 THEN {a} WHEN {p} < 0.05 THEN {b} WHEN {p} < 0.10 THEN {c} ELSE {d} END * least(1, (h_n + r_n)/100)"


def _test(name, applies, hist, recent, change, p, conf, scale) -> str:
    return f"""SELECT username, '{name}' AS type, least(100, chg*100*{scale}*cf) AS decay_score, {hist} AS historical, {recent} AS recent, chg AS pct_decline, cf AS confidence, {p} AS p_value
  FROM (SELECT *, {change} AS chg, {conf} AS cf FROM z WHERE {applies}) WHERE round(chg, 9) >= 0.15 AND NOT ({p} > 0.05 AND round(chg, 9) < 0.25)"""


_DECAY = f"""{_STATS}, y AS (SELECT *, h_std*h_std/h_n AS v1, r_std*r_std/r_n AS v2, (h_win*h_n + r_win*r_n)/(h_n + r_n) AS pool FROM st WHERE h_n >= 20 AND r_n > 0),
x AS (SELECT *, CASE WHEN h_n > 1 AND r_n > 1 AND v1 + v2 > 0 THEN (h_mean - r_mean)/sqrt(v1 + v2) ELSE 0 END AS tt,
  CASE WHEN h_n <= 1 OR r_n <= 1 THEN 1 WHEN v1*v1/(h_n - 1) + v2*v2/(r_n - 1) = 0 THEN greatest(h_n + r_n - 2, 1) ELSE greatest(1, floor((v1 + v2)*(v1 + v2)/(v1*v1/(h_n - 1) + v2*v2/(r_n - 1)))) END AS dof,
  CASE WHEN pool*(1 - pool)*(1/h_n + 1/r_n) > 0 THEN (h_win - r_win)/sqrt(pool*(1 - pool)*(1/h_n + 1/r_n)) ELSE 0 END AS zw,
  CASE WHEN h_n > 2 AND r_n > 2 AND h_std > 0 AND r_std > 0 THEN ln(r_std*r_std/(h_std*h_std))/sqrt(2/(h_n - 1) + 2/(r_n - 1)) END AS zv FROM y),
w AS (SELECT *, CASE WHEN dof > 2 AND dof <= 30 THEN tt*sqrt(dof/(dof - 2)) ELSE tt END AS zm FROM x),
z AS (SELECT *, {_cdf('zm')} AS pm, {_cdf('zw')} AS pw, CASE WHEN zv IS NULL THEN 0.5 ELSE {_cdf('zv')} END AS pv FROM w),
ind AS ({_test('SHARPE_RATIO', 'round(h_sharpe, 9) > 0', 'h_sharpe', 'r_sharpe', '(h_sharpe - r_sharpe)/h_sharpe', 'pm', _conf('pm', .95, .85, .7, .5), 1)}
  UNION ALL {_test('WIN_RATE', 'round(h_win, 9) > 0.5', 'h_win', 'r_win', '(h_win - r_win)/h_win', 'pw', _conf('pw', .95, .85, .7, .5), 0.8)}
  UNION ALL {_test('RETURNS', 'round(h_mean, 9) > 0', 'h_mean', 'r_mean', '(h_mean - r_mean)/h_mean', 'pm', _conf('pm', .95, .85, .7, .5), 1)}
  UNION ALL {_test('CONSISTENCY', 'round(h_std, 9) > 0 AND r_std > h_std', 'h_std', 'r_std', '(r_std - h_std)/h_std', 'pv', _conf('pv', .9, .8, .65, .45), 0.6)}),
worst AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY username) AS k, row_number() OVER (PARTITION BY username ORDER BY decay_score DESC, type DESC) AS rn FROM ind) WHERE rn = 1)"""


@query("edge_decay", f"""WITH {_DECAY} SELECT z.username, CAST(coalesce(k, 0) AS INTEGER) AS indicators, r4(coalesce(decay_score, 0)) AS decay_score, CASE WHEN k > 1 THEN 'MULTIPLE' ELSE coalesce(type, 'RETURNS') END AS decay_type,
  r4(coalesce(historical, h_sharpe)) AS historical_metric, r4(coalesce(recent, r_sharpe)) AS recent_metric, r4(coalesce(pct_decline, 0)) AS pct_decline, r4(coalesce(confidence, 1)) AS confidence, r4(coalesce(p_value, 1)) AS p_value,
  h_n AS trades_analyzed, CASE WHEN coalesce(pct_decline, 0) >= 0.6 THEN 'CRITICAL' WHEN pct_decline >= 0.4 THEN 'SEVERE' WHEN pct_decline >= 0.25 THEN 'MODERATE' WHEN pct_decline >= 0.15 THEN 'EARLY_WARNING' ELSE 'NONE' END AS signal
FROM z LEFT JOIN worst USING (username)""")
def edge_decay(t: Tables):
    return rounded(edge.edge_decay(edge_stats(t)).drop("recommended_action"), 4)


_HEALTH = f"""{_STATS}, h AS (SELECT *, CASE WHEN round(h_sharpe, 9) > 0 THEN (r_sharpe - h_sharpe)/h_sharpe ELSE 0 END AS c FROM st)"""


@query("edge_health", f"""WITH {_HEALTH} SELECT username, h_n, r_n, r6(c) AS sharpe_change, CASE WHEN h_n < 20 THEN 'INSUFFICIENT_DATA' WHEN round(c, 9) < -0.4 THEN 'CRITICAL' WHEN round(c, 9) < -0.25 THEN 'SEVERE' WHEN round(c, 9) < -0.15 THEN 'MODERATE'
  WHEN round(c, 9) < 0 THEN 'EARLY_WARNING' ELSE 'HEALTHY' END AS status, CASE WHEN h_n >= 20 THEN r6(CASE WHEN round(c, 9) < -0.4 THEN greatest(0, 100 + c*100) WHEN round(c, 9) < -0.25 THEN greatest(20, 100 + c*100)
  WHEN round(c, 9) < -0.15 THEN greatest(40, 100 + c*100) WHEN round(c, 9) < 0 THEN greatest(60, 100 + c*100) ELSE least(100, 100 + c*50) END) END AS health_score FROM h""")
def edge_health(t: Tables):
    return rounded(edge.edge_health(edge_stats(t)).select("username", "h_n", "r_n", "sharpe_change", "status", "health_score"))


@query("edge_decay_list", f"""WITH {_HEALTH} SELECT username, r6(-c) AS decline FROM h WHERE h_n >= 20 AND round(-c, 9) >= 0.15 ORDER BY round(-c, 6) DESC, username LIMIT 50""")
def edge_decay_list(t: Tables):
    return rounded(edge.edge_decay_list(edge.edge_health(edge_stats(t)), 20, 0.15, 50).select("username", "decline"))


@query("edge_persistence", f"""WITH b AS (SELECT username, count(*) AS n, avg(realized_pnl) AS m, stddev_pop(realized_pnl) AS s, count(DISTINCT market_slug) AS mk, datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS d,
  count(*) FILTER (realized_pnl > 0)/count(*) AS wr, coalesce(avg(realized_pnl) FILTER (ts >= {T0} - INTERVAL 400 DAY), 0) AS rm FROM v_enriched WHERE realized_pnl IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
f AS (SELECT *, CASE WHEN round(s, 9) > 0 THEN m/s ELSE 0 END AS sh, rm/nullif(m, 0) AS ratio FROM b LEFT JOIN (SELECT username, strategy_type FROM v_scores) USING (username)),
g AS (SELECT *, CASE WHEN strategy_type IN ('ARBITRAGEUR', 'MARKET_MAKER', 'DIRECTIONAL_FUNDAMENTAL') THEN 0.85 WHEN strategy_type IN ('EVENT_DRIVEN', 'SWING_TRADER', 'DIRECTIONAL_MOMENTUM') THEN 0.65 ELSE 0.45 END AS f1,
  CASE WHEN sh > 0 THEN least(1, sh/2) ELSE 0 END*0.4 + CASE WHEN wr > 0.5 THEN (wr - 0.5)*2 ELSE 0 END*0.3 + greatest(0, 1 - coalesce(s/nullif(abs(m), 0), 10)/5)*0.3 AS f2,
  least(1, d/90)*0.6 + least(1, n/200)*0.4 AS f3, CASE WHEN ratio IS NULL THEN 0.5 WHEN ratio >= 1 THEN least(1, 0.5 + (ratio - 1)*0.5) ELSE greatest(0, ratio*0.5) END AS f4, 0.5 + least(1, mk/10)*0.5 AS f5 FROM f),
p AS (SELECT *, 1/(1 + exp(-2*(f1*0.25 + f2*0.25 + f3*0.2 + f4*0.15 + f5*0.15 - 0.5))) AS prob FROM g),
q AS (SELECT *, CASE WHEN prob >= 0.75 AND f2 >= 0.7 THEN 'LOW' WHEN prob >= 0.55 THEN 'MODERATE' WHEN prob >= 0.35 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk FROM p)
SELECT username, r6(f1) AS strategy_factor, r6(f2) AS consistency_factor, r6(f3) AS track_record_factor, r6(f4) AS recent_factor, r6(f5) AS conditions_factor, r6(prob) AS prob_30d, r6(prob*0.9) AS prob_60d, r6(prob*0.8) AS prob_90d,
  risk AS persistence_risk, r6(least(0.95, f3*f2)) AS confidence, CASE risk WHEN 'LOW' THEN 'INCLUDE' WHEN 'MODERATE' THEN CASE WHEN sh > 1.5 THEN 'INCLUDE' ELSE 'REDUCE_WEIGHT' END WHEN 'HIGH' THEN 'REDUCE_WEIGHT' ELSE 'EXCLUDE' END AS recommendation FROM q""")
def edge_persistence(t: Tables):
    out = edge.edge_persistence(returns(t), t.scores(), as_of(), recent_days=400)
    return rounded(out.select("username", "strategy_factor", "consistency_factor", "track_record_factor", "recent_factor", "conditions_factor", "prob_30d", "prob_60d",
                              "prob_90d", "persistence_risk", "confidence", "recommendation"))


# ---- integrity -------------------------------------------------------------------------------

_REG = """reg AS (SELECT username, count(*) AS intervals, avg(gap) AS avg_interval_ms, coalesce(stddev_pop(gap)/nullif(avg(gap), 0), 0) AS cv FROM (SELECT username, row_number() OVER w AS rn,
  CAST(epoch_ms(ts) - epoch_ms(lag(ts) OVER w) AS BIGINT) AS gap FROM v_trades WINDOW w AS (PARTITION BY username ORDER BY ts, event_key)) WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 10)"""
_STREAK = """runs AS (SELECT username, won, g, count(*) AS len FROM (SELECT username, won, rn - row_number() OVER (PARTITION BY username, won ORDER BY rn) AS g FROM (SELECT username, realized_pnl > 0 AS won,
  row_number() OVER (PARTITION BY username ORDER BY ts, event_key) AS rn FROM v_enriched WHERE realized_pnl IS NOT NULL)) GROUP BY ALL),
sk AS (SELECT username, coalesce(max(len) FILTER (won), 0) AS max_win_streak, coalesce(max(len) FILTER (NOT won), 0) AS max_loss_streak FROM runs GROUP BY 1)"""


@query("interval_regularity", f"WITH {_REG} SELECT username, intervals, r2(avg_interval_ms) AS avg_interval_ms, r6(cv) AS cv, cv < 0.1 AND avg_interval_ms < 5000 AS suspicious FROM reg")
def interval_regularity(t: Tables):
    return rounded(integrity.interval_regularity(t.trades())).withColumn("avg_interval_ms", rnd("avg_interval_ms", 2))


@query("streaks", f"WITH {_STREAK} SELECT username, max_win_streak, max_loss_streak FROM sk")
def streaks(t: Tables):
    return integrity.streaks(returns(t), F.col("ret") > 0)


_CHECKS = f"""{_REG}, {_STREAK}, rs AS (SELECT username, count(*) AS n, count(*) FILTER (realized_pnl > 0)/count(*) AS wr, avg(realized_pnl) AS m, stddev_pop(realized_pnl) AS s FROM v_enriched WHERE realized_pnl IS NOT NULL GROUP BY 1),
tr AS (SELECT username, count(*) AS trades, count(DISTINCT market_slug) AS markets FROM v_trades GROUP BY 1), jn AS (SELECT * FROM tr LEFT JOIN rs USING (username) LEFT JOIN reg USING (username) LEFT JOIN sk USING (username)),
ia AS (SELECT username, 'WIN_RATE_ANOMALY' AS anomaly_type, CASE WHEN wr > 0.98 THEN 'CRITICAL' WHEN wr > 0.95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN wr > 0.98 THEN 30.0::DOUBLE ELSE 15.0::DOUBLE END AS integrity_impact, wr AS evidence FROM jn WHERE n >= 30 AND wr > 0.55
  UNION ALL SELECT username, 'TIMING_PATTERN', 'MEDIUM', 10, cv FROM jn WHERE cv < 0.1 AND avg_interval_ms < 5000
  UNION ALL SELECT username, 'VOLUME_INFLATION', 'LOW', 5, trades FROM jn WHERE trades > 100 AND markets = 1
  UNION ALL SELECT username, 'SCORE_GAMING', 'HIGH', 25, m/nullif(round(s, 9), 0) FROM jn WHERE n >= 30 AND m/nullif(round(s, 9), 0) > 0.2
  UNION ALL SELECT username, 'WIN_STREAK', 'MEDIUM', 15, max_win_streak FROM jn WHERE max_win_streak > 7)"""


def _alerts(t: Tables):
    return integrity.integrity_alerts(returns(t), t.trades(), F.col("ret") > 0, max_win_rate=0.55, sharpe_limit=0.2, max_streak=7)


@query("integrity_alerts", f"WITH {_CHECKS} SELECT username, anomaly_type, severity, integrity_impact + 0.0 AS integrity_impact, r6(evidence) AS evidence FROM ia")
def integrity_alerts(t: Tables):
    return rounded(_alerts(t))


@query("trader_integrity", f"""WITH {_CHECKS} SELECT username, r6(greatest(0, least(100, 100 - coalesce(sum(integrity_impact), 0)))) AS score, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'BLACKLISTED'
  WHEN count(*) FILTER (severity = 'HIGH') >= 2 THEN 'SUSPENDED' WHEN count(anomaly_type) > 0 THEN 'FLAGGED' ELSE 'TRUSTED' END AS status, count(anomaly_type) AS anomaly_count,
  count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM tr LEFT JOIN ia USING (username) GROUP BY username""")
def trader_integrity(t: Tables):
    return rounded(integrity.trader_integrity(_alerts(t), t.trades()))


# ---- drawdown and concentration --------------------------------------------------------------


@query("cumulative_pnl_drawdown", """WITH d AS (SELECT proxy_address, CAST(ts AS DATE) AS day, sum(CASE side WHEN 'SELL' THEN notional ELSE -notional END) AS pnl FROM v_trades GROUP BY ALL),
c AS (SELECT *, sum(pnl) OVER (PARTITION BY proxy_address ORDER BY day ROWS UNBOUNDED PRECEDING) AS cum FROM d), k AS (SELECT *, max(cum) OVER (PARTITION BY proxy_address ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM c)
SELECT proxy_address, r6(min(cum)) AS min_cumulative, r6(max(cum)) AS max_cumulative, r6(min(cum - peak)) AS max_drawdown, count(*) AS days FROM k GROUP BY 1""")
def cumulative_pnl_drawdown(t: Tables):
    from tradelens.plans import features
    return rounded(features.drawdown(features.daily_flow(t.trades())))


@query("top3_share_hhi", """WITH m AS (SELECT proxy_address, market_slug, sum(notional) AS v FROM v_trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY round(v, 6) DESC, market_slug) AS rn, sum(v) OVER (PARTITION BY proxy_address) AS tot FROM m)
SELECT proxy_address, r6(sum(v*v)/pow(max(tot), 2)) AS hhi, r6(sum(v) FILTER (rn <= 3)/max(tot)) AS top3_share FROM r GROUP BY 1""")
def top3_share_hhi(t: Tables):
    from tradelens.plans import features
    return rounded(features.concentration(t.trades()))


@query("edge_drop_signals", """WITH s AS (SELECT *, max(total_score) OVER (PARTITION BY proxy_address ORDER BY calculated_at, version ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS peak,
  row_number() OVER (PARTITION BY proxy_address ORDER BY calculated_at DESC, version DESC) AS rn FROM v_score_history)
SELECT proxy_address, total_score, peak AS recent_peak, peak - total_score AS score_drop, 'SELL' AS action FROM s WHERE rn = 1 AND peak - total_score > 15""")
def edge_drop_signals(t: Tables):
    from tradelens.plans import follow
    return follow.edge_drop_signals(t.score_history())
