"""Column functions, quality, replication, order lifecycle, research queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.q_reports import rounded
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables
from tradelens.functions import columns as C
from tradelens.functions.numeric import rnd
from tradelens.plans import backfill, enrich, orders, quality, replication, research
from tradelens.session import checkpointed, stored, work_folder

# ---- column functions ------------------------------------------------------------------------


@query("slug_epoch_end", """SELECT DISTINCT market_slug, CASE WHEN market_slug LIKE '%updown-15m-%' THEN CAST(split_part(market_slug, '-', 4) AS BIGINT) ELSE CAST(split_part(market_slug, '-', 2) AS BIGINT) END AS slug_epoch,
  CASE WHEN market_slug LIKE '%updown-15m-%' THEN make_timestamp((CAST(split_part(market_slug, '-', 4) AS BIGINT) + 900)*1000000) END AS slug_end FROM v_trades""")
def slug_epoch_end(t: Tables):
    s = t.trades().select("market_slug").distinct()
    return s.select("market_slug", C.slug_epoch("market_slug").alias("slug_epoch"), C.slug_end("market_slug").alias("slug_end"))


@query("series_classify", """SELECT event_key, series, CASE WHEN market_slug LIKE 'btc-updown-15m-%' THEN 'btc-15m' WHEN market_slug LIKE 'eth-updown-15m-%' THEN 'eth-15m' ELSE 'other' END AS replay_series FROM v_research""")
def series_classify(t: Tables):
    return t.trades().select("event_key", C.series_of("market_slug", "title").alias("series"), C.replay_series("market_slug").alias("replay_series"))


@query("asset_extract", "SELECT asset, count(*) AS trades FROM v_research GROUP BY 1")
def asset_extract(t: Tables):
    return t.trades().groupBy(C.asset_of("market_slug").alias("asset")).agg(F.count(F.lit(1)).alias("trades"))


@query("exec_type", "SELECT event_key, exec_type, tob_known FROM v_research")
def exec_type(t: Tables):
    return t.research().select("event_key", "exec_type", "tob_known")


@query("edge_and_spread", """SELECT event_key, r6(edge_vs_mid) AS edge_vs_mid, r6(effective_spread) AS effective_spread, r6(effective_spread_ratio) AS effective_spread_ratio, r6(tob_imbalance) AS tob_imbalance,
  CAST(tob_lag_millis AS DOUBLE) AS tob_lag_millis FROM v_research""")
def edge_and_spread(t: Tables):
    return rounded(t.research().select("event_key", "edge_vs_mid", "effective_spread", "effective_spread_ratio", "tob_imbalance",
                                       F.col("tob_lag_millis").cast("double").alias("tob_lag_millis")))


@query("settlement_from_prices", "SELECT event_key, is_resolved, resolved_outcome, settle_price, r6(realized_pnl) AS realized_pnl FROM v_enriched")
def settlement_from_prices(t: Tables):
    return rounded(t.enriched().select("event_key", "is_resolved", "resolved_outcome", "settle_price", "realized_pnl"))


@query("opposite_token", "SELECT event_key, CASE WHEN outcome = 'Up' THEN market_slug || ':Down' ELSE market_slug || ':Up' END AS opposite_token_id FROM v_trades")
def opposite_token(t: Tables):
    return t.enriched().select("event_key", C.opposite_token().alias("opposite_token_id"))


def _ladder(v: str, steps, rest) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {b} THEN {s}::DOUBLE" for b, s in steps) + f" ELSE {rest}::DOUBLE END"


_SIZE = "CASE series " + " ".join(f"WHEN '{n}' THEN {_ladder('coalesce(seconds_to_end, 0)', st, r)}" for n, (st, r) in C.REPLICA_SIZES.items()) + " ELSE 0 END"
_SERIES = """rs AS (SELECT * EXCLUDE (series), CASE WHEN market_slug LIKE 'btc-updown-15m-%' THEN 'btc-15m' WHEN market_slug LIKE 'eth-updown-15m-%' THEN 'eth-15m' ELSE 'other' END AS series FROM v_research)"""


@query("replica_size_schedule", f"""WITH {_SERIES} SELECT event_key, series, r2({_SIZE}) AS shares, r2(CASE series WHEN 'btc-15m' THEN 19 WHEN 'eth-15m' THEN 14 END) AS flat_shares FROM rs""")
def replica_size_schedule(t: Tables):
    rows = t.enriched().withColumn("series", C.replay_series("market_slug"))
    return rounded(rows.select("event_key", "series", C.replica_size("series", "seconds_to_end").alias("shares"), C.flat_size("series").alias("flat_shares")), 2)


_ENTRY = """sc AS (SELECT r.*, scenario, CASE scenario WHEN 'mid' THEN mid WHEN 'all_maker' THEN CASE side WHEN 'BUY' THEN best_bid_price ELSE best_ask_price END
  WHEN 'all_taker' THEN CASE side WHEN 'BUY' THEN best_ask_price ELSE best_bid_price END
  WHEN 'exec_proxy' THEN CASE exec_type WHEN 'MAKER_LIKE' THEN CASE side WHEN 'BUY' THEN best_bid_price ELSE best_ask_price END WHEN 'TAKER_LIKE' THEN CASE side WHEN 'BUY' THEN best_ask_price ELSE best_bid_price END
    WHEN 'INSIDE' THEN mid ELSE price END ELSE price END AS e0 FROM v_research r, (SELECT unnest(['actual', 'mid', 'exec_proxy', 'all_maker', 'all_taker']) AS scenario)),
se AS (SELECT *, coalesce(CASE WHEN e0 > 0 THEN e0 END, price) AS entry_price FROM sc),
sp AS (SELECT *, CASE WHEN scenario = 'actual' AND realized_pnl IS NOT NULL THEN realized_pnl ELSE size*CASE side WHEN 'SELL' THEN entry_price - settle_price ELSE settle_price - entry_price END END AS pnl, size*entry_price AS cost FROM se)"""


@query("entry_price_scenario", f"WITH {_ENTRY} SELECT event_key, scenario, r6(entry_price) AS entry_price FROM se")
def entry_price_scenario(t: Tables):
    return rounded(research.with_scenarios(t.research()).select("event_key", "scenario", "entry_price"))


@query("scenario_trade_pnl", f"WITH {_ENTRY} SELECT event_key, scenario, r6(pnl) AS pnl, r6(cost) AS cost FROM sp")
def scenario_trade_pnl(t: Tables):
    return rounded(research.with_scenarios(t.research()).select("event_key", "scenario", "pnl", "cost"))


@query("scenario_summary", f"""WITH {_ENTRY} SELECT scenario, count(pnl) AS trades, r6(sum(pnl)) AS pnl, r6(sum(cost) FILTER (pnl IS NOT NULL)) AS cost, r6(sum(pnl)/sum(cost) FILTER (pnl IS NOT NULL)) AS roi,
  r6(count(*) FILTER (round(pnl, 9) > 0)/count(pnl)) AS win_rate FROM sp GROUP BY 1""")
def scenario_summary(t: Tables):
    return rounded(research.scenario_summary(research.with_scenarios(t.research()), ["scenario"]))


@query("token_bucket_labels", """SELECT event_key, CASE WHEN seconds_to_end < 60 THEN '<1m' WHEN seconds_to_end < 180 THEN '1-3m' WHEN seconds_to_end < 300 THEN '3-5m' WHEN seconds_to_end < 600 THEN '5-10m' ELSE '10-15m' END AS bucket_15m,
  CASE WHEN price < 0.25 THEN '0-0.25' WHEN price < 0.5 THEN '0.25-0.5' WHEN price <= 0.75 THEN '0.5-0.75' ELSE '>0.75' END AS price_bin FROM v_enriched WHERE market_slug LIKE '%updown-15m-%'""")
def token_bucket_labels(t: Tables):
    rows = t.enriched().filter(C.is_15m("market_slug"))
    return rows.select("event_key", research.timing_label(F.col("seconds_to_end")).alias("bucket_15m"),
                       C.bucket_label(F.col("price"), [0, 0.25, 0.5, 0.75]).alias("price_bin"))


# ---- quality ---------------------------------------------------------------------------------


_CLEAN = """SELECT event_key, username, market_slug, series, token_id, outcome, side, price, size, CAST(seconds_to_end AS DOUBLE) AS seconds_to_end, r6(our_best_bid) AS our_best_bid, r6(our_best_ask) AS our_best_ask,
  r6(our_mid) AS our_mid, r6(other_best_bid) AS other_best_bid, tob_source, r6(complete_set_edge) AS complete_set_edge, is_resolved, settle_price, r6(realized_pnl) AS realized_pnl FROM v_clean"""


def clean_columns(clean):
    return rounded(clean.select(
        "event_key", "username", "market_slug", "series", "token_id", "outcome", "side", "price", "size", F.col("seconds_to_end").cast("double").alias("seconds_to_end"),
        "our_best_bid", "our_best_ask", "our_mid", "other_best_bid", "tob_source", "complete_set_edge", "is_resolved", "settle_price", "realized_pnl"))


@query("clean_trade_backfill", _CLEAN)
def clean_trade_backfill(t: Tables):
    return clean_columns(quality.clean_trades(t.enriched_opposite()))


@query("clean_trade_batches", _CLEAN)
def clean_trade_batches(t: Tables):
    """Two bounded batches behind a high-water mark, the first of them asked for again, give what one run over all gives."""
    trades, quotes = t.trades(), t.ws_tob()
    first, last = checkpointed(trades.agg(F.min("ts"), F.max("ts"))).first()

    def build(since, upto):
        some = backfill.bounded(trades, "ts", since, upto, 0).filter(C.is_updown("market_slug"))  # the rules keep no other market
        books = backfill.bounded(t.tob(), "captured_at", since, upto, 3600)
        recent = backfill.bounded(quotes, "ts", since, upto, 86_400)
        return quality.clean_trades(enrich.with_both_books(stored(enrich.trade_enrich(some, books, t.markets()), "enriched"), recent))

    path = f"{work_folder(t.spark, 'clean')}/table"
    for upto in (first + (last - first) / 2, first + (last - first) / 2, last):
        backfill.backfill(t.spark, path, upto, build, grain="month")
    return clean_columns(t.spark.read.parquet(path))


def _quality_sql(keys: str, key_expr: str) -> str:
    return f"""WITH raw AS (SELECT {key_expr}, count(*) AS total_raw, count(*) FILTER (seconds_to_end >= 0) AS has_time_to_end, count(*) FILTER (len(token_ids) = 2) AS has_both_tokens,
  count(*) FILTER (coalesce(ws_best_bid_price, best_bid_price) > 0) AS has_our_tob, count(*) FILTER (ws_best_bid_price > 0) AS has_ws_tob, count(*) FILTER (is_resolved) AS resolved FROM v_enriched_ws
  WHERE market_slug LIKE '%updown%' GROUP BY ALL), cl AS (SELECT {key_expr}, count(*) AS total_clean FROM v_clean GROUP BY ALL)
SELECT {keys}, total_raw, has_time_to_end, has_both_tokens, has_our_tob, has_ws_tob, resolved, coalesce(total_clean, 0) AS total_clean, r2(coalesce(total_clean, 0)*100.0/total_raw) AS clean_rate_pct,
  r2(has_ws_tob*100.0/total_raw) AS ws_coverage_pct, total_raw - coalesce(total_clean, 0) AS rejected_count FROM raw LEFT JOIN cl USING ({keys})"""


def quality_inputs(t: Tables):
    """The enriched trades with their own quotes, and those of them that pass the rules. What the rules read of the trades is written once; as they ask for up/down markets, others need no quote."""
    rows = t.enriched().filter(C.is_updown("market_slug")).select(
        "username", "ts", "market_slug", "token_id", "token_ids", "outcome", "outcomes", "side", "price", "mid", "best_bid_price", "best_ask_price", "tob_captured_at", "seconds_to_end", "is_resolved")
    rows = stored(rows, "enriched")
    return enrich.with_ws_book(rows, t.ws_tob()), quality.clean_trades(enrich.with_both_books(rows, t.ws_tob()))


@query("data_quality_metrics", _quality_sql("username", "username"))
def data_quality_metrics(t: Tables):
    raw, clean = quality_inputs(t)
    return quality.quality_metrics(raw, clean, ["username"])


@query("data_quality_by_day", _quality_sql("username, day", "username, CAST(ts AS DATE) AS day"))
def data_quality_by_day(t: Tables):
    day = lambda df: df.withColumn("day", F.to_date("ts"))
    raw, clean = quality_inputs(t)
    return quality.quality_metrics(day(raw), day(clean), ["username", "day"])


@query("coverage_report", """WITH r AS (SELECT '0xT' || o_orderkey AS h FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT e.*, r.h IS NOT NULL AS rc FROM v_enriched_ws e LEFT JOIN r ON r.h = e.transaction_hash),
k AS (SELECT ws_tob_lag_millis AS l, row_number() OVER (ORDER BY ws_tob_lag_millis) - 1 AS i, count(*) OVER () AS n FROM x WHERE ws_tob_lag_millis IS NOT NULL)
SELECT 'ALL' AS scope, count(*) AS trades, count(ws_tob_lag_millis) AS with_quote, r6(count(*) FILTER (ws_tob_lag_millis <= 500)/count(*)) AS within_500ms, r6(count(*) FILTER (ws_tob_lag_millis <= 2000)/count(*)) AS within_2s,
  r6(count(*) FILTER (rc)/count(*)) AS receipt_coverage, count(DISTINCT CASE WHEN rc THEN transaction_hash END) AS receipts_matched,
  (SELECT l FROM k WHERE i = floor(0.5::DOUBLE*n)) AS lag_p50, (SELECT l FROM k WHERE i = floor(0.9::DOUBLE*n)) AS lag_p90, (SELECT l FROM k WHERE i = floor(0.99::DOUBLE*n)) AS lag_p99 FROM x""")
def coverage_report(t: Tables):
    receipts = t.read("orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("0xT"), F.col("o_orderkey").cast("string")).alias("tx_hash"))
    return rounded(quality.coverage_report(t.enriched_ws(), receipts))


# ---- replication -----------------------------------------------------------------------------

_DEC = f"""inp AS (SELECT *, CASE WHEN market_slug LIKE 'btc-updown-15m-%' THEN 'btc-15m' WHEN market_slug LIKE 'eth-updown-15m-%' THEN 'eth-15m' END AS series, coalesce(ws_best_bid_price, best_bid_price) AS our_best_bid,
  ws_opp_best_bid_price AS other_best_bid, 1 - coalesce(ws_best_bid_price, best_bid_price, 0) - coalesce(ws_opp_best_bid_price, 0) AS complete_set_edge FROM v_enriched_opp WHERE market_slug LIKE '%updown-15m-%'),
d0 AS (SELECT *, {_SIZE} AS our_quote_size, our_best_bid AS our_quote_price, coalesce(seconds_to_end BETWEEN 0 AND 3600, FALSE) AS in_time_window,
  coalesce(our_best_bid > 0 AND other_best_bid > 0 AND complete_set_edge >= 0.01 - 1e-9, FALSE) AS has_sufficient_edge, coalesce(price <= our_best_bid + 0.01 + 1e-9, FALSE) AS fills FROM inp),
d AS (SELECT *, in_time_window AND has_sufficient_edge AS would_quote, CASE WHEN in_time_window AND has_sufficient_edge AND fills THEN 'MATCH' WHEN in_time_window AND has_sufficient_edge THEN 'WOULD_QUOTE_NO_FILL'
  WHEN NOT in_time_window THEN 'OUTSIDE_TIME_WINDOW' ELSE 'INSUFFICIENT_EDGE' END AS match_type,
  CASE WHEN in_time_window AND has_sufficient_edge AND fills THEN (settle_price - our_quote_price)*our_quote_size ELSE 0 END AS simulated_pnl FROM d0)"""


def _decisions(t: Tables):
    return replication.decide(replication.replay_input(t.enriched_opposite()))


@query("replication_validation", f"WITH {_DEC} SELECT event_key, series, match_type, would_quote, r6(our_quote_size) AS our_quote_size, r6(complete_set_edge) AS complete_set_edge, r6(simulated_pnl) AS simulated_pnl FROM d")
def replication_validation(t: Tables):
    return rounded(_decisions(t).select("event_key", "series", "match_type", "would_quote", "our_quote_size", "complete_set_edge", "simulated_pnl"))


def _score_sql(keys: str, table: str, would: str, hit: str) -> str:
    return f"""SELECT {keys}, count(*) AS total_trades, count(*) FILTER ({would}) AS would_quote, count(*) FILTER ({hit}) AS matches, r2(count(*) FILTER ({would})*100.0/count(*)) AS quote_rate_pct,
  r2(count(*) FILTER ({hit})*100.0/count(*)) AS match_rate_pct, r2(count(*) FILTER ({hit})*100.0/nullif(count(*) FILTER ({would}), 0)) AS fill_rate_pct, r6(avg(price - our_quote_price) FILTER ({hit})) AS avg_price_diff,
  r6(avg(abs(price - our_quote_price)) FILTER ({hit})) AS avg_abs_price_diff, r6(avg(size) FILTER ({hit})) AS avg_actual_size, r6(avg(our_quote_size) FILTER ({hit})) AS avg_our_size,
  r6(avg(size) FILTER ({hit})/avg(our_quote_size) FILTER ({hit})) AS size_ratio, r6(coalesce(sum(realized_pnl), 0)) AS reference_pnl, r6(coalesce(sum(simulated_pnl) FILTER ({hit}), 0)) AS simulated_pnl,
  r6(coalesce(sum(realized_pnl) FILTER ({hit}), 0)) AS reference_pnl_on_matches, r6(avg(complete_set_edge)) AS avg_edge FROM {table} GROUP BY {keys}"""


@query("replication_scores", f"WITH {_DEC} {_score_sql('series', 'd', 'would_quote', chr(109) + 'atch_type = ' + chr(39) + 'MATCH' + chr(39))}")
def replication_scores(t: Tables):
    return rounded(replication.replication_scores(_decisions(t), ["series"]))


@query("replication_by_time", f"""WITH {_DEC} SELECT CAST(floor(seconds_to_end/60)*60 AS BIGINT) AS bucket, match_type, count(*) AS trades FROM d WHERE seconds_to_end IS NOT NULL GROUP BY ALL""")
def replication_by_time(t: Tables):
    rows = _decisions(t).filter("seconds_to_end IS NOT NULL").withColumn("bucket", (F.floor(F.col("seconds_to_end") / 60) * 60).cast("bigint"))
    return replication.match_types(rows, ["bucket"])


_CLEAN_DEC = """c0 AS (SELECT *, CASE series WHEN 'btc-15m' THEN 19.0::DOUBLE ELSE 14.0::DOUBLE END AS our_quote_size, our_best_bid AS our_quote_price, seconds_to_end BETWEEN 0 AND 3600 AS tw, complete_set_edge >= 0.01 - 1e-9 AS ed,
  price <= our_best_bid + 0.01 + 1e-9 AS fills FROM v_clean),
c AS (SELECT *, tw AND ed AS would_quote, CASE WHEN tw AND ed AND fills THEN 'MATCH' WHEN tw AND ed THEN 'WOULD_QUOTE_NO_FILL' WHEN NOT tw THEN 'OUTSIDE_TIME_WINDOW' ELSE 'INSUFFICIENT_EDGE' END AS match_type,
  CASE WHEN tw AND ed AND fills THEN (settle_price - our_quote_price)*our_quote_size ELSE 0 END AS simulated_pnl FROM c0)"""


@query("replication_scores_clean", f"WITH {_CLEAN_DEC} {_score_sql('username', 'c', 'would_quote', chr(109) + 'atch_type = ' + chr(39) + 'MATCH' + chr(39))}")
def replication_scores_clean(t: Tables):
    return rounded(replication.replication_scores(replication.decide_clean(quality.clean_trades(t.enriched_opposite())), ["username"]))


@query("replication_medians_clean", f"""WITH {_CLEAN_DEC} SELECT series, r6(median(round(complete_set_edge, 6))) AS median_edge, r6(median(round(price - our_quote_price, 6)) FILTER (match_type = 'MATCH')) AS median_price_diff FROM c GROUP BY 1""")
def replication_medians_clean(t: Tables):
    d = replication.decide_clean(quality.clean_trades(t.enriched_opposite()))
    return rounded(replication.edge_medians(d, ["series"], F.col("match_type") == "MATCH"))


_V2 = f"""e0 AS (SELECT *, {_SIZE} AS our_quote_size, seconds_to_end BETWEEN 0 AND 3600 AS tw, complete_set_edge >= 0.0099 AS ed,
  complete_set_edge >= 0.0099 AND complete_set_edge < 0.015 AND our_best_ask - our_best_bid <= 0.02 + 1e-9 AS should_take, price <= our_best_bid + 0.005 AS mk, price >= our_best_ask - 0.005 AS tk, price <= our_best_bid + 0.01 + 1e-9 AS nb FROM v_clean),
e1 AS (SELECT *, tw AND ed AS would_trade, CASE WHEN should_take THEN tk ELSE nb END AS fills, CASE WHEN should_take THEN our_best_ask ELSE our_best_bid END AS our_quote_price FROM e0),
e AS (SELECT *, would_trade AND fills AS is_match, CASE WHEN would_trade AND should_take AND tk THEN 'TAKER_MATCH' WHEN would_trade AND NOT should_take AND mk THEN 'MAKER_MATCH' WHEN would_trade AND should_take AND mk THEN 'TAKER_MODE_BUT_MAKER_FILL'
  WHEN would_trade AND NOT should_take AND tk THEN 'MAKER_MODE_BUT_TAKER_FILL' WHEN would_trade AND NOT fills THEN 'WOULD_TRADE_NO_FILL' WHEN NOT tw THEN 'OUTSIDE_TIME_WINDOW' WHEN NOT ed THEN 'INSUFFICIENT_EDGE' ELSE 'UNKNOWN' END AS match_type,
  CASE WHEN would_trade AND fills THEN (settle_price - our_quote_price)*our_quote_size ELSE 0 END AS simulated_pnl FROM e1)"""


def _v2(t: Tables):
    return replication.decide_v2(quality.clean_trades(t.enriched_opposite()))


@query("replication_scores_v2", f"WITH {_V2} {_score_sql('series', 'e', 'would_trade', 'is_match')}")
def replication_scores_v2(t: Tables):
    return rounded(replication.replication_scores(_v2(t), ["series"], "would_trade", F.col("is_match")))


@query("replication_match_types_v2", f"WITH {_V2} SELECT series, match_type, count(*) AS trades FROM e GROUP BY ALL")
def replication_match_types_v2(t: Tables):
    return replication.match_types(_v2(t), ["series"])


@query("maker_taker_alignment", f"""WITH {_V2} SELECT series, count(*) AS total_trades, count(*) FILTER (mk) AS maker_fills, count(*) FILTER (tk) AS taker_fills, r2(count(*) FILTER (mk)*100.0/count(*)) AS maker_pct, r2(count(*) FILTER (tk)*100.0/count(*)) AS taker_pct,
  count(*) FILTER (should_take) AS would_take, count(*) FILTER (NOT should_take AND would_trade) AS would_make, r2(count(*) FILTER (should_take)*100.0/nullif(count(*) FILTER (would_trade), 0)) AS taker_rate_pct,
  count(*) FILTER (should_take AND tk) AS aligned_taker, count(*) FILTER (NOT should_take AND mk AND would_trade) AS aligned_maker,
  r2((count(*) FILTER (should_take AND tk) + count(*) FILTER (NOT should_take AND mk AND would_trade))*100.0/nullif(count(*) FILTER (would_trade), 0)) AS mode_alignment_pct FROM e GROUP BY 1""")
def maker_taker_alignment(t: Tables):
    return rounded(replication.maker_taker(_v2(t), ["series"]), 2)


_GROUPS = "g AS (SELECT r.*, s.total_score >= 60 AS strong FROM v_research r JOIN v_scores s USING (username))"
_MIX = f"""{_GROUPS}, cells AS (SELECT 'market' AS dimension, series AS bin, strong FROM g UNION ALL SELECT 'outcome', lower(outcome), strong FROM g UNION ALL SELECT 'exec', exec_type, strong FROM g
  UNION ALL SELECT 'size', CAST(CAST(size AS BIGINT) AS VARCHAR), strong FROM g),
cn AS (SELECT dimension, bin, count(*) FILTER (strong) AS na, count(*) FILTER (NOT strong) AS nb FROM cells GROUP BY ALL), tt AS (SELECT dimension, sum(na) AS ta, sum(nb) AS tb FROM cn GROUP BY 1),
dist AS (SELECT dimension, sum(abs(na/ta - nb/tb)) AS l1 FROM cn JOIN tt USING (dimension) GROUP BY 1)"""


def _mix(t: Tables):
    strong = t.scores().select("username", (F.col("total_score") >= 60).alias("strong"))
    rows = t.research().join(strong, "username")
    dims = {"market": F.col("series"), "outcome": F.lower("outcome"), "exec": F.col("exec_type"), "size": F.col("size").cast("bigint")}
    return replication.mix_distance(rows, F.col("strong"), ~F.col("strong"), dims)


@query("replication_distribution_distance", f"WITH {_MIX} SELECT dimension, r6(l1) AS l1 FROM dist")
def replication_distribution_distance(t: Tables):
    return rounded(_mix(t))


@query("replication_distribution_score", f"WITH {_MIX} SELECT r6(avg(l1)) AS avg_l1, r6(greatest(0, 100*(1 - avg(l1)/2))) AS score FROM dist")
def replication_distribution_score(t: Tables):
    return rounded(replication.distribution_score(_mix(t)))


@query("market_coverage", f"""WITH {_GROUPS}, a AS (SELECT market_slug, count(*) AS na FROM g WHERE strong GROUP BY 1), b AS (SELECT market_slug, count(*) AS nb FROM g WHERE NOT strong GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (market_slug))
SELECT count(na) AS markets_a, count(nb) AS markets_b, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS overlap, CAST(sum(na) AS BIGINT) AS trades_a, CAST(sum(na) FILTER (nb IS NOT NULL) AS BIGINT) AS trades_in_overlap,
  r2(count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL)*100.0/count(na)) AS overlap_pct, r2(sum(na) FILTER (nb IS NOT NULL)*100.0/sum(na)) AS trade_overlap_pct FROM j""")
def market_coverage(t: Tables):
    strong = t.strong_traders()
    return research.market_coverage(t.trades().join(strong, "username", "left_semi"), t.trades().join(strong, "username", "left_anti"))


@query("market_coverage_missing", f"""WITH {_GROUPS} SELECT market_slug, count(*) AS trades FROM g WHERE strong AND market_slug NOT IN (SELECT market_slug FROM g WHERE NOT strong) GROUP BY 1 ORDER BY trades DESC, market_slug LIMIT 50""")
def market_coverage_missing(t: Tables):
    strong = t.strong_traders()
    return research.missing_markets(t.trades().join(strong, "username", "left_semi"), t.trades().join(strong, "username", "left_anti"), 50)


# ---- decomposition ---------------------------------------------------------------------------


@query("pnl_decomposition", """SELECT outcome, series, exec_type, count(*) AS trades, r6(sum((settle_price - price)*size)) AS actual_pnl, r6(sum((settle_price - mid)*size)) AS direction_pnl, r6(sum((mid - price)*size)) AS execution_pnl,
  r6(sum((settle_price - best_bid_price)*size)) AS maker_pnl, r6(sum((settle_price - best_ask_price)*size)) AS taker_pnl, r6(count(*) FILTER (round((settle_price - price)*size, 9) > 0)/count(*)) AS win_rate,
  r6(coalesce(sum((settle_price - price)*size) FILTER (round((settle_price - price)*size, 9) > 0), 0)/nullif(abs(coalesce(sum((settle_price - price)*size) FILTER (round((settle_price - price)*size, 9) < 0), 0)), 0)) AS profit_factor,
  r6(avg(price)) AS avg_price, r6(avg(mid)) AS avg_mid, r6(avg(settle_price)) AS avg_settle FROM v_research WHERE settle_price IS NOT NULL AND mid > 0 GROUP BY ALL""")
def pnl_decomposition(t: Tables):
    return rounded(research.pnl_decomposition(t.research(), ["outcome", "series", "exec_type"]))


@query("edge_by_book_side", """WITH b AS (SELECT market_slug AS trade_key, outcome, best_bid_price AS bb, best_ask_price AS ba, captured_at, abs(epoch_us(captured_at) - epoch_us(date_trunc('day', captured_at) + INTERVAL 12 HOUR)) AS lag FROM v_tob),
m AS (SELECT trade_key, arg_min({'b': bb, 'a': ba}, (lag, captured_at, bb IS NOT NULL, coalesce(bb, 0), ba)) FILTER (outcome = 'Up') AS u, arg_min({'b': bb, 'a': ba}, (lag, captured_at, bb IS NOT NULL, coalesce(bb, 0), ba)) FILTER (outcome = 'Down') AS d FROM b GROUP BY 1),
f AS (SELECT * FROM m WHERE u.b IS NOT NULL AND d.b IS NOT NULL),
l AS (SELECT 'edge_bid' AS edge, round(1 - (u.b + d.b), 6) AS v FROM f UNION ALL SELECT 'edge_bid_ask', round(1 - (u.b + d.a), 6) FROM f UNION ALL SELECT 'edge_ask_bid', round(1 - (u.a + d.b), 6) FROM f UNION ALL SELECT 'edge_ask', round(1 - (u.a + d.a), 6) FROM f)
SELECT edge, count(*) AS n, r6(quantile_cont(v, 0.05)) AS p05, r6(quantile_cont(v, 0.1)) AS p10, r6(quantile_cont(v, 0.25)) AS p25, r6(quantile_cont(v, 0.5)) AS p50, r6(quantile_cont(v, 0.75)) AS p75, r6(quantile_cont(v, 0.9)) AS p90, r6(quantile_cont(v, 0.95)) AS p95 FROM l GROUP BY 1""")
def edge_by_book_side(t: Tables):
    books = t.tob().select(F.col("market_slug").alias("trade_key"), "outcome", "best_bid_price", "best_ask_price", "captured_at",
                           (F.date_trunc("day", "captured_at") + F.expr("INTERVAL 12 HOURS")).alias("trade_at"))
    return rounded(research.edge_by_book_side(books))


# ---- orders ----------------------------------------------------------------------------------


def lifecycle(t: Tables):
    return orders.order_lifecycle(t.strategy_orders(), t.order_status())


@query("order_lifecycle", """SELECT order_id, market_slug, placed_ts, r6(placed_price) AS placed_price, first_fill_ts, r6(filled_size) AS filled_size, last_exchange_status, cancel_ts, replace_count, CAST(fill_latency_ms AS DOUBLE) AS fill_latency_ms,
  CAST(cancel_latency_ms AS DOUBLE) AS cancel_latency_ms, CAST(ticks_above_best_bid AS DOUBLE) AS ticks_above_best_bid FROM v_lifecycle""")
def order_lifecycle(t: Tables):
    return rounded(lifecycle(t).select(
        "order_id", "market_slug", "placed_ts", "placed_price", "first_fill_ts", "filled_size", "last_exchange_status", "cancel_ts", "replace_count",
        *[F.col(c).cast("double").alias(c) for c in ("fill_latency_ms", "cancel_latency_ms", "ticks_above_best_bid")]))


@query("order_lifecycle_summary", """SELECT 'ALL' AS scope, count(*) AS orders_seen, count(placed_ts) AS orders_placed, count(first_fill_ts) AS orders_with_fill, count(cancel_ts) AS orders_canceled,
  count(*) FILTER (first_fill_ts IS NULL AND cancel_ts IS NULL) AS orders_unresolved, r6(avg(fill_latency_ms)/1000) AS avg_fill_latency_s, r6(avg(replace_count)) AS avg_replaces_per_order, r6(sum(replace_count)/count(placed_ts)) AS replaces_per_placed_order,
  r6(quantile_cont(fill_latency_ms/1000, 0.5)) AS median_fill_latency_s, r6(quantile_cont(fill_latency_ms/1000, 0.9)) AS p90_fill_latency_s FROM v_lifecycle""")
def order_lifecycle_summary(t: Tables):
    return rounded(orders.lifecycle_summary(lifecycle(t)))


@query("order_latency_histograms", """SELECT 'fill' AS kind, CAST(floor(fill_latency_ms/1000) AS BIGINT) AS bucket, count(*) AS orders FROM v_lifecycle WHERE fill_latency_ms IS NOT NULL GROUP BY 2
UNION ALL SELECT 'cancel', CAST(floor(cancel_latency_ms/1000) AS BIGINT), count(*) FROM v_lifecycle WHERE cancel_latency_ms IS NOT NULL GROUP BY 2
UNION ALL SELECT 'replace', replace_count, count(*) FROM v_lifecycle WHERE placed_ts IS NOT NULL GROUP BY 2""")
def order_latency_histograms(t: Tables):
    o = lifecycle(t)
    parts = [("fill", orders.seconds_bucket("fill_latency_ms"), None), ("cancel", orders.seconds_bucket("cancel_latency_ms"), None),
             ("replace", F.col("replace_count"), F.col("placed_ts").isNotNull())]
    out = None
    for kind, value, where in parts:
        h = orders.histogram(o, value, "bucket", where).withColumn("kind", F.lit(kind))
        out = h if out is None else out.unionByName(h)
    return out.select("kind", "bucket", "orders")


@query("order_fill_by_tick", """SELECT ticks_above_best_bid, count(*) AS orders, count(first_fill_ts) AS filled_orders, r2(count(first_fill_ts)*100.0/count(*)) AS fill_rate_pct,
  r6(quantile_cont(CASE WHEN first_fill_ts IS NOT NULL THEN fill_latency_ms/1000 END, 0.5)) AS median_fill_latency_s FROM v_lifecycle WHERE placed_ts IS NOT NULL AND ticks_above_best_bid IS NOT NULL GROUP BY 1""")
def order_fill_by_tick(t: Tables):
    return rounded(orders.fill_by_tick(lifecycle(t)))


_PER_TICK = """mf AS (SELECT * FROM v_lifecycle WHERE placed_price >= bid_at_place AND placed_price < ask_at_place AND fill_latency_ms >= 0),
pt AS (SELECT *, CASE WHEN med <= 0 THEN 1 ELSE 1 - pow(0.5, 1/greatest(1, round_even(med/250, 0))) END AS p_hat FROM (SELECT ticks_above_best_bid, count(*) AS n, quantile_cont(CAST(fill_latency_ms AS DOUBLE), 0.5) AS med FROM mf GROUP BY 1 HAVING count(*) >= 5))"""


@query("fill_model_per_tick", f"WITH {_PER_TICK} SELECT ticks_above_best_bid, n, r6(med) AS median_latency_ms, r6(p_hat) AS p_hat FROM pt")
def fill_model_per_tick(t: Tables):
    return rounded(orders.fill_model_per_tick(lifecycle(t)))


def _gp(v: str) -> str:
    return f"(CASE WHEN {v} <= 0 THEN 1 ELSE 1 - pow(0.5, 1/greatest(1, round_even({v}/250, 0))) END)"


@query("fill_model_calibration", f"""WITH {_PER_TICK}, fit AS (SELECT count(*) AS ticks, least(1, exp(coalesce(regr_intercept(ln(greatest(1e-9, least(1, p_hat))), ticks_above_best_bid), max(ln(p_hat))))) AS p0,
  exp(coalesce(regr_slope(ln(greatest(1e-9, least(1, p_hat))), ticks_above_best_bid), 0)) AS mult, max(p_hat) AS p_max FROM pt),
q AS (SELECT quantile_cont(CASE WHEN first_matched_size/requested_size BETWEEN 1e-12 AND 1 THEN round(first_matched_size/requested_size, 6) END, 0.5) AS frac,
  quantile_cont(CASE WHEN ticks_above_best_bid = 0 THEN CAST(fill_latency_ms AS DOUBLE) END, 0.1) AS q10, quantile_cont(CASE WHEN ticks_above_best_bid = 0 THEN CAST(fill_latency_ms AS DOUBLE) END, 0.5) AS q50,
  quantile_cont(CASE WHEN ticks_above_best_bid = 0 THEN CAST(fill_latency_ms AS DOUBLE) END, 0.9) AS q90 FROM mf)
SELECT ticks, r6(p0) AS p0, r6(mult) AS mult, r6(p_max) AS p_max, r6(frac) AS median_first_fill_share, r6(least(5, greatest(0.1, {_gp('q90')}/{_gp('q50')}))) AS queue_factor_min, r6(least(5, greatest(0.1, {_gp('q10')}/{_gp('q50')}))) AS queue_factor_max FROM fit, q""")
def fill_model_calibration(t: Tables):
    return rounded(orders.fill_model_calibration(lifecycle(t)).drop("scope"))


_FILLS = """fl AS (SELECT * FROM (SELECT *, matched_size - coalesce(lag(matched_size) OVER (PARTITION BY order_id ORDER BY ts, event_key), 0) AS delta FROM v_order_status WHERE matched_size IS NOT NULL) WHERE delta > 0),
mp AS (SELECT order_id, arg_max(market_slug, (ts, event_key)) AS market_slug, arg_max(direction, (ts, event_key)) AS direction FROM v_strategy_orders GROUP BY 1),
fills AS (SELECT order_id, ts, mp.market_slug, CASE WHEN direction = 'UP' THEN 'Up' ELSE 'Down' END AS outcome, side, requested_price AS price, delta AS size FROM fl JOIN mp USING (order_id))"""


@query("fills_from_status_deltas", f"WITH {_FILLS} SELECT * FROM fills")
def fills_from_status_deltas(t: Tables):
    return orders.fills_from_status(t.order_status(), t.strategy_orders())


@query("strategy_order_dashboard", f"""WITH {_FILLS}, p AS (SELECT market_slug, count(DISTINCT order_id) AS orders, count(*) FILTER (success AND action = 'PLACE') AS places, count(*) FILTER (success AND action = 'REPLACE') AS replaces,
  count(*) FILTER (success AND action = 'CANCEL') AS cancels, count(*) FILTER (NOT success) AS failures, max(ts) AS last_event_at FROM v_strategy_orders GROUP BY 1),
f AS (SELECT market_slug, count(*) AS fills, sum(size) AS filled_size, sum(price*size) AS filled_notional FROM fills GROUP BY 1)
SELECT p.*, coalesce(fills, 0) AS fills, r6(coalesce(filled_size, 0)) AS filled_size, r6(coalesce(filled_notional, 0)) AS filled_notional FROM p LEFT JOIN f USING (market_slug)""")
def strategy_order_dashboard(t: Tables):
    return rounded(orders.order_dashboard(t.strategy_orders(), t.order_status()))


def _bins(v: str, edges: tuple) -> str:
    last = len(edges) - 2
    steps = " ".join(f"WHEN {v} >= {edges[i]} AND {v} {'<=' if i == last else '<'} {edges[i + 1]} THEN {i}" for i in range(last + 1))
    return f"CASE {steps} WHEN {v} > {edges[-1]} THEN {last + 1} END"


_DAY_BINS = (0, 3600, 7200, 14400, 43200, 86400, 864000)


@query("order_stream_score", f"""WITH s AS (SELECT CASE WHEN username IN (SELECT username FROM v_scores WHERE total_score >= 60) THEN 'a' ELSE 'b' END AS stream, * FROM v_trades),
g AS (SELECT stream, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us, price <> lag(price) OVER w AS repriced FROM s WINDOW w AS (PARTITION BY stream, token_id ORDER BY ts, event_key)),
o AS (SELECT DISTINCT stream, outcome, market_slug, ts FROM s WHERE outcome IN ('Up', 'Down')),
l AS (SELECT stream, CASE outcome WHEN 'Up' THEN 'Down' ELSE 'Up' END AS other, market_slug, ts FROM s WHERE outcome IN ('Up', 'Down')),
a AS (SELECT l.*, o.ts AS before FROM l ASOF LEFT JOIN o ON l.stream = o.stream AND l.market_slug = o.market_slug AND l.other = o.outcome AND l.ts >= o.ts),
n AS (SELECT a.*, o.ts AS after FROM a ASOF LEFT JOIN o ON a.stream = o.stream AND a.market_slug = o.market_slug AND a.other = o.outcome AND a.ts <= o.ts),
p AS (SELECT stream, (epoch_us(after) - epoch_us(ts))/1e6 AS v FROM n WHERE after IS NOT NULL AND (before IS NULL OR epoch_us(ts) - epoch_us(before) > epoch_us(after) - epoch_us(ts)) AND after > ts),
i AS (SELECT stream, abs(u - d)/(u + d) AS v FROM (SELECT stream, market_slug, coalesce(sum(size) FILTER (outcome = 'Up'), 0) AS u, coalesce(sum(size) FILTER (outcome = 'Down'), 0) AS d FROM s GROUP BY ALL) WHERE u + d > 0),
c AS (SELECT 'cadence_l1' AS component, stream, {_bins('us/1e6', _DAY_BINS)} AS bin FROM g UNION ALL SELECT 'reprice_l1', stream, repriced::INTEGER FROM g
  UNION ALL SELECT 'pair_latency_l1', stream, {_bins('v', _DAY_BINS)} FROM p UNION ALL SELECT 'imbalance_l1', stream, {_bins('v', orders.IMBALANCE_BINS)} FROM i),
h AS (SELECT component, bin, count(*) FILTER (stream = 'a') AS x, count(*) FILTER (stream = 'b') AS y FROM c WHERE bin IS NOT NULL GROUP BY ALL)
SELECT component, r6(sum(abs(x/nullif(tx, 0) - y/nullif(ty, 0)))) AS l1 FROM (SELECT *, sum(x) OVER (PARTITION BY component) AS tx, sum(y) OVER (PARTITION BY component) AS ty FROM h) GROUP BY component""")
def order_stream_score(t: Tables):
    strong = t.strong_traders()
    return rounded(orders.order_stream_score(
        t.trades().join(strong, "username", "left_semi"), t.trades().join(strong, "username", "left_anti"), cadence=_DAY_BINS, latency=_DAY_BINS))


@query("rank_matched_hold", """WITH n AS (SELECT proxy_address, market_slug, token_id, side, ts, row_number() OVER (PARTITION BY proxy_address, market_slug, token_id, side ORDER BY ts, event_key) AS nth FROM v_trades)
SELECT b.proxy_address, b.market_slug, b.token_id, b.nth, b.ts AS bought_at, s.ts AS sold_at, CAST(epoch(s.ts) - epoch(b.ts) AS BIGINT) AS hold_seconds FROM n b JOIN n s ON b.proxy_address = s.proxy_address AND b.market_slug = s.market_slug
  AND b.token_id = s.token_id AND b.nth = s.nth WHERE b.side = 'BUY' AND s.side = 'SELL'""")
def rank_matched_hold(t: Tables):
    from tradelens.plans import features
    return features.hold_pairs(t.trades()).withColumn("nth", F.col("nth").cast("bigint"))
