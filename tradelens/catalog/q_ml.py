"""Feature tables, labels, drift, models, funds, follow signals, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.q_reports import rounded
from tradelens.catalog.q_traders import T0
from tradelens.catalog.registry import ORACLES, compose, query
from tradelens.catalog.tables import Tables, as_of
from tradelens.functions import columns as C
from tradelens.functions.numeric import rnd
from tradelens.operators import matching
from tradelens.plans import features, follow, fund, ml
from tradelens.session import checkpointed

_DAILY = "df AS (SELECT proxy_address, CAST(ts AS DATE) AS day, sum(CASE side WHEN 'SELL' THEN notional ELSE -notional END) AS pnl FROM v_trades GROUP BY ALL)"
_ACT = """ac AS (SELECT proxy_address, count(*) AS total_trades, count(DISTINCT CAST(ts AS DATE)) AS days_active, CAST(datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS INTEGER) AS span_days,
  count(*) FILTER (isodow(ts) IN (6, 7))/count(*) AS we FROM v_trades GROUP BY 1),
hh AS (SELECT proxy_address, hour(ts) AS h, count(*) AS n FROM v_trades GROUP BY ALL), hw AS (SELECT *, sum(n) OVER (PARTITION BY proxy_address) AS t FROM hh),
hr AS (SELECT proxy_address, -sum(n/t*log2(n/t))/log2(24) AS ent FROM hw GROUP BY 1)"""


@query("activity_features", f"""WITH {_ACT} SELECT proxy_address, total_trades, days_active, span_days, r6(ent) AS active_hours_entropy, r6(we) AS weekend_activity_ratio, r6(total_trades/span_days) AS trades_per_day,
  r6(days_active/span_days) AS days_active_ratio FROM ac JOIN hr USING (proxy_address)""")
def activity_features(t: Tables):
    return rounded(features.activity_features(t.trades()))


@query("risk_features", f"""WITH {_DAILY}, c AS (SELECT *, sum(pnl) OVER (PARTITION BY proxy_address ORDER BY day) AS cum FROM df), k AS (SELECT *, max(cum) OVER (PARTITION BY proxy_address ORDER BY day) AS peak FROM c),
g AS (SELECT proxy_address, count(*) AS days, sum(pnl) AS total_pnl, avg(pnl) AS m, stddev_samp(pnl) AS s, stddev_samp(pnl) FILTER (pnl < 0) AS d, count(*) FILTER (pnl < 0) AS nl, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win,
  coalesce(abs(avg(pnl) FILTER (pnl < 0)), 0) AS avg_loss, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, abs(coalesce(sum(pnl) FILTER (pnl < 0), 0)) AS lost, count(*) FILTER (pnl > 0)/count(*) AS win_rate, min(cum - peak) AS max_drawdown FROM k GROUP BY 1)
SELECT proxy_address, days, r6(total_pnl) AS total_pnl, r6(coalesce(m*sqrt(252)/nullif(round(s, 9), 0), 0)) AS sharpe_ratio, r6(CASE WHEN nl = 0 AND m > 0 THEN 10 ELSE coalesce(m*sqrt(252)/nullif(round(d, 9), 0), 0) END) AS sortino_ratio,
  r6(max_drawdown) AS max_drawdown, r6(CASE WHEN round(max_drawdown, 9) < 0 THEN total_pnl/abs(max_drawdown) ELSE 0 END) AS calmar_ratio, r6(win_rate) AS win_rate, r6(avg_win) AS avg_win, r6(avg_loss) AS avg_loss,
  r6(coalesce(avg_win/nullif(avg_loss, 0), 0)) AS win_loss_ratio, r6(coalesce(won/nullif(lost, 0), 0)) AS profit_factor FROM g""")
def risk_features(t: Tables):
    return rounded(features.risk_features(features.daily_flow(t.trades())))


@query("execution_features", """WITH g AS (SELECT *, CASE side WHEN 'BUY' THEN price - mid ELSE mid - price END AS gap FROM v_research)
SELECT proxy_address, count(*) AS trades, count(*) FILTER (tob_known) AS with_book, r6(count(*) FILTER (exec_type = 'MAKER_LIKE')/count(*) FILTER (tob_known)) AS maker_ratio, r6(count(*) FILTER (exec_type = 'TAKER_LIKE')/count(*) FILTER (tob_known)) AS taker_ratio,
  r6(coalesce(avg(gap/nullif(mid, 0)*10000) FILTER (tob_known), 0)) AS avg_slippage_bps, r6(count(*) FILTER (tob_known AND gap < 0)/count(*) FILTER (tob_known)) AS price_improvement_ratio FROM g GROUP BY 1""")
def execution_features(t: Tables):
    known = C.book_known()
    return rounded(features.execution_features(t.enriched(), C.exec_type(known), known))


@query("hft_features", """WITH m AS (SELECT proxy_address, market_slug, count(DISTINCT outcome) AS o, count(*) AS n, min(ts) AS a, max(ts) AS b FROM v_trades GROUP BY ALL),
g AS (SELECT proxy_address, count(*) FILTER (o = 2)/count(*) AS csr, count(*) FILTER (market_slug LIKE '%updown%')/count(*) AS ud, sum(n) AS t, epoch(max(b)) - epoch(min(a)) AS span FROM m GROUP BY 1)
SELECT proxy_address, r6(csr) AS complete_set_ratio, r6(ud) AS updown_market_ratio, r6(coalesce(span/nullif(t - 1, 0), 0)) AS avg_inter_trade_seconds, r6(coalesce(t/nullif(span, 0), 0)*3600) AS trades_per_hour FROM g""")
def hft_features(t: Tables):
    return rounded(features.hft_features(t.trades()))


@query("hold_features", """WITH n AS (SELECT proxy_address, market_slug, token_id, side, ts, row_number() OVER (PARTITION BY proxy_address, market_slug, token_id, side ORDER BY ts, event_key) AS nth FROM v_trades),
p AS (SELECT b.proxy_address, (epoch(s.ts) - epoch(b.ts))/3600 AS h FROM n b JOIN n s ON b.proxy_address = s.proxy_address AND b.market_slug = s.market_slug AND b.token_id = s.token_id AND b.nth = s.nth WHERE b.side = 'BUY' AND s.side = 'SELL' AND s.ts >= b.ts)
SELECT proxy_address, count(*) AS closed_pairs, r6(avg(h)) AS avg_hold_hours, r6(stddev_pop(h)) AS hold_time_std, r6(count(*) FILTER (h < 1)/count(*)) AS scalper_ratio, r6(count(*) FILTER (h >= 24)/count(*)) AS swing_trader_ratio FROM p GROUP BY 1""")
def hold_features(t: Tables):
    return rounded(features.hold_features(features.hold_pairs(t.trades())))


def feature_table(t: Tables):
    return ml.ml_features(t.trades(), t.enriched())


@query("ml_features_batch")
def ml_features_batch(t: Tables):
    return rounded(feature_table(t))


def _feature_sql() -> str:
    """The feature table joined from the SQL of its parts; a figure that a trader lacks counts as 0."""
    concentration = compose("""WITH m AS (SELECT proxy_address, market_slug, sum(notional) AS v FROM v_trades GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY round(v, 6) DESC, market_slug) AS rn,
  sum(v) OVER (PARTITION BY proxy_address) AS tot FROM m) SELECT proxy_address, r6(sum(v*v)/pow(max(tot), 2)) AS hhi, r6(sum(v) FILTER (rn <= 3)/max(tot)) AS top3_share FROM r GROUP BY 1""")
    base = compose("SELECT proxy_address, r6(sum(notional)) AS total_volume_usd, count(DISTINCT market_slug) AS unique_markets FROM v_trades GROUP BY 1")
    parts = [
        (ORACLES["risk_features"], "total_pnl sharpe_ratio sortino_ratio max_drawdown calmar_ratio win_rate avg_win avg_loss win_loss_ratio profit_factor"), (concentration, "hhi top3_share"),
        (ORACLES["hft_features"], "complete_set_ratio updown_market_ratio avg_inter_trade_seconds trades_per_hour"),
        (ORACLES["execution_features"], "with_book maker_ratio taker_ratio avg_slippage_bps price_improvement_ratio"),
        (ORACLES["hold_features"], "avg_hold_hours hold_time_std scalper_ratio swing_trader_ratio"), (base, "total_volume_usd unique_markets")]
    shown = ", ".join(f"coalesce(p{k}.{c}, 0) AS {c}" for k, (_, names) in enumerate(parts) for c in names.split())
    joins = " ".join(f"LEFT JOIN ({text}) p{k} ON p{k}.proxy_address = a.proxy_address" for k, (text, _) in enumerate(parts))
    return f"SELECT a.*, {shown} FROM ({ORACLES['activity_features']}) a {joins} WHERE a.total_trades >= 5"


ORACLES["ml_features_batch"] = _feature_sql()


@query("trade_sequences", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY ts DESC, event_key DESC) AS rn FROM v_trades), k AS (SELECT * FROM r WHERE rn <= 100),
s AS (SELECT *, ln(1 + greatest(coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY proxy_address ORDER BY ts, event_key), 0), 0)) AS lg FROM k)
SELECT proxy_address, CAST(count(*) AS INTEGER) AS length, r6(sum(lg)) AS sum_log_gap, r6(sum(ln(1 + notional))) AS sum_log_notional, r6(arg_min(price, (ts, event_key))) AS first_price, r6(arg_max(price, (ts, event_key))) AS last_price FROM s GROUP BY 1""")
def trade_sequences(t: Tables):
    s = features.trade_sequences(t.trades())
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[i])
    return rounded(s.select("proxy_address", "length", total(0).alias("sum_log_gap"), total(2).alias("sum_log_notional"), F.col("sequence")[0][1].alias("first_price"),
                            F.element_at("sequence", -1)[1].alias("last_price")))


_LAB = f"""{_DAILY}, fl AS (SELECT proxy_address, count(*) AS n, avg(pnl) AS m, stddev_pop(pnl) AS s FROM df GROUP BY 1),
lb AS (SELECT proxy_address, CAST(CASE tier WHEN 'DIAMOND' THEN 3 WHEN 'GOLD' THEN 2 WHEN 'SILVER' THEN 1 ELSE 0 END AS INTEGER) AS tier_label, CAST(total_score AS DOUBLE) AS score_label,
  coalesce(nullif(sharpe_ratio, 0), CASE WHEN n >= 5 AND round(s, 9) > 0 THEN m/s*sqrt(252) END, 0) AS sharpe_label, first_trade_at FROM v_scores LEFT JOIN fl USING (proxy_address) JOIN (SELECT proxy_address, min(ts) AS first_trade_at FROM v_trades GROUP BY 1) USING (proxy_address))"""


def labels(t: Tables):
    first = t.trades().groupBy("proxy_address").agg(F.min("ts").alias("first_trade_at"))
    return ml.training_labels(t.scores(), features.daily_flow(t.trades()), first)


@query("training_labels", f"WITH {_LAB} SELECT proxy_address, tier_label, score_label, r6(sharpe_label) AS sharpe_label, first_trade_at FROM lb")
def training_labels(t: Tables):
    return rounded(labels(t))


@query("temporal_split", f"WITH {_LAB}, p AS (SELECT *, percent_rank() OVER (ORDER BY first_trade_at) AS pr FROM lb) SELECT proxy_address, CASE WHEN pr < 0.8 THEN 'train' WHEN pr < 0.9 THEN 'validation' ELSE 'test' END AS split FROM p")
def temporal_split(t: Tables):
    return ml.temporal_split(labels(t)).select("proxy_address", "split")


@query("class_weights", f"WITH {_LAB}, c AS (SELECT tier_label, count(*) AS n FROM lb GROUP BY 1) SELECT tier_label, n, r6(1.0/n/(SELECT sum(1.0/n) FROM c)*4) AS weight FROM c")
def class_weights(t: Tables):
    return rounded(ml.class_weights(labels(t)))


def model_rows(t: Tables):
    cols = ["total_trades", "sharpe_ratio", "win_rate", "hhi", "maker_ratio", "trades_per_day"]
    known = checkpointed(labels(t))
    split = ml.temporal_split(known).select("proxy_address", "tier_label", "sharpe_label", "split")
    rows = feature_table(t).select("proxy_address", *[F.col(c).cast("double").alias(c) for c in cols]).join(split, "proxy_address")
    # the forests draw rows by their places, which must not depend on how the joins above were planned
    return checkpointed(rows.repartition("proxy_address").sortWithinPartitions("proxy_address")), cols, ml.class_weights(known)


@query("tier_and_sharpe_model")
def tier_and_sharpe_model(t: Tables):
    rows, cols, weights = model_rows(t)
    train = rows.filter("split = 'train'")
    return ml.model_scores(ml.fit_tier_and_sharpe(train, cols, weights, trees=5), rows.filter("split != 'train'"))


CLUSTER_COLUMNS = ["hhi", "top3_share", "complete_set_ratio", "updown_market_ratio", "trades_per_hour"]


def clustered(t: Tables):
    rows = features.concentration(t.trades()).join(features.hft_features(t.trades()), "proxy_address")
    return ml.strategy_clustering(ml.standardised(checkpointed(rows), CLUSTER_COLUMNS))


@query("strategy_clustering")
def strategy_clustering(t: Tables):
    return rounded(ml.cluster_profiles(clustered(t), CLUSTER_COLUMNS))


#: What an anomaly is called by the column that tells it apart.
ANOMALY_KINDS = {"hhi": "CONCENTRATION", "top3_share": "CONCENTRATION", "complete_set_ratio": "COMPLETE_SETS", "updown_market_ratio": "MARKET_CHOICE", "trades_per_hour": "TRADING_SPEED"}


@query("outlier_detection")
def outlier_detection(t: Tables):
    rows = features.concentration(t.trades()).join(features.hft_features(t.trades()), "proxy_address")
    return rounded(ml.outlier_detection(rows, "proxy_address", CLUSTER_COLUMNS, ANOMALY_KINDS))


@query("feature_importance")
def feature_importance(t: Tables):
    rows, cols, weights = model_rows(t)
    tier, _ = ml.fit_tier_and_sharpe(rows.filter("split = 'train'"), cols, weights, trees=5)
    return rounded(ml.feature_importance(tier, cols, t.spark))


@query("hour_sequences", """SELECT proxy_address, event_key, r6(sin(hour(ts)*2*3.141592653589793/24)) AS hour_sin, r6(cos(hour(ts)*2*3.141592653589793/24)) AS hour_cos, r6(price) AS price, CASE side WHEN 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side,
  r6(ln(1 + notional)) AS log_notional, CAST(n - rn + 1 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY ts DESC, event_key DESC) AS rn, least(count(*) OVER (PARTITION BY proxy_address), 100) AS n FROM v_trades) WHERE rn <= 100""")
def hour_sequences(t: Tables):
    s = features.hour_sequences(t.trades()).select("proxy_address", F.posexplode("sequence").alias("i", "x"))
    return rounded(s.select("proxy_address", "x.event_key", "x.hour_sin", "x.hour_cos", "x.price", "x.side", "x.log_notional", (F.col("i") + 1).cast("int").alias("place")))


_KS = """ev AS (SELECT 'value' AS feature, value AS v, ts >= TIMESTAMP '2024-01-16' AS cur FROM events UNION ALL SELECT 'user', CAST(user_id AS DOUBLE), ts >= TIMESTAMP '2024-01-16' FROM events
  UNION ALL SELECT 'hour', CAST(hour(ts) + CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 3 ELSE 0 END AS DOUBLE), ts >= TIMESTAMP '2024-01-16' FROM events),
cu AS (SELECT DISTINCT feature, v, count(*) FILTER (NOT cur) OVER (PARTITION BY feature ORDER BY v) AS ca, count(*) FILTER (cur) OVER (PARTITION BY feature ORDER BY v) AS cb, count(*) FILTER (NOT cur) OVER (PARTITION BY feature) AS ta,
  count(*) FILTER (cur) OVER (PARTITION BY feature) AS tb FROM ev),
ks AS (SELECT feature, max(abs(ca/ta - cb/tb)) AS d, max(ta) AS ta, max(tb) AS tb FROM cu GROUP BY 1), mo AS (SELECT feature, avg(v) FILTER (NOT cur) AS bm, avg(v) FILTER (cur) AS cm, stddev_pop(v) FILTER (NOT cur) AS bs FROM ev GROUP BY 1),
kl AS (SELECT *, (sqrt(ta*tb/(ta + tb)) + 0.12 + 0.11/sqrt(ta*tb/(ta + tb)))*d AS l FROM ks JOIN mo USING (feature)),
dr AS (SELECT *, CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, 2*list_sum(list_transform(range(1, 41), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END*exp(-2.0::DOUBLE*k*k*l*l))))) END AS p, abs(cm - bm)/bs AS eff FROM kl)"""


def drift(t: Tables):
    e = t.read("events")
    late = F.col("ts") >= F.to_timestamp(F.lit("2024-01-16"))
    cols = lambda df, shift: df.select("value", F.col("user_id").cast("double").alias("user"), (F.hour("ts") + shift).cast("double").alias("hour"))
    return ml.feature_drift(cols(e.filter(~late), 0), cols(e.filter(late), 3), ["value", "user", "hour"])


@query("feature_drift", f"""WITH {_KS} SELECT feature, r6(d) AS ks_statistic, r6(p) AS ks_pvalue, r6(eff) AS effect_size, p < 0.01 AS is_drifted,
  CASE WHEN p >= 0.01 THEN 'none' WHEN eff < 0.5 THEN 'low' WHEN eff < 1 THEN 'medium' ELSE 'high' END AS severity FROM dr""")
def feature_drift(t: Tables):
    return rounded(drift(t).select("feature", "ks_statistic", "ks_pvalue", "effect_size", "is_drifted", "severity"))


@query("drift_report", f"""WITH {_KS} SELECT count(*) AS n_features, count(*) FILTER (p < 0.01) AS n_drifted, r6(count(*) FILTER (p < 0.01)/count(*)) AS drift_ratio,
  CASE WHEN count(*) FILTER (p < 0.01)/count(*) >= 0.3 THEN 'critical' WHEN count(*) FILTER (p < 0.01)/count(*) >= 0.1 THEN 'warning' ELSE 'normal' END AS alert_level FROM dr""")
def drift_report(t: Tables):
    return rounded(ml.drift_report(drift(t)))


@query("retrain_decision", f"""WITH s AS (SELECT model_version, max(anomaly_score) AS dr, count(*)*1000 AS nt, TIMESTAMP '2001-10-01' + to_seconds(CAST(right(model_version, 1) AS BIGINT)*864000) AS lt FROM v_ml_scores GROUP BY 1),
a AS (SELECT *, CAST(floor((epoch({T0}) - epoch(lt))/86400) AS INTEGER) AS age FROM s)
SELECT model_version, dr >= 0.3 OR age >= 30 OR nt >= 100000 AS should_retrain, CASE WHEN dr >= 0.3 OR age >= 30 OR nt >= 100000 THEN concat_ws('; ', CASE WHEN dr >= 0.3 THEN 'Critical drift: ' || printf('%.1f', dr*100) || '% features drifted' END,
  CASE WHEN age >= 30 THEN 'Model is ' || age || ' days old (max: 30)' END, CASE WHEN nt >= 100000 THEN nt || ' new trades available' END) ELSE 'No retraining needed' END AS reason FROM a""")
def retrain_decision(t: Tables):
    state = t.ml_scores().groupBy("model_version").agg(F.max("anomaly_score").alias("drift_ratio"), (F.count(F.lit(1)) * 1000).alias("new_trades")).withColumn(
        "last_train_at", F.to_timestamp(F.lit("2001-10-01")) + F.make_dt_interval(F.right("model_version", F.lit(1)).cast("int") * 10))
    return ml.retrain_decision(state, as_of()).select("model_version", "should_retrain", "reason")


@query("random_trader_sample")
def random_trader_sample(t: Tables):
    return ml.random_trader_sample(t.trades(), seed=7, share=0.25)


@query("block_bootstrap")
def block_bootstrap(t: Tables):
    units = ml.decision_units(t.enriched().filter("realized_pnl IS NOT NULL").withColumn("pnl", F.col("realized_pnl")), ["market_slug"])
    return rounded(ml.bootstrap_quantiles(ml.block_bootstrap(units, ["market_slug"], iterations=200, block=50)))


# ---- style -----------------------------------------------------------------------------------

_DNA = """b AS (SELECT proxy_address, count(*) AS tc, avg(size) AS av, stddev_pop(size) AS sd, count(DISTINCT market_slug) AS um, avg(hour(ts)) AS ah FROM v_trades GROUP BY 1),
n AS (SELECT proxy_address, market_slug, token_id, side, ts, row_number() OVER (PARTITION BY proxy_address, market_slug, token_id, side ORDER BY ts, event_key) AS nth FROM v_trades),
h AS (SELECT b.proxy_address, avg((epoch(s.ts) - epoch(b.ts))/3600) AS ho FROM n b JOIN n s ON b.proxy_address = s.proxy_address AND b.market_slug = s.market_slug AND b.token_id = s.token_id AND b.nth = s.nth WHERE b.side = 'BUY' AND s.side = 'SELL' AND s.ts >= b.ts GROUP BY 1),
w AS (SELECT proxy_address, count(*) FILTER (realized_pnl > 0)/count(*) AS wt FROM v_enriched WHERE realized_pnl IS NOT NULL GROUP BY 1),
d AS (SELECT proxy_address, tc, sd/av AS cv, sd, tc/um AS tpm, ah, coalesce(ho, 24) AS ho, coalesce(wt, 0.5) AS wt FROM b LEFT JOIN h USING (proxy_address) LEFT JOIN w USING (proxy_address)),
v AS (SELECT *, [least(1, ho/168), least(1, sd/100), least(1, tpm/10), least(1, tpm/20), least(1, wt), least(1, tc/1000)] AS vec FROM d)"""


def dna(t: Tables):
    won = t.enriched().filter("realized_pnl IS NOT NULL").groupBy("proxy_address").agg(
        (F.count(F.when(F.col("realized_pnl") > 0, 1)) / F.count(F.lit(1))).alias("win_tendency"))
    return ml.strategy_dna(t.trades(), features.hold_features(features.hold_pairs(t.trades())), won)


@query("strategy_dna", f"""WITH {_DNA} SELECT proxy_address, CASE WHEN ah < 10 THEN 'EARLY_BIRD' WHEN ah > 20 THEN 'NIGHT_OWL' ELSE 'MARKET_HOURS' END AS timing_style,
  CASE WHEN cv < 0.1 THEN 'FIXED' WHEN cv < 0.3 THEN 'SCALED' WHEN cv > 0.8 THEN 'RANDOM' ELSE 'KELLY' END AS sizing_style, CASE WHEN ho < 1 THEN 'SCALPER' WHEN ho < 24 THEN 'DAY_TRADER' WHEN ho < 168 THEN 'SWING_TRADER' ELSE 'POSITION_TRADER' END AS holding_style,
  CASE WHEN tpm > 10 THEN 'AGGRESSIVE' WHEN tpm < 3 THEN 'PASSIVE' ELSE 'BALANCED' END AS entry_style, CASE WHEN wt > 0.7 THEN 'TIGHT_STOPS' WHEN wt < 0.3 THEN 'WIDE_STOPS' ELSE 'SCALE_OUT' END AS risk_style,
  r6(list_sum(vec)) AS vector_sum, r6(least(100, list_sum(list_transform(vec, lambda x: (x - 0.5)*(x - 0.5)))/6*200)) AS uniqueness FROM v""")
def strategy_dna(t: Tables):
    return rounded(dna(t).select("proxy_address", "timing_style", "sizing_style", "holding_style", "entry_style", "risk_style",
                                 F.aggregate("dna_vector", F.lit(0.0), lambda a, x: a + x).alias("vector_sum"), "uniqueness"))


CENTRES = [(0, [1.0, 0.1, 0.1, 0.1, 0.5, 0.2]), (1, [0.1, 0.5, 0.9, 0.4, 0.5, 0.2]), (2, [0.9, 0.2, 0.2, 0.1, 0.1, 0.1])]


@query("nearest_cluster", f"""WITH {_DNA}, s AS (SELECT proxy_address, c.id, list_dot_product(v.vec, c.vec)/sqrt(list_dot_product(v.vec, v.vec)*list_dot_product(c.vec, c.vec)) AS sim FROM v,
  (VALUES {', '.join(f"({i}, {[float(x) for x in c]}::DOUBLE[])" for i, c in CENTRES)}) c(id, vec))
SELECT proxy_address, CAST(arg_max(id, (round(sim, 12), -id)) AS INTEGER) AS cluster_id, r6(max(sim)) AS similarity FROM s GROUP BY 1""")
def nearest_cluster(t: Tables):
    return rounded(ml.nearest_cluster(dna(t), "dna_vector", CENTRES).select("proxy_address", "cluster_id", "similarity"))


# ---- funds -----------------------------------------------------------------------------------


def transactions(t: Tables):
    k = F.col("o_orderkey")
    nav = (F.lit(1) + (k % 100) / F.lit(1000.0)).cast("decimal(18,8)")
    return t.read("orders").select(
        F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("wallet_address"), F.substring("o_orderpriority", 1, 1).alias("fund_type"),
        F.when(F.col("o_orderstatus") == "P", "WITHDRAW").otherwise("DEPOSIT").alias("tx_type"), F.col("o_totalprice").cast("decimal(18,6)").alias("usdc_amount"),
        F.round(F.col("o_totalprice").cast("decimal(18,6)") / nav, 6).cast("decimal(18,6)").alias("shares_amount"), nav.alias("nav_per_share"),
        F.when(k % 20 == 0, "pending").otherwise("confirmed").alias("status"), F.col("o_orderdate").alias("ts"), F.lpad(k.cast("string"), 12, "0").alias("tx_id"))


_TXN = """tx AS (SELECT 'w' || o_custkey AS wallet_address, left(o_orderpriority, 1) AS fund_type, CASE o_orderstatus WHEN 'P' THEN 'WITHDRAW' ELSE 'DEPOSIT' END AS tx_type, CAST(o_totalprice AS DECIMAL(18,6)) AS usdc_amount,
  CAST(round(o_totalprice/(1 + (o_orderkey % 100)/1000.0::DOUBLE), 6) AS DOUBLE) AS shares_amount, 1 + (o_orderkey % 100)/1000.0::DOUBLE AS nav, CASE WHEN o_orderkey % 20 = 0 THEN 'pending' ELSE 'confirmed' END AS status, o_orderdate AS ts, o_orderkey FROM orders)"""


@query("share_ledger_deposits", f"""WITH {_TXN} SELECT wallet_address, fund_type, r4(sum(shares_amount)) AS shares_balance, r4(sum(usdc_amount)) AS cost_basis_usdc, min(ts) AS first_deposit_at, max(ts) AS last_activity_at FROM tx WHERE tx_type = 'DEPOSIT' GROUP BY ALL""")
def share_ledger_deposits(t: Tables):
    return fund.share_balances(transactions(t)).withColumns({c: rnd(c, 4) for c in ("shares_balance", "cost_basis_usdc")})


@query("fund_nav", f"""WITH {_TXN}, c AS (SELECT fund_type, sum(CASE tx_type WHEN 'DEPOSIT' THEN usdc_amount ELSE -usdc_amount END) AS cash FROM tx WHERE status = 'confirmed' GROUP BY 1),
p AS (SELECT CAST(1 + p_partkey % 5 AS VARCHAR) AS fund_type, sum(p_size*CAST(p_retailprice AS DECIMAL(18,6))) AS pv, count(*) AS num_positions FROM part WHERE p_size > 0 GROUP BY 1),
s AS (SELECT fund_type, count(DISTINCT wallet_address) AS num_depositors, sum(shares_amount) AS sh, sum(usdc_amount) AS cb FROM tx WHERE tx_type = 'DEPOSIT' GROUP BY 1)
SELECT fund_type, r2(cash) AS cash, r2(pv) AS position_value, num_positions, num_depositors, r2(cash + pv) AS total_value, r6((cash + pv)/sh) AS nav_per_share, r2(cash + pv - cb) AS total_pnl FROM c JOIN p USING (fund_type) JOIN s USING (fund_type)""")
def fund_nav(t: Tables):
    positions = t.read("part").select((F.col("p_partkey") % 5 + 1).cast("string").alias("fund_type"), F.col("p_size").cast("decimal(18,6)").alias("shares"),
                                      F.col("p_retailprice").cast("decimal(18,6)").alias("current_price"))
    out = fund.fund_nav(transactions(t), positions, fund.share_balances(transactions(t)))
    return out.select("fund_type", "num_positions", "num_depositors", rnd("nav_per_share").alias("nav_per_share"),
                      *[rnd(c, 2).alias(c) for c in ("cash", "position_value", "total_value", "total_pnl")])


def nav_history(t: Tables):
    e = t.read("events")
    return e.select(F.col("event_type").alias("fund_type"), F.col("ts").alias("calculated_at"), (F.lit(1) + F.col("value") / 1000).alias("nav_per_share"))


_NAV = "nh AS (SELECT event_type AS fund_type, ts AS calculated_at, 1 + value/1000 AS nav FROM events)"


@query("nav_history_buckets", f"WITH {_NAV} SELECT fund_type, time_bucket(INTERVAL 1 HOUR, calculated_at) AS bucket, r6(arg_max(nav, (calculated_at, nav))) AS nav_per_share, count(*) AS points FROM nh GROUP BY ALL")
def nav_history_buckets(t: Tables):
    return rounded(fund.nav_history_buckets(nav_history(t), 3600))


@query("nav_returns", f"""WITH {_NAV}, r AS (SELECT *, nav/lag(nav) OVER w - 1 AS ret, max(nav) OVER w AS peak FROM nh WINDOW w AS (PARTITION BY fund_type ORDER BY calculated_at, nav)),
a AS (SELECT fund_type, count(*) AS points, arg_max(nav, (calculated_at, nav)) AS cur, arg_min(nav, (calculated_at, nav)) AS f, arg_max(nav, (calculated_at, nav)) FILTER (calculated_at <= TIMESTAMP '2024-01-31' - INTERVAL 1 DAY) AS d1,
  arg_max(nav, (calculated_at, nav)) FILTER (calculated_at <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS d7, arg_max(nav, (calculated_at, nav)) FILTER (calculated_at <= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS d30,
  avg(ret) AS m, stddev_samp(ret) AS s, max((peak - nav)/peak*100) AS dd FROM r GROUP BY 1)
SELECT fund_type, points, r6(cur) AS nav, r4(coalesce((cur - d1)*100/d1, 0)) AS return_24h_pct, r4(coalesce((cur - d7)*100/d7, 0)) AS return_7d_pct, r4(coalesce((cur - d30)*100/d30, 0)) AS return_30d_pct, r4((cur - f)*100/f) AS return_inception_pct,
  r4(CASE WHEN points >= 7 AND round(s, 12) > 0 THEN m/s*sqrt(252) ELSE 0 END) AS sharpe_ratio, r4(dd) AS max_drawdown_pct FROM a""")
def nav_returns(t: Tables):
    out = fund.nav_returns(nav_history(t), F.to_timestamp(F.lit("2024-01-31")))
    return out.select("fund_type", "points", rnd("nav").alias("nav"), *[rnd(c, 4).alias(c) for c in out.columns[3:]])


_HOLD = f"""{_TXN}, sh AS (SELECT wallet_address, fund_type, sum(shares_amount) AS b, CAST(sum(usdc_amount) AS DOUBLE) AS c FROM tx WHERE tx_type = 'DEPOSIT' GROUP BY ALL), nv AS (SELECT fund_type, avg(nav) AS n FROM tx GROUP BY 1),
hd AS (SELECT *, b*n AS v, b*n - c AS pnl, (b*n - c)*100/c AS pct FROM sh JOIN nv USING (fund_type))"""


def holdings(t: Tables):
    x = transactions(t)
    nav = x.groupBy("fund_type").agg(F.avg(F.col("nav_per_share").cast("double")).alias("nav_per_share"))
    s = fund.share_balances(x).withColumns({c: F.col(c).cast("double") for c in ("shares_balance", "cost_basis_usdc")})
    return fund.user_holdings(s, nav)


@query("user_holdings", f"WITH {_HOLD} SELECT wallet_address, fund_type, r2(v) AS value, r2(pnl) AS pnl, r4(pct) AS pnl_pct, r4(v/sum(v) OVER (PARTITION BY wallet_address)) AS weight FROM hd")
def user_holdings(t: Tables):
    return holdings(t).select("wallet_address", "fund_type", rnd("value", 2).alias("value"), rnd("pnl", 2).alias("pnl"), rnd("pnl_pct", 4).alias("pnl_pct"), rnd("weight", 4).alias("weight"))


@query("portfolio", f"WITH {_HOLD} SELECT wallet_address, count(*) AS funds, r2(sum(v)) AS total_value, r2(sum(pnl)) AS total_pnl, r4(sum(pnl)*100/sum(c)) AS total_pnl_pct FROM hd GROUP BY 1")
def portfolio(t: Tables):
    p = fund.portfolio(holdings(t))
    return p.select("wallet_address", "funds", rnd("total_value", 2).alias("total_value"), rnd("total_pnl", 2).alias("total_pnl"), rnd("total_pnl_pct", 4).alias("total_pnl_pct"))


@query("share_ledger_fold", f"""WITH RECURSIVE {_TXN}, o AS (SELECT *, row_number() OVER (PARTITION BY wallet_address, fund_type ORDER BY ts, o_orderkey) AS rn FROM tx),
f AS (SELECT wallet_address, fund_type, o_orderkey, rn, CASE tx_type WHEN 'DEPOSIT' THEN shares_amount ELSE 0 END AS bal, CASE tx_type WHEN 'DEPOSIT' THEN CAST(usdc_amount AS DOUBLE) ELSE 0 END AS cost FROM o WHERE rn = 1
  UNION ALL SELECT o.wallet_address, o.fund_type, o.o_orderkey, o.rn, round(greatest(0, f.bal + CASE o.tx_type WHEN 'DEPOSIT' THEN o.shares_amount ELSE -o.shares_amount END), 9),
    CASE o.tx_type WHEN 'DEPOSIT' THEN f.cost + CAST(o.usdc_amount AS DOUBLE) WHEN 'WITHDRAW' THEN CASE WHEN f.bal > 0 THEN f.cost*round(greatest(0, f.bal - o.shares_amount), 9)/f.bal ELSE 0 END END
  FROM f JOIN o ON o.wallet_address = f.wallet_address AND o.fund_type = f.fund_type AND o.rn = f.rn + 1)
SELECT wallet_address, fund_type, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS tx_id, r3(bal) AS balance, r3(cost) AS cost_basis FROM f""")
def share_ledger_fold(t: Tables):
    return fund.share_ledger(transactions(t)).select("wallet_address", "fund_type", "tx_id", rnd("balance", 3).alias("balance"), rnd("cost_basis", 3).alias("cost_basis"))


@query("position_state", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY username, token_id ORDER BY ts, event_key) AS rn FROM v_trades),
f AS (SELECT username, token_id, event_key, rn, CASE side WHEN 'BUY' THEN size ELSE 0 END AS bal, CASE side WHEN 'BUY' THEN price*size ELSE 0 END AS cost, 0.0::DOUBLE AS step FROM o WHERE rn = 1
  UNION ALL SELECT o.username, o.token_id, o.event_key, o.rn, round(greatest(0, f.bal + CASE o.side WHEN 'BUY' THEN o.size ELSE -o.size END), 9),
    CASE o.side WHEN 'BUY' THEN f.cost + o.price*o.size ELSE CASE WHEN f.bal > 0 THEN f.cost*round(greatest(0, f.bal - o.size), 9)/f.bal ELSE 0 END END,
    CASE o.side WHEN 'SELL' THEN least(f.bal, o.size)*(o.price - CASE WHEN f.bal > 0 THEN f.cost/f.bal ELSE 0 END) ELSE 0 END
  FROM f JOIN o ON o.username = f.username AND o.token_id = f.token_id AND o.rn = f.rn + 1)
SELECT username, token_id, event_key, r4(bal) AS balance, r4(cost) AS cost_basis, r4(CASE WHEN bal > 0 THEN cost/bal ELSE 0 END) AS avg_cost, r4(step) AS realized_step FROM f""")
def position_state(t: Tables):
    out = fund.position_fold(t.trades().select("username", "token_id", "event_key", "ts", "side", "price", "size"), ["username", "token_id"])
    return out.select("username", "token_id", "event_key", *[rnd(c, 4).alias(c) for c in ("balance", "cost_basis", "avg_cost", "realized_step")])


# ---- follow signals --------------------------------------------------------------------------


@query("insider_follow_signals", """WITH a AS (SELECT * FROM events WHERE event_type IN ('error', 'click') AND ts <= TIMESTAMP '2024-01-20' AND epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) <= 864000)
SELECT CAST(event_id AS VARCHAR) AS alert_id, 'm' || user_id AS market_slug, 't' || user_id AS token_id, 'Yes' AS outcome, CASE WHEN event_id % 3 = 0 THEN 'BUY' WHEN event_id % 3 = 1 THEN 'SELL' ELSE 'BUY' END AS action,
  r6(CASE WHEN event_id % 2 = 0 THEN 0.6 ELSE (event_id % 100)/100.0 END) AS confidence, CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM a WHERE event_id % 5 <> 0 AND NOT (event_id % 3 = 2 AND event_type = 'click')""")
def insider_follow_signals(t: Tables):
    e, i = t.read("events").filter("event_type IN ('error', 'click')"), F.col("event_id")
    meta = F.to_json(F.struct(
        F.when(i % 5 != 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("token_id"), F.when(i % 3 == 0, "long").when(i % 3 == 1, "NO").alias("direction"),
        F.when(i % 2 != 0, (i % 100) / F.lit(100.0)).alias("confidence")))
    alerts = e.select(
        i.cast("string").alias("alert_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("market_slug"), F.lit("ACTIVE").alias("status"),
        F.when(F.col("event_type") == "error", "INSIDER_DETECTED").otherwise("UNUSUAL_ACTIVITY").alias("alert_type"),
        F.when(i % 4 == 0, "critical").when(i % 4 == 1, "HIGH").when(i % 4 == 2, "warning").otherwise("info").alias("severity"), meta.alias("metadata"),
        F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    out = follow.insider_follow_signals(alerts, F.to_timestamp(F.lit("2024-01-20")), max_age_seconds=864_000)
    return rounded(out.select("alert_id", "market_slug", "token_id", "outcome", "action", "confidence", "urgency"))


@query("edge_follow_signals", f"""SELECT event_key, proxy_address, market_slug, token_id, side AS action, r6(least(1, ml_score/100)) AS confidence, r6(least(1, (1 - anomaly_score)*least(1, notional/20))) AS strength,
  'LOW' AS urgency, CAST(epoch({T0}) - epoch(ts) AS BIGINT) AS age_seconds FROM v_trades JOIN v_ml_scores USING (proxy_address) WHERE ml_score >= 70 AND ts <= {T0} AND epoch({T0}) - epoch(ts) <= 20000000""")
def edge_follow_signals(t: Tables):
    return rounded(follow.edge_follow_signals(t.trades(), t.ml_scores(), as_of(), max_age_seconds=20_000_000, full_notional=20.0))


_MOM = """WITH p AS (SELECT market_slug, ts, event_key || '-' || row_number() OVER (PARTITION BY event_key ORDER BY ts, price, size, token_id, side) AS event_key, CAST(round(price*1000000) AS BIGINT) AS price FROM v_market_trades),
w AS (SELECT a.market_slug, a.event_key, a.ts, a.price, list(b.price ORDER BY b.ts, b.event_key) AS ps FROM p a JOIN p b ON a.market_slug = b.market_slug AND b.ts <= a.ts AND epoch_us(b.ts) >= epoch_us(a.ts) - 600000000 GROUP BY ALL),
m AS (SELECT *, len(ps) AS n, greatest(1, len(ps)//3) AS k FROM w), c AS (SELECT *, round(CAST(list_sum(ps[1:k]) AS DOUBLE)/(k*1000000), 4) AS e, round(CAST(list_sum(ps[n - k + 1:n]) AS DOUBLE)/(k*1000000), 4) AS l FROM m)
SELECT event_key, CAST(n AS INTEGER) AS samples, r4(e) AS early_price, r4(l) AS late_price, CASE WHEN n < 3 THEN 'NEUTRAL' WHEN round(l - e, 6) > 0.02 THEN 'UP_RISING' WHEN round(l - e, 6) < -0.02 THEN 'UP_FALLING' ELSE 'NEUTRAL' END AS signal FROM c"""


def ticks(t: Tables, *more: str):
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("event_key").orderBy("ts", "price", "size", "token_id", "side"))
    return t.market_trades().withColumn("event_key", F.concat_ws("-", "event_key", nth)).select("market_slug", "ts", "event_key", "price", *more)


@query("momentum_signal", _MOM)
def momentum_signal(t: Tables):
    out = follow.momentum_signal(ticks(t))
    return out.select("event_key", "samples", rnd("early_price", 4).alias("early_price"), rnd("late_price", 4).alias("late_price"), "signal")


@query("stream_momentum", _MOM)
def stream_momentum(t: Tables):
    from tradelens.catalog.q_streams import drained_in_slices
    from tradelens.streaming import state
    out = drained_in_slices(t, ticks(t), "ts", ["market_slug"], state.momentum, "momentum")
    return out.select("event_key", "samples", rnd("early_price", 4).alias("early_price"), rnd("late_price", 4).alias("late_price"), "signal")


@query("alert_dedup", """WITH al AS (SELECT event_key AS alert_id, market_slug, CASE WHEN version % 2 = 0 THEN 'VOLUME_SPIKE' ELSE 'WHALE_ANOMALY' END AS signal_type, notional AS v, CASE WHEN outcome = 'Up' THEN 'YES' ELSE 'NO' END AS direction, ts AS detected_at,
  CASE WHEN version % 10 = 0 THEN 'CRITICAL' WHEN version % 5 = 1 THEN 'HIGH' WHEN version % 5 = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM v_trades),
k AS (SELECT *, left(md5('insider:' || signal_type || ':' || market_slug || ':' || direction || ':' || CAST(CAST(floor(v/1000)*1000 AS BIGINT) AS VARCHAR)), 16) AS dedup_key FROM al WHERE severity <> 'LOW')
SELECT dedup_key, arg_min(alert_id, (detected_at, alert_id)) AS alert_id, min(detected_at) AS detected_at, count(*) AS copies FROM k GROUP BY 1""")
def alert_dedup(t: Tables):
    from tradelens.catalog.q_signals import alert_table
    return follow.alert_dedup(alert_table(t))


@query("mirror_sizing", """WITH s AS (SELECT event_key, side, size, price, CASE WHEN version % 4 = 0 THEN NULL ELSE 1000 + version*100 END AS cap, CAST(version % 10 AS DOUBLE)/20 AS w FROM v_trades),
r AS (SELECT *, CAST(size AS DECIMAL(12,2))*CASE WHEN cap > 0 THEN CAST(round(10000.0::DOUBLE/cap, 4) AS DECIMAL(12,4)) ELSE 1.0000 END*CAST(w AS DECIMAL(8,4)) AS raw FROM s),
g AS (SELECT *, CASE WHEN raw*CAST(price AS DECIMAL(6,4)) > 1000 THEN floor(1000/price*100 + 1e-9)/100 ELSE CAST(raw AS DOUBLE) END AS tg FROM r)
SELECT event_key, r2(CASE WHEN tg*price < 5 - 1e-9 THEN 0 ELSE floor(tg*100 + 1e-7)/100 END) AS fund_shares, r4(CASE side WHEN 'BUY' THEN ceil(price*1.02*10000 - 1e-6)/10000 ELSE floor(price*0.98*10000 + 1e-6)/10000 END) AS limit_price FROM g""")
def mirror_sizing(t: Tables):
    v = F.col("version")
    s = t.trades().select("event_key", "side", F.col("size").alias("shares"), "price", F.when(v % 4 != 0, 1000 + v * 100).cast("double").alias("trader_capital"),
                          ((v % 10).cast("double") / 20).alias("weight"))
    out = follow.mirror_sizing(s)
    return out.select("event_key", rnd("fund_shares", 2).alias("fund_shares"), rnd("limit_price", 4).alias("limit_price"))


@query("signal_filter_caps", """WITH RECURSIVE s AS (SELECT event_key AS signal_id, CAST(outcome_index AS VARCHAR) AS fund_type, CAST(ts AS DATE) AS day, notional,
  row_number() OVER (PARTITION BY outcome_index, CAST(ts AS DATE) ORDER BY ts, event_key) AS rn FROM v_trades WHERE price >= 0.5),
f AS (SELECT signal_id, fund_type, day, rn, CAST(round(notional, 6) <= 60 AS BIGINT) AS nth, CASE WHEN round(notional, 6) <= 60 THEN notional ELSE 0 END AS used, round(notional, 6) <= 60 AS accepted FROM s WHERE rn = 1
  UNION ALL SELECT s.signal_id, s.fund_type, s.day, s.rn, f.nth + CAST(f.nth < 5 AND round(f.used + s.notional, 6) <= 60 AS BIGINT),
    f.used + CASE WHEN f.nth < 5 AND round(f.used + s.notional, 6) <= 60 THEN s.notional ELSE 0 END, f.nth < 5 AND round(f.used + s.notional, 6) <= 60
  FROM f JOIN s ON s.fund_type = f.fund_type AND s.day = f.day AND s.rn = f.rn + 1)
SELECT signal_id, fund_type, nth, r6(used) AS day_notional, accepted FROM f""")
def signal_filter_caps(t: Tables):
    s = t.trades().select(F.col("event_key").alias("signal_id"), F.col("outcome_index").cast("string").alias("fund_type"), F.col("ts").alias("detected_at"), "notional",
                          F.col("price").alias("confidence"), F.lit(0.4).alias("strength"), F.col("side").alias("action"))
    return rounded(follow.capped_signals(s, 5, 60.0).select("signal_id", "fund_type", "nth", "day_notional", "accepted"))


# ---- matching --------------------------------------------------------------------------------


_LEG = "struct_pack(t := epoch_us(o.ts), event_key := o.event_key, outcome := o.outcome, price := o.price, size := o.size)"
_LEG_TYPE = "STRUCT(t BIGINT, event_key VARCHAR, outcome VARCHAR, price DOUBLE, size DOUBLE)"


@query("greedy_pair_match", f"""WITH RECURSIVE o AS (SELECT username, market_slug, ts, event_key, outcome, price, size, row_number() OVER (PARTITION BY username, market_slug ORDER BY ts, event_key) AS rn
  FROM v_trades WHERE side = 'BUY' AND outcome IN ('Up', 'Down', 'Yes', 'No')),
f AS (SELECT username, market_slug, 0::BIGINT AS rn, []::{_LEG_TYPE}[] AS free, NULL::{_LEG_TYPE} AS hit, NULL::{_LEG_TYPE} AS me FROM (SELECT DISTINCT username, market_slug FROM o)
  UNION ALL SELECT username, market_slug, rn, CASE WHEN hit IS NULL THEN list_append(live, me) ELSE list_filter(live, lambda x: x.event_key <> hit.event_key) END, hit, me
  FROM (SELECT *, list_filter(live, lambda x: x.outcome <> me.outcome)[1] AS hit FROM
    (SELECT o.username, o.market_slug, o.rn, {_LEG} AS me, list_filter(f.free, lambda x: epoch_us(o.ts) - x.t <= 300000000) AS live FROM f JOIN o ON o.username = f.username AND o.market_slug = f.market_slug AND o.rn = f.rn + 1)))
SELECT username, market_slug, hit.event_key AS event_key_1, hit.outcome AS outcome_1, r6(hit.price) AS price_1, r6(hit.size) AS size_1, me.event_key AS event_key_2, me.outcome AS outcome_2, r6(me.price) AS price_2, r6(me.size) AS size_2,
  r6((me.t - hit.t)/1e6) AS time_gap_sec, r6(least(hit.size, me.size)) AS matched_size, r6(hit.price + me.price) AS combined_cost, r6(1 - (hit.price + me.price)) AS edge, r6(least(hit.size, me.size)*(1 - (hit.price + me.price))) AS edge_pnl
FROM f WHERE hit IS NOT NULL""")
def greedy_pair_match(t: Tables):
    return rounded(matching.greedy_pairs(t.trades(), window_seconds=300))


def time_price_match(t: Tables, **mode: bool):
    ref = t.trades().select("market_slug", "outcome", "side", "ts", F.col("event_key").alias("row_id"), "price")
    prints = ticks(t, "token_id", "side").withColumnRenamed("event_key", "row_id")
    cand = prints.select("market_slug", F.split_part("token_id", F.lit(":"), F.lit(2)).alias("outcome"), "side", "ts", "row_id", "price")
    m = matching.greedy_time_price(ref, cand, ["market_slug", "outcome", "side"], 60_000, 0.05, **mode)
    return rounded(matching.match_summary(m, ["side"]))


def _time_price(timely: str) -> str:
    """Each reference row with something in reach has its options best first; along those of a key the first option that is not used is taken."""
    return f"""WITH RECURSIVE r AS (SELECT market_slug, outcome, side, epoch_ms(ts) AS t, event_key AS row_id, price, row_number() OVER (PARTITION BY market_slug, outcome, side ORDER BY epoch_ms(ts), event_key) AS rn FROM v_trades),
c AS (SELECT market_slug, split_part(token_id, ':', 2) AS outcome, side, epoch_ms(ts) AS t, price, event_key || '-' || row_number() OVER (PARTITION BY event_key ORDER BY ts, price, size, token_id, side) AS row_id FROM v_market_trades),
near AS (SELECT r.market_slug, r.outcome, r.side, r.rn, c.row_id, c.t - r.t AS delta, abs(c.price - r.price) AS gap, c.t AS ct, {timely} AS timely
  FROM r JOIN c ON r.market_slug = c.market_slug AND r.outcome = c.outcome AND r.side = c.side AND abs(c.t - r.t) <= 60000),
opts AS (SELECT market_slug, outcome, side, rn, list(row_id) AS seen, list(row_id) FILTER (timely) AS timed, list(struct_pack(id := row_id, delta := delta, ct := ct) ORDER BY abs(delta), gap, ct, row_id) FILTER (timely AND gap <= 0.05 + 1e-12) AS good FROM near GROUP BY ALL),
g AS (SELECT r.market_slug, r.outcome, r.side, row_number() OVER (PARTITION BY r.market_slug, r.outcome, r.side ORDER BY r.rn) AS rn, r.t, seen, coalesce(timed, []) AS timed, good FROM r JOIN opts o ON r.market_slug = o.market_slug AND r.outcome = o.outcome AND r.side = o.side AND r.rn = o.rn),
f AS (SELECT market_slug, outcome, side, 0::BIGINT AS rn, []::STRUCT(id VARCHAR, delta BIGINT, ct BIGINT)[] AS used, []::VARCHAR[] AS gone, NULL::STRUCT(id VARCHAR, delta BIGINT, ct BIGINT) AS hit, ''::VARCHAR AS reason FROM (SELECT DISTINCT market_slug, outcome, side FROM g)
  UNION ALL SELECT market_slug, outcome, side, rn, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, gone, hit,
    CASE WHEN hit IS NOT NULL THEN 'MATCH' WHEN len(list_filter(seen, lambda x: NOT list_contains(gone, x))) = 0 THEN 'NO_SIM' WHEN len(list_filter(timed, lambda x: NOT list_contains(gone, x))) = 0 THEN 'NO_TIME_MATCH' ELSE 'NO_PRICE_MATCH' END
  FROM (SELECT *, list_transform(used, lambda x: x.id) AS gone, list_filter(good, lambda x: NOT list_contains(list_transform(used, lambda y: y.id), x.id))[1] AS hit
    FROM (SELECT g.*, list_filter(f.used, lambda x: x.ct >= g.t - 60000) AS used FROM f JOIN g ON g.market_slug = f.market_slug AND g.outcome = f.outcome AND g.side = f.side AND g.rn = f.rn + 1)))
SELECT side, n AS reference_rows, count(hit) AS matched, r6(avg(abs(hit.delta))) AS avg_abs_delta_ms, n - count(*) FILTER (reason <> 'NO_SIM') AS no_sim, count(*) FILTER (reason = 'NO_TIME_MATCH') AS no_time_match,
  count(*) FILTER (reason = 'NO_PRICE_MATCH') AS no_price_match FROM (SELECT side, count(*) AS n FROM r GROUP BY side) LEFT JOIN (SELECT * FROM f WHERE rn > 0) USING (side) GROUP BY side, n"""


@query("greedy_time_price_match", _time_price("TRUE"))
def greedy_time_price_match(t: Tables):
    return time_price_match(t)


@query("greedy_time_price_before", _time_price("c.t <= r.t"))
def greedy_time_price_before(t: Tables):
    return time_price_match(t, before_only=True)


@query("greedy_time_price_after", _time_price("c.t >= r.t"))
def greedy_time_price_after(t: Tables):
    return time_price_match(t, after_only=True)
