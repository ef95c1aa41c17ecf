"""Risk limits of active funds, as a batch fold and as a stream with map state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables
from tradelens.functions.numeric import rnd
from tradelens.plans import risk

LIMITS = risk.Limits(max_trades=12, max_notional=4000.0, max_open_positions=8, max_market_exposure=900.0)
FUNDS = 64


def alpha_signals(t: Tables):
    """Signals of 64 funds made from the trades: some expired, weak, informational, oversized, without a price."""
    v, n = F.col("version"), F.unix_seconds("ts") % 97
    return t.trades().select(
        F.concat(F.lit("F"), (F.substring("username", 2, 20).cast("bigint") % FUNDS).cast("string")).alias("fund_type"), F.col("event_key").alias("signal_id"), "token_id",
        F.when(v % 11 == 0, "HOLD").otherwise(F.col("side")).alias("action"), (F.lit(0.5) + F.col("price") / 2).alias("confidence"), (F.lit(0.3) + n / F.lit(100.0)).alias("strength"),
        F.when(v % 4 == 0, "LOW").when(v % 4 == 1, "MEDIUM").when(v % 4 == 2, "HIGH").otherwise("CRITICAL").alias("urgency"),
        F.when(v % 5 == 0, F.col("notional") * 60).alias("suggested_size_usd"), F.when(v % 6 != 0, F.col("price")).alias("price"), F.col("ts").alias("received_at"),
        F.when(v % 3 != 0, F.col("ts") + F.make_dt_interval(mins=F.lit(1) * (n % 5 - 1).cast("int"))).alias("expires_at"))


def _floor(x: str, digits: int) -> str:
    return f"floor(round(({x})*{10 ** digits}, 6))/{10 ** digits}.0::DOUBLE"


_SIGNALS = f"""sig AS (SELECT 'F' || (CAST(substr(username, 2) AS BIGINT) % {FUNDS}) AS fund_type, event_key AS signal_id, token_id, CASE WHEN version % 11 = 0 THEN 'HOLD' ELSE side END AS action,
  0.5 + price/2 AS confidence, 0.3 + (CAST(floor(epoch(ts)) AS BIGINT) % 97)/100.0::DOUBLE AS strength, [0.5, 1.0, 1.5, 2.0][version % 4 + 1]::DOUBLE AS often,
  CASE WHEN version % 5 = 0 THEN notional*60 END AS suggested, CASE WHEN version % 6 <> 0 THEN price ELSE 0.5 END AS price, ts AS received_at,
  version % 3 <> 0 AND (CAST(floor(epoch(ts)) AS BIGINT) % 97) % 5 - 1 <= 0 AS expired FROM v_trades),
own AS (SELECT *, least(200.0::DOUBLE*greatest(0.5, least(2.0, 0.5 + confidence*0.5*3))*(0.5 + strength), 1000.0) AS own_size FROM sig),
siz AS (SELECT *, least(CASE WHEN suggested > 0 THEN suggested WHEN round(own_size, 6) < 5 THEN 0 ELSE {_floor('own_size', 2)} END, 1000.0, 900.0) AS size_usd FROM own),
prc AS (SELECT *, {_floor('size_usd/price', 2)} AS shares, CASE WHEN action = 'BUY' THEN ceil(round(price*(1 + 0.02::DOUBLE*often)*10000, 6))/10000.0::DOUBLE ELSE {_floor('price*(1 - 0.02::DOUBLE*often)', 4)} END AS limit_price,
  CASE WHEN expired THEN 'expired' WHEN confidence < 0.6 THEN 'low_confidence' WHEN strength < 0.5 THEN 'low_strength' WHEN action = 'HOLD' THEN 'hold' END AS refused FROM siz),
run AS (SELECT *, CAST(received_at AS DATE) AS day, row_number() OVER (PARTITION BY fund_type ORDER BY received_at, signal_id) AS rn FROM prc WHERE refused IS NULL)"""

_NEXT = """SELECT *, CASE WHEN trades >= 12 THEN 'daily_trades' WHEN round(notional + size_usd, 6) > 4000 THEN 'daily_notional'
    WHEN action = 'BUY' AND NOT map_contains(held, token_id) AND cardinality(held) >= 8 THEN 'open_positions' WHEN size_usd <= 0 THEN 'too_small' END AS reason"""

_FOLD = f"""fold AS (SELECT fund_type, 0::BIGINT AS rn, NULL::VARCHAR AS signal_id, NULL::DATE AS day, 0::BIGINT AS trades, 0.0::DOUBLE AS notional, MAP([]::VARCHAR[], []::DOUBLE[]) AS held, NULL::VARCHAR AS reason
    FROM (SELECT DISTINCT fund_type FROM run)
  UNION ALL SELECT fund_type, rn, signal_id, day, CASE WHEN reason IS NULL THEN trades + 1 ELSE trades END, CASE WHEN reason IS NULL THEN notional + shares*limit_price ELSE notional END,
    CASE WHEN reason IS NOT NULL OR (action = 'SELL' AND NOT map_contains(held, token_id)) THEN held
      ELSE map_from_entries(list_filter(list_append(list_filter(map_entries(held), lambda x: x.key <> token_id),
        struct_pack(key := token_id, value := round(coalesce(held[token_id], 0) + CASE action WHEN 'BUY' THEN shares ELSE -shares END, 6))), lambda x: x.value > 0 OR (action = 'BUY' AND x.key = token_id))) END, reason
  FROM ({_NEXT} FROM (SELECT f.fund_type, s.rn, s.signal_id, s.day, s.action, s.token_id, s.size_usd, s.shares, s.limit_price, f.held,
      CASE WHEN f.day = s.day THEN f.trades ELSE 0 END AS trades, CASE WHEN f.day = s.day THEN f.notional ELSE 0 END AS notional
    FROM fold f JOIN run s ON s.fund_type = f.fund_type AND s.rn = f.rn + 1)))"""


def money(df):
    return df.withColumns({c: rnd(c, 4 if c == "limit_price" else 2) for c in ("size_usd", "shares", "limit_price", "notional_today") if c in df.columns})


@query("risk_limited_signals", f"""WITH RECURSIVE {_SIGNALS}, {_FOLD}
SELECT signal_id, fund_type, f.reason IS NULL AS accepted, f.reason, r2(size_usd) AS size_usd, r2(shares) AS shares, r4(limit_price) AS limit_price, trades AS trades_today, r2(notional) AS notional_today,
  cardinality(held)::BIGINT AS open_positions FROM fold f JOIN run USING (fund_type, rn, signal_id)
UNION ALL SELECT signal_id, fund_type, FALSE, refused, r2(size_usd), r2(shares), r4(limit_price), NULL, NULL, NULL FROM prc WHERE refused IS NOT NULL""")
def risk_limited_signals(t: Tables):
    return money(risk.risk_limited(alpha_signals(t), LIMITS).select(
        "signal_id", "fund_type", "accepted", "reason", "size_usd", "shares", "limit_price", "trades_today", "notional_today", "open_positions"))


@query("risk_limited_stream", f"""WITH RECURSIVE {_SIGNALS}, {_FOLD}
SELECT signal_id, fund_type, f.reason, r2(shares) AS shares, r4(limit_price) AS limit_price, trades AS trades_today, r2(notional) AS notional_today, cardinality(held)::BIGINT AS open_positions
FROM fold f JOIN run USING (fund_type, rn, signal_id)""")
def risk_limited_stream(t: Tables):
    from tradelens.catalog.q_streams import drained_in_slices
    held = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", risk.PROVIDER)
    try:
        out = drained_in_slices(t, alpha_signals(t), "received_at", ["fund_type"], lambda s: risk.risk_stream(s, LIMITS, keep_seconds=20_000 * 86_400), "risk")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return money(out.drop("received_at"))
