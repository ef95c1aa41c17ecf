"""Streams replayed in small files give what the batch form gives."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradelens.plans import enrich, fund, risk
from tradelens.sources.envelopes import BROKER_SCHEMA, file_events
from tradelens.sources.projections import project
from tradelens.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def replay(spark, tmp_path, batches, schema, build, mode="append"):
    """Feed each list of rows as one file and return what the query wrote."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i:03d}"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    name = f"t_{tmp_path.name}".replace("-", "_")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_dedup_drops_replays(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(0))], [("b", at(1)), ("c", at(5))]]
    rows = replay(spark, tmp_path, batches, "event_key string, ts timestamp", jobs.stream_dedup)
    assert sorted(r.event_key for r in rows) == ["a", "b", "c"]


def test_minute_bars_match_batch(spark, tmp_path):
    schema = "token_id string, ts timestamp, side string, price double, size double"
    rows = [("t", at(7 * i), "BUY" if i % 3 else "SELL", 0.4 + i / 1000, 1.0 + i) for i in range(60)]
    end = [("t", at(100000), "BUY", 0.5, 1.0)]
    got = replay(spark, tmp_path, [rows[:30], rows[30:], end, end], schema, jobs.stream_minute_bars)
    want = enrich.minute_bars(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r.minute, r.trade_count, round(r.volume, 6), round(r.vwap, 6), round(r.buy_volume, 6))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_latest_book_writes_each_change(spark, tmp_path):
    batches = [[("x", at(1), 1, 0.4, 0.5), ("y", at(1), 2, 0.3, 0.4)], [("x", at(3), 3, 0.5, 0.6), ("x", at(2), 4, 0.9, 1.0)], [("x", at(2), 5, 0.1, 0.2)]]
    rows = replay(spark, tmp_path, batches, "asset_id string, ts timestamp, seq long, bid double, ask double", state.latest_book)
    assert sorted((r.asset_id, r.bid) for r in rows) == [("x", 0.4), ("x", 0.5), ("y", 0.3)]


def test_mirror_only_newer_trades_of_members(spark, tmp_path):
    schema = "username string, event_key string, ts timestamp, market_slug string, token_id string, side string, price double, size double"
    row = lambda u, k, s: (u, k, at(s), "m", "t", "BUY", 0.5, 10.0)
    members = spark.createDataFrame([("Alice", 0.1, 1e5)], "username string, weight double, estimated_capital_usd double")
    batches = [[row("alice", "k1", 10), row("bob", "k2", 11)], [row("alice", "k1", 10), row("alice", "k3", 20), row("alice", "k0", 5)]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.mirror_signals(s, members))
    assert sorted(r.event_key for r in rows) == ["k1", "k3"]


def test_caps_skip_refused_and_roll_over(spark, tmp_path):
    schema = "fund_type string, signal_id string, detected_at timestamp, notional double, confidence double, strength double, action string"
    row = lambda i, s, n, c=0.9, a="BUY": ("F", i, at(s), n, c, 0.5, a)
    batches = [[row("a", 1, 60.0), row("b", 2, 60.0), row("c", 3, 30.0)], [row("d", 4, 5.0), row("e", 5, 1.0), row("low", 6, 1.0, 0.1), row("hold", 7, 1.0, a="HOLD")],
               [row("next", 86400 + 1, 80.0)]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.capped_signals(s, 3, 100.0))
    assert [r.signal_id for r in sorted(rows, key=lambda r: r.detected_at)] == ["a", "c", "d", "next"]


def test_cooldown_holds_and_releases(spark, tmp_path):
    schema = "market_slug string, signal_id string, detected_at timestamp"
    batches = [[("m", "a", at(0)), ("m", "b", at(10)), ("n", "c", at(10))], [("m", "d", at(70))], [("z", "e", at(500))], [("z", "f", at(1000))]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.cooldown(s, 60, lateness="0 seconds"))
    sent = {r.signal_id: r.released_at for r in rows if r.cooldown_key != "z"}
    assert sent["a"] == at(0) and sent["c"] == at(10) and sent["b"] == at(60) and sent["d"] == at(120)


def test_cooldown_drops_stale_signals(spark, tmp_path):
    """b would wait 990 s and goes; c waits 100 s and is sent; a key whose cooldown is over starts anew."""
    schema = "market_slug string, signal_id string, detected_at timestamp"
    batches = [[("m", "a", at(0)), ("m", "b", at(10))], [("m", "c", at(900))], [("z", "e", at(1500))], [("z", "f", at(5000))], [("m", "d", at(5001)), ("z", "g", at(9000))]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.cooldown(s, 1000, lateness="0 seconds"))
    assert {r.signal_id: r.released_at for r in rows if r.cooldown_key == "m"} == {"a": at(0), "c": at(1000), "d": at(5001)}


def test_delayed_release(spark, tmp_path):
    schema = "fund_type string, signal_id string, detected_at timestamp, payload string"
    batches = [[("F", "a", at(0), "p"), ("F", "b", at(50), "q")], [("G", "x", at(70), "r")], [("G", "y", at(500), "s")], [("G", "z", at(900), "s")]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.delayed_signals(s, 60, lateness="0 seconds"))
    assert {"a", "b", "x"} <= {r.signal_id for r in rows} and "z" not in {r.signal_id for r in rows}


def test_position_state_matches_batch_fold(spark, tmp_path):
    schema = "fund_type string, token_id string, event_key string, ts timestamp, side string, price double, size double"
    rows = [("F", "t", f"e{i:02d}", at(i), "SELL" if i % 4 == 3 else "BUY", 0.3 + i / 100, 10.0 + i) for i in range(12)] + [("F", "t", "e99", at(99), "SELL", 0.9, 1000.0)]
    got = {r.event_key: r for r in replay(spark, tmp_path, [rows[:5], rows[5:]], schema, state.position_state)}
    batch = fund.position_fold(spark.createDataFrame(rows, schema), ["fund_type", "token_id"]).orderBy("ts").collect()
    total = 0.0
    for r in batch:
        total += r.realized_step
        s = got[r.event_key]
        assert (s.shares, s.avg_cost, s.realized_pnl) == pytest.approx((r.balance, r.avg_cost, total), abs=1e-6)


def test_score_drop_and_momentum(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    rows = replay(spark, tmp_path / "a", [[("p", at(0), 90), ("p", at(1), 80)], [("p", at(2), 70)]],
                  "proxy_address string, calculated_at timestamp, total_score int", state.edge_drops)
    assert [(r.total_score, r.recent_peak) for r in rows] == [(70, 90)]
    prices = [("m", at(10 * i), f"e{i}", p) for i, p in enumerate([0.40, 0.41, 0.45, 0.50, 0.52, 0.40, 0.30, 0.20])]
    rows = replay(spark, tmp_path / "b", [prices[:4], prices[4:]], "market_slug string, ts timestamp, event_key string, price double", state.momentum)
    by_time = [r.signal for r in sorted(rows, key=lambda r: r.ts)]
    assert by_time[0] == "NEUTRAL" and by_time[3] == "UP_RISING" and by_time[-1] == "UP_FALLING"
    assert any(r.flipped for r in rows)


def test_file_source_fan_out_and_late_versions(spark, tmp_path):
    env = lambda i, kind, data: ("k%d" % i, json.dumps({"ts": "2024-01-01T00:00:%02dZ" % i, "source": "s", "type": kind, "data": data}), "events", 0, i, T0)
    trade = {"username": "u", "trade": {"slug": "m", "price": "0.5", "size": 2}}
    rows = [env(0, "v.user.trade", trade), env(1, "market_ws.tob", {"assetId": "t", "bestBid": 0.4}), env(2, "noise", {}), env(3, "v.user.trade", trade)]
    spark.createDataFrame(rows, BROKER_SCHEMA).write.parquet(str(tmp_path / "in"))
    q = jobs.start_fan_out(file_events(spark, str(tmp_path / "in")), ["user_trades", "ws_tob"], str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "user_trades")).select("price", "size").distinct().collect() == [(0.5, 2.0)]
    assert spark.read.parquet(str(tmp_path / "out" / "ws_tob")).count() == 1
    table = spark.createDataFrame([("a", 1, "old", 0), ("a", 3, "new", 1), ("a", 2, "late", 2)], "k string, version int, v string, batch_id int")
    assert [r.v for r in jobs.latest(table, ["k"], "version").collect()] == ["new"]


def test_market_payload_as_array_or_text(spark):
    base = {"market": {"id": "1", "clobTokenIds": ["111", "222"], "outcomes": ["Yes", "No"]}}
    text = {"market": {"id": "2", "clobTokenIds": "[\"333\", \"444\"]", "outcomes": "[\"Yes\",\"No\"]"}}
    pdf = pd.DataFrame({"type": ["x.gamma.market"] * 2, "source": "s", "data": [json.dumps(base), json.dumps(text)]})
    events = spark.createDataFrame(pdf).select("*", F.lit(T0).alias("ts"), F.lit("k").alias("kafka_key"), F.lit(0).alias("kafka_partition"), F.lit(0).alias("kafka_offset"), F.lit(T0).alias("kafka_timestamp"))
    rows = {r.market_id: (r.token_ids, r.outcomes) for r in project(events, "gamma_markets").collect()}
    assert rows == {"1": (["111", "222"], ["Yes", "No"]), "2": (["333", "444"], ["Yes", "No"])}


# ---- late rows, and state that ends ----------------------------------------------------------


def test_a_late_signal_goes_before_the_younger_ones(spark, tmp_path):
    """a is sent, b (50 s) waits; c (30 s) comes in the next batch and is older, so it goes first."""
    schema = "market_slug string, signal_id string, detected_at timestamp"
    batches = [[("m", "a", at(0)), ("m", "b", at(50))], [("m", "c", at(30))], [("z", "x", at(2000))], [("z", "y", at(4000))]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.cooldown(s, 60))
    assert {r.signal_id: r.released_at for r in rows if r.cooldown_key == "m"} == {"a": at(0), "c": at(60), "b": at(120)}


def test_a_signal_within_the_lateness_is_not_lost(spark, tmp_path):
    """400 s behind the newest, two batches later."""
    schema = "market_slug string, signal_id string, detected_at timestamp"
    batches = [[("m", "a", at(1000))], [("n", "b", at(1001))], [("late", "c", at(600))], [("n", "d", at(9000))]]
    rows = replay(spark, tmp_path, batches, schema, lambda s: state.cooldown(s, 60))
    assert {"a", "b", "c"} <= {r.signal_id for r in rows}


def state_rows(spark, tmp_path, batches, schema, build):
    """How many keys the state holds after each batch of a replay."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i:03d}"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = build(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()


MEMBERS = "username string, weight double, estimated_capital_usd double"
FILL = "fund_type string, token_id string, event_key string, ts timestamp, side string, price double, size double"
ENDING = {
    "latest_book": ("asset_id string, ts timestamp, seq long, bid double, ask double", lambda k, s: (k, at(s), 1, 0.4, 0.5), state.latest_book),
    "position_state": (FILL, lambda k, s: ("F", k, k, at(s), "BUY", 0.5, 1.0), lambda s: state.position_state(s, keep_seconds=100)),
    "edge_drops": ("proxy_address string, calculated_at timestamp, total_score int", lambda k, s: (k, at(s), 50), lambda s: state.edge_drops(s, keep_seconds=100)),
    "momentum": ("market_slug string, ts timestamp, event_key string, price double", lambda k, s: (k, at(s), k, 0.5), lambda s: state.momentum(s, keep_seconds=700)),
    "capped": ("fund_type string, signal_id string, detected_at timestamp, notional double, confidence double, strength double, action string",
               lambda k, s: (k, k, at(s), 1.0, 0.9, 0.9, "BUY"), lambda s: state.capped_signals(s, 3, 100.0)),
    "cooldown": ("market_slug string, signal_id string, detected_at timestamp", lambda k, s: (k, k, at(s)), lambda s: state.cooldown(s, 60)),
}


@pytest.mark.parametrize("job", list(ENDING))
def test_state_ends_when_the_watermark_has_passed(spark, tmp_path, job):
    schema, row, build = ENDING[job]
    held = state_rows(spark, tmp_path, [[row(f"k{i}", i) for i in range(40)], [row("late", 200_000)], [row("later", 400_000)]], schema, build)
    assert max(held) >= 40 and held[-1] <= 2


def test_mirrored_traders_are_forgotten(spark, tmp_path):
    schema = "username string, event_key string, ts timestamp, market_slug string, token_id string, side string, price double, size double"
    members = spark.createDataFrame([(f"k{i}", 0.1, 1e5) for i in range(41)], MEMBERS)
    row = lambda i, s: (f"k{i}", f"e{i}-{s}", at(s), "m", "t", "BUY", 0.5, 1.0)
    held = state_rows(spark, tmp_path, [[row(i, i) for i in range(40)], [row(40, 5000)], [row(40, 9000)]], schema, lambda s: state.mirror_signals(s, members))
    assert max(held) >= 40 and held[-1] <= 1


def test_alert_dedup_forgets_keys_after_their_time(spark, tmp_path):
    schema = "signal_type string, market_slug string, direction string, total_volume_usd double, severity string, detected_at timestamp, alert_id string"
    row = lambda i, s, v=1500.0, level="HIGH": ("VOLUME_SPIKE", "m", "YES", v, level, at(s), i)
    batches = [[row("a", 0)], [row("b", 60, 1999.0), row("c", 61, 2000.0), row("low", 62, 9000.0, "LOW")], [row("d", 90_000, 5000.0)], [row("x", 170_000, 7000.0)], [row("y", 175_000, 8000.0)], [row("e", 180_000, 5000.0)], [row("f", 180_100)]]
    rows = replay(spark, tmp_path, batches, schema, jobs.stream_alert_dedup)
    assert sorted(r.alert_id for r in rows) == ["a", "c", "d", "e", "f", "x", "y"]


# ---- risk limits -----------------------------------------------------------------------------

RISK = "fund_type string, signal_id string, token_id string, action string, confidence double, strength double, urgency string, suggested_size_usd double, price double, received_at timestamp, expires_at timestamp"


def risk_rows():
    row = lambda i, s, token="t0", action="BUY", conf=0.9, strength=0.9, size=100.0, price=0.5, late=None, fund="F": (
        fund, i, token, action, conf, strength, "MEDIUM", size, price, at(s), None if late is None else at(late))
    rows = [row(f"open{k}", k, f"t{k}") for k in range(8)]
    rows += [row("ninth", 10, "t9"), row("again", 11, "t3"), row("expired", 12, late=12), row("valid", 13, late=14), row("hold", 14, action="HOLD"), row("weak", 15, conf=0.5), row("faint", 16, strength=0.1),
             row("oversize", 17, size=5000.0), row("close", 18, "t5", "SELL"), row("ninth2", 19, "t9"), row("unknown", 20, "t1", price=None), row("own", 21, "t1", size=None), row("null", 22, conf=None)]
    rows += [row(f"many{k}", 30 + k, "t1") for k in range(6)] + [row("nextday", 86_400 + 5, "t1"), row("other", 40, fund="G"), row("short", 41, "t77", "SELL", fund="G")]
    return rows


def test_risk_limits_by_hand(spark):
    limits = risk.Limits(max_trades=16, max_notional=3000.0, max_open_positions=8)
    found = {r.signal_id: r for r in risk.risk_limited(spark.createDataFrame(risk_rows(), RISK), limits).collect()}
    reason = {k: r.reason for k, r in found.items()}
    assert all(reason[f"open{k}"] is None for k in range(8)) and reason["ninth"] == "open_positions" and reason["again"] is None
    assert (reason["expired"], reason["valid"], reason["hold"], reason["weak"], reason["faint"], reason["null"]) == ("expired", None, "hold", "low_confidence", "low_strength", "low_confidence")
    assert found["oversize"].size_usd == 1000.0 and reason["close"] is None and reason["ninth2"] is None
    assert found["unknown"].limit_price == 0.51 and found["unknown"].shares == 200.0
    assert found["own"].size_usd == 200.0 * 1.85 * 1.4 // 0.01 / 100 or found["own"].size_usd == 518.0
    assert [reason[f"many{k}"] for k in range(6)].count(None) < 6 and reason["nextday"] is None and found["nextday"].trades_today == 1
    assert reason["other"] is None and found["short"].open_positions == 1
    assert all(r.reason == "kill_switch" for r in risk.risk_limited(spark.createDataFrame(risk_rows()[:3], RISK), risk.Limits(kill_switch=True)).collect())


@pytest.fixture
def map_state(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", risk.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def test_risk_stream_equals_the_batch(map_state, tmp_path):
    limits, rows = risk.Limits(max_trades=16, max_notional=3000.0, max_open_positions=8), sorted(risk_rows(), key=lambda r: (r[9], r[1]))
    batch = risk.risk_limited(map_state.createDataFrame(rows, RISK), limits).filter("trades_today IS NOT NULL")
    pick = lambda r: (r.signal_id, r.reason, r.shares, r.trades_today, round(r.notional_today, 6), r.open_positions)
    got = replay(map_state, tmp_path, [rows[:9], rows[9:20], rows[20:]], RISK, lambda s: risk.risk_stream(s, limits))
    assert sorted(map(pick, got)) == sorted(map(pick, batch.collect()))


def test_risk_positions_end(map_state, tmp_path):
    row = lambda token, s: ("F", f"{token}-{s}", token, "BUY", 0.9, 0.9, "LOW", 50.0, 0.5, at(s), None)
    batches = [[row(f"t{k}", k) for k in range(6)], [row("x", 100_000)], [row("y", 300_000)], [row("z", 500_000)]]
    held = state_rows(map_state, tmp_path, batches, RISK, lambda s: risk.risk_stream(s, risk.Limits(), keep_seconds=1000))
    assert max(held) >= 7 and held[-1] <= max(held) - 4
