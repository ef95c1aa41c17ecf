"""Folds and ranks against sequential passes, with long ledgers and most rows on one key."""

import datetime as dt

from pyspark.sql import functions as F

from tradelens.operators.ordering import ranked, top_per
from tradelens.plans import follow, fund


def sequential(fills):
    bal = cost = 0.0
    for side, size, price in fills:
        step = 0.0
        if side == "BUY":
            bal, cost = round(bal + size, 9), cost + price * size
        else:
            left = round(max(0.0, bal - size), 9)
            step = (bal - left) * (price - (cost / bal if bal > 0 else 0.0))
            bal, cost = left, (cost * left / bal if bal > 0 else 0.0)
        yield bal, cost, step


def test_ten_thousand_partial_sales_equal_a_sequential_pass(spark):
    fills = [("BUY", 1.0, 0.25 + k % 7 / 10) if k % 2 == 0 else ("SELL", 0.7, 0.5) for k in range(20_000)]
    start = dt.datetime(2024, 1, 1)
    rows = [("u", "t", start + dt.timedelta(seconds=11 * k), f"{k:06d}", *f) for k, f in enumerate(fills)]
    rows += [("v", None, start, "a", "SELL", 3.0, 0.5), ("v", None, start, "b", "BUY", 2.0, 0.5)]
    df = spark.createDataFrame(rows, "username string, token_id string, ts timestamp, event_key string, side string, size double, price double")
    found = {r.event_key: r for r in fund.position_fold(df, ["username", "token_id"]).filter("username = 'u'").collect()}
    assert len(found) == len(fills)
    for k, (bal, cost, step) in enumerate(sequential(fills)):
        r = found[f"{k:06d}"]
        assert abs(r.balance - bal) < 1e-6 and abs(r.cost_basis - cost) < 1e-6 and abs(r.realized_step - step) < 1e-6


def test_refused_signals_use_no_cap(spark):
    t = dt.datetime(2024, 1, 1, 12)
    notionals = [1000.0, 50.0, 60.0, 200.0, 10.0, 10.0]
    rows = [(f"s{k}", "f", t + dt.timedelta(seconds=k), n, 0.9, 0.9, "BUY") for k, n in enumerate(notionals)] + [("h", "f", t, 1.0, 0.9, 0.9, "HOLD"), ("z", None, t, None, 0.9, 0.9, "BUY")]
    df = spark.createDataFrame(rows, "signal_id string, fund_type string, detected_at timestamp, notional double, confidence double, strength double, action string")
    found = {r.signal_id: (r.accepted, r.nth, r.day_notional) for r in follow.capped_signals(df, 3, 300.0).collect()}
    assert found == {"s0": (False, 0, 0.0), "s1": (True, 1, 50.0), "s2": (True, 2, 110.0), "s3": (False, 2, 110.0), "s4": (True, 3, 120.0), "s5": (False, 3, 120.0),
                     "z": (False, 0, 0.0)}


def test_ranks_and_top_rows(spark):
    df = spark.range(3000).select(F.concat(F.lit("0x"), F.lpad(F.hex((F.col("id") * 7919) % 65536), 8, "0")).alias("who"), F.when(F.col("id") % 10 < 9, 50).otherwise(F.col("id") % 40).alias("score"))
    rows = df.collect()
    expect = {r.who: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r.score, r.who)))}
    assert {r.who: r.rank for r in ranked(df, "score", "who").collect()} == expect
    top = top_per(df, ["score"], [F.asc("who")], 2).collect()
    assert all(sum(r.score == s for r in top) == min(2, sum(r.score == s for r in rows)) for s in {r.score for r in rows})


def test_ranks_keep_rows_without_value_or_name(spark):
    rows = [("a", 3.0), (None, 3.0), ("b", None), (None, None), ("c", 5.5), ("same prefix 1", 3.0), ("same prefix 2", 3.0)]
    df = spark.createDataFrame(rows, "who string, score double")
    found = sorted(ranked(df, "score", "who").collect(), key=lambda r: r.rank)
    expect = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or ""))
    assert [(r.who, r.score, r.rank) for r in found] == [(*r, k + 1) for k, r in enumerate(expect)]
    assert ranked(df.limit(0), "score", "who").count() == 0


def test_ranks_of_one_hot_value_over_many_partitions(spark):
    df = spark.range(5000).select(F.lit(1.25).alias("score"), F.lpad(F.col("id").cast("string"), 9, "0").alias("who")).repartition(7)
    assert ranked(df, "score", "who").filter("rank <> cast(who as bigint) + 1").count() == 0
