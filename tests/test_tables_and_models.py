"""Bounded batches, bucketed merges, bootstrap figures, index rules, outliers and sketches on small tables."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelens.plans import backfill, ml, scoring, sketches
from tradelens.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def source(spark, tmp_path):
    rows = [(at(h), f"k{h:03d}", h * 1.5) for h in range(96)]
    path = str(tmp_path / "source")
    spark.createDataFrame(rows, "ts timestamp, k string, v double").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def test_batches_equal_one_run_and_may_be_repeated(spark, tmp_path):
    table = source(spark, tmp_path)
    build = lambda since, upto: backfill.bounded(table, "ts", since, upto, 0).select("ts", "k", (F.col("v") * 2).alias("w"))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    backfill.backfill(spark, whole, at(95), build)
    written = [backfill.backfill(spark, parts, upto, build) for upto in (at(30), at(50), at(50), at(95))]
    rows = lambda p: sorted((r.ts, r.k, r.w) for r in spark.read.parquet(p).collect())
    assert rows(parts) == rows(whole) and len(rows(parts)) == 96 and written[2] == 0
    assert backfill.high_water_mark(spark, parts) == at(95)
    # a batch that wrote its days but not its mark gives the same when it is run again
    spark.createDataFrame([(at(30),)], "upto timestamp").write.mode("overwrite").parquet(f"{parts}_marks")
    backfill.backfill(spark, parts, at(95), build)
    assert rows(parts) == rows(whole)


def test_a_bounded_scan_reads_few_partitions(spark, tmp_path):
    table = source(spark, tmp_path).filter(F.col("day") >= F.lit(at(48).date()))
    plan = backfill.bounded(table, "ts", at(50), at(60), 3600)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(ts" in plan and "PartitionFilters: [isnotnull(day" in plan


def files_of(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("version"), F.col("id").alias("v"))
    sinks.merge_versions(spark, rows, path, ["k"], ["version"], buckets=8)
    before = files_of(path)
    sinks.merge_versions(spark, spark.createDataFrame([("k7", 3, 70), ("k7", 2, 60)], "k string, version int, v bigint"), path, ["k"], ["version"], buckets=8)
    after = files_of(path)
    bucket = spark.createDataFrame([("k7",)], "k string").select(sinks.bucket_of(["k"], 8)).first()[0]
    other = lambda files: {f: n for f, n in files.items() if f"{sinks.BUCKET}={bucket}/" not in f}
    assert other(before) == other(after) and len(other(before)) >= 7
    table = {r.k: (r.version, r.v) for r in spark.read.parquet(path).collect()}
    assert len(table) == 400 and table["k7"] == (3, 70) and table["k8"] == (1, 8)
    sinks.merge_versions(spark, rows.limit(0), path, ["k"], ["version"], buckets=8)
    assert files_of(path) == after


def plain_figures(values):
    total, high, low, fall = 0.0, -np.inf, np.inf, 0.0
    for v in values:
        total += v
        high, low = max(high, total), min(low, total)
        fall = max(fall, high - total)
    return total, high, low, fall


def test_stretches_equal_a_loop():
    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, 200)
    for length in (1, 2, 3, 7, 50, 64, 200):
        found = ml.stretches(values, length)
        for start in range(200 - length + 1):
            assert np.allclose([x[start] for x in found], plain_figures(values[start:start + length]))


@pytest.mark.parametrize(("n", "block"), [(1, 50), (37, 50), (130, 50), (300, 7)])
def test_bootstrap_equals_a_loop_on_the_same_starts(spark, monkeypatch, n, block):
    monkeypatch.setattr(ml, "STARTS", 64)
    rng = np.random.default_rng(2)
    pnl = rng.normal(0, 10, n)
    units = spark.createDataFrame([(f"u{i:04d}", float(pnl[i]), T0 + dt.timedelta(hours=7 * i)) for i in range(n)], "u string, pnl double, pnl_ts timestamp")
    found = {r.iteration: r for r in ml.block_bootstrap(units, ["u"], 12, block).collect()}
    width = min(block, n)
    blocks = -(-n // width)
    starts = {(r.i, r.b): r.s for r in spark.range(12 * blocks).select(F.floor(F.col("id") / blocks).alias("i"), (F.col("id") % blocks).alias("b"), F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(n)).alias("s")).collect()}
    for i in range(12):
        drawn = [pnl[(starts[i, b] + k) % n] for b in range(blocks) for k in range(width)][:n]
        total, _, _, fall = plain_figures(drawn)
        assert abs(found[i].total - total) < 1e-6 and abs(found[i].max_drawdown - fall) < 1e-6
    assert ml.block_bootstrap(units.limit(0), ["u"], 3, block).count() == 0


def test_index_rules_as_rows(spark):
    rnd = random.Random(5)
    kinds = ["ARBITRAGEUR", "HYBRID", "EVENT_DRIVEN", None, ""]
    rows = [(f"0x{i:03d}", f"u{i}", rnd.randrange(30, 100), rnd.choice(kinds), rnd.randrange(0, 30), rnd.randrange(0, 20), rnd.randrange(0, 3000) * 1.0, rnd.random() * 3 - 0.5) for i in range(200)]
    traders = spark.createDataFrame(rows, "proxy_address string, username string, total_score int, strategy_type string, total_trades int, days_active int, total_volume_usd double, sharpe_ratio double")
    configs = [scoring.IndexConfig("A", 10, "EQUAL", 50, 10, 1, 1000, excluded=("ARBITRAGEUR",)), scoring.IndexConfig("B", 15, "SHARPE", 40, 5, 1, 500, allowed=("EVENT_DRIVEN",)), scoring.IndexConfig("C", 1000, "SCORE", 0, 0, 0, 0)]
    found = scoring.index_build_all(scoring.IndexInputs(traders), configs).collect()
    for c in configs:
        kind = lambda r: r[3] or "UNKNOWN"
        fits = [r for r in rows if r[2] >= c.min_score and r[4] >= c.min_trades and r[5] >= c.min_days and r[6] >= c.min_volume and r[7] >= c.min_sharpe
                and (not c.allowed or kind(r) in ("UNKNOWN", *c.allowed)) and kind(r) not in c.excluded]
        fits = sorted(fits, key=lambda r: (-r[2], r[0]))[:c.size]
        mine = sorted((r for r in found if r.index_type == c.name), key=lambda r: r.index_rank)
        assert [r.proxy_address for r in mine] == [r[0] for r in fits] and abs(sum(r.weight for r in mine) - 1) < 1e-9


def test_planted_outliers_are_found_with_their_kind(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(0, 1, 3))) for i in range(2000)]
    for i, column in ((5, 1), (700, 2), (1999, 3)):
        row = [0.0, 0.0, 0.0]
        row[column - 1] = 60.0
        rows[i] = (i, *row)
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    found = {r.id: r for r in ml.outlier_detection(df, "id", ["a", "b", "c"], {"a": "A", "b": "B", "c": "C"}, share=0.005).collect()}
    assert len(found) == 2000 and [found[i].anomaly_type for i in (5, 700, 1999)] == ["A", "B", "C"]
    assert sum(r.is_anomaly for r in found.values()) <= 20 and all(r.anomaly_type == "NORMAL" for r in found.values() if not r.is_anomaly)
    assert ml.outlier_detection(df.limit(0), "id", ["a"], {"a": "A"}).count() == 0


def test_daily_states_merge_to_the_report_of_all_days(spark):
    rnd = random.Random(9)
    rows = [("u", T0 + dt.timedelta(days=rnd.randrange(40)), rnd.random(), 2.0, f"m{rnd.randrange(80)}") for _ in range(4000)] + [("v", T0, None, 1.0, None)]
    trades = spark.createDataFrame(rows, "username string, ts timestamp, price double, notional double, market_slug string")
    states = sketches.daily_states(trades, ["username"], F.col("price"), F.col("market_slug"))
    as_of = F.lit(T0 + dt.timedelta(days=39))
    r = sketches.merged_report(states, ["username"], as_of, 30, {"p50": 0.5, "p90": 0.9}).filter("username = 'u'").first()
    recent = sorted(x[2] for x in rows[:-1] if x[1] > T0 + dt.timedelta(days=9))
    rank = lambda v: sum(x <= v for x in recent) / len(recent)
    assert r.trades == len(recent) and abs(rank(r.p50) - 0.5) < 0.03 and abs(rank(r.p90) - 0.9) < 0.03 and abs(r.distinct_estimate - 80) <= 4
