"""Operators against brute force on small random data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.functions.hexwords import big_number, small_number
from tradelens.operators import matching
from tradelens.operators.asof import asof_join, asof_nearest
from tradelens.operators.latest import latest_per_key
from tradelens.operators.quantiles import exact_quantiles, global_rank, percent_ranks
from tradelens.operators.scan import ordered_scan, time_segment

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_latest_takes_one_whole_row(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 2, "m", 4), ("b", 1, "z", 1)], "k string, v int, s string, n int")
    rows = {r.k: r for r in latest_per_key(df, ["k"], ["v"]).collect()}
    assert (rows["a"].v, rows["a"].s, rows["a"].n) == (2, "m", 4)
    assert rows["b"].s == "z"


@pytest.mark.parametrize("seconds", [10, 1000, 10**6])
def test_scan_equals_sequential_pass(spark, seconds):
    rnd = random.Random(3)
    # key "hot" holds most rows
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), at(rnd.randrange(5000)), i, rnd.randrange(-5, 6), rnd.choice([None, i])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, x int, y int")
    out = ordered_scan(df, ["k"], time_segment("ts", seconds), ["ts", "id"], sums={"s": F.col("x")}, maxes={"m": F.col("x")},
                       previous={"p": F.col("id")}, last_known={"l": F.col("y")}, totals={"t": F.col("x")})
    got = {r.id: (r.s, r.m, r.p, r.l, r.t) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        total = sum(r[3] for r in rows if r[0] == key)
        s, m, p, last = 0, None, None, None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            s, m, last = s + r[3], r[3] if m is None else max(m, r[3]), r[4] if r[4] is not None else last
            want[r[2]] = (s, m, p, last, total)
            p = r[2]
    assert got == want


def test_scan_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(None, at(1), 1), ("a", at(2), 2)], "k string, ts timestamp, x int")
    out = {r.x: r.s for r in ordered_scan(df, ["k"], time_segment("ts"), ["ts"], sums={"s": F.col("x")}).collect()}
    assert out == {1: None, 2: 2}


def test_asof_and_nearest(spark):
    rnd = random.Random(5)
    left = [(rnd.choice(["a", "b", None]), at(rnd.randrange(400000)), i) for i in range(200)]
    right = [(rnd.choice("ab"), at(rnd.randrange(400000)), i) for i in range(60)]
    right += [("a", right[0][1], 99), ("a", left[0][1], 100)]
    ldf = spark.createDataFrame(left, "k string, ts timestamp, id int")
    rdf = spark.createDataFrame(right, "a string, ts timestamp, q int")
    got = {r.id: r.r_q for r in asof_join(ldf, rdf, "k", "a", prefix="r_", tie=["q"], segment_seconds=5000).collect()}
    ahead = {r.id: r.r_q for r in asof_join(ldf, rdf, "k", "a", prefix="r_", tie=["q"], segment_seconds=5000, direction="forward").collect()}
    near = {r.id: r.abs_delay_seconds for r in asof_nearest(ldf, rdf, "k", "a", tie=["q"], segment_seconds=5000).collect()}
    assert len(got) == len(left)
    for k, ts, i in left:
        same = [r for r in right if r[0] == k]
        back = [r for r in same if r[1] <= ts]
        fwd = [r for r in same if r[1] >= ts]
        assert got[i] == (max(back, key=lambda r: (r[1], r[2]))[2] if back else None)
        if fwd:
            assert min(r[1] for r in fwd) == next(r[1] for r in fwd if r[2] == ahead[i])
        assert near[i] == (min(abs((r[1] - ts).total_seconds()) for r in same) if same else None)


def test_exact_quantiles_and_ranks(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.choice([rnd.randrange(-50, 50), rnd.random() * 1e6]))) for g in "ab" for _ in range(137)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r for r in exact_quantiles(df, ["g"], F.col("v"), {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    mid = {r.g: r.m for r in exact_quantiles(df, ["g"], F.col("v"), {"m": 0.5}, interpolate=True).collect()}
    for g in "ab":
        s = sorted(v for k, v in rows if k == g)
        assert (out[g].p10, out[g].p50, out[g].p100) == (s[13], s[68], s[-1])
        assert mid[g] == s[68]
    everything = sorted(v for _, v in rows)
    for r in global_rank(df, "v", rank="r", percent="p").collect():
        below = sum(1 for v in everything if v < r.v)
        assert r.r == below + 1 and abs(r.p - below / (len(everything) - 1)) < 1e-12
    ids = df.withColumn("id", F.monotonically_increasing_id())
    for r in percent_ranks(ids, "id", {"p": F.col("v"), "n": -F.col("v")}).collect():
        assert abs(r.p - sum(1 for v in everything if v < r.v) / (len(everything) - 1)) < 1e-12
        assert abs(r.n - sum(1 for v in everything if v > r.v) / (len(everything) - 1)) < 1e-12


def brute_pairs(rows, window):
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    used, out = set(), set()
    for i, a in enumerate(rows):
        if i in used:
            continue
        best = None
        for j, b in enumerate(rows):
            if j in used or j == i or b[4] == a[4]:
                continue
            gap = abs((b[2] - a[2]).total_seconds())
            if gap <= window and (best is None or gap < best[0]):
                best = (gap, j)
        if best:
            used |= {i, best[1]}
            out.add(frozenset((a[3], rows[best[1]][3])))
    return out


def test_greedy_pairs_equal_one_pass_whatever_the_segment(spark):
    rnd = random.Random(9)
    rows = [("u", "m", at(rnd.randrange(900)), f"e{i:03d}", rnd.choice(["Up", "Down"]), "BUY", 0.4, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "username string, market_slug string, ts timestamp, event_key string, outcome string, side string, price double, size double")
    want = brute_pairs(rows, 20)
    for segment, most in ((30, 0), (30, 10), (100000, 0), (30, 100_000)):  # cut into segments, partly, and island by island
        got = {frozenset((r.event_key_1, r.event_key_2)) for r in matching.greedy_pairs(df, 20, segment, most_rows=most).collect()}
        assert got == want


def brute_time_price(ref, cand, delta, eps, before_only=False, after_only=False):
    used, out = set(), {}
    for t, rid, p in sorted(ref):
        best = None
        for ct, cid, cp in sorted(cand):
            d = (ct - t).total_seconds() * 1000
            if cid in used or abs(d) > delta or abs(cp - p) > eps + 1e-12 or (before_only and d > 0) or (after_only and d < 0):
                continue
            if best is None or (abs(d), abs(cp - p)) < best[:2]:
                best = (abs(d), abs(cp - p), cid)
        if best:
            used.add(best[2])
        out[rid] = best[2] if best else None
    return out


@pytest.mark.parametrize("mode", [{}, {"before_only": True}, {"after_only": True}])
def test_greedy_time_price_equals_one_pass(spark, mode):
    rnd = random.Random(4)
    side = lambda tag, n: [(at(rnd.randrange(600)), f"{tag}{i:03d}", rnd.choice([0.4, 0.41, 0.5])) for i in range(n)]
    ref, cand = side("r", 80), side("c", 80)
    schema = "ts timestamp, row_id string, price double"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("m", F.lit("x"))
    want = brute_time_price(ref, cand, 10_000, 0.01, **mode)
    for segment, most in ((20, 0), (20, 30), (100000, 0), (20, 100_000)):
        got = {r.row_id: r.match_id for r in matching.greedy_time_price(frame(ref), frame(cand), ["m"], 10_000, 0.01, segment_seconds=segment, most_rows=most, **mode).collect()}
        assert got == want


def test_nearest_on_a_hot_key_equals_all_pairs(spark):
    """Nine tenths of the rows on one key and day; equal times take the greatest tie, equal distances the earlier row."""
    rnd = random.Random(6)
    side = lambda n: [(rnd.choice("aaaaaaaaab"), at(rnd.randrange(400)), i) for i in range(n)]
    left, right = [*side(150), (None, at(3), 900), ("a", None, 901), ("none", at(3), 902)], [*side(60), (None, at(3), 903), ("a", None, 904)]
    schema = "k string, ts timestamp, i int"
    want = {}
    for k, t, i in left:
        found = [((abs(rt - t), rt > t, -ri), ri) for rk, rt, ri in right if rk is not None and rk == k and rt is not None and t is not None]
        want[i] = min(found)[1] if found else None
    for width in (7, 100000):
        near = asof_nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "k", value_cols=["i"], tie=["i"], segment_seconds=width)
        assert {r.i: r.nearest_i for r in near.collect()} == want


def test_rank_of_clocks_in_time_segments(spark):
    rnd = random.Random(8)
    stamps = [1_700_000_000_000_000 + rnd.randrange(10_000_000_000) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in [*stamps, stamps[0]]], "v bigint")
    got = global_rank(df, "v", rank="r", segment=lambda v: F.floor(v / F.lit(600_000_000)).cast("bigint"))
    assert {r.v: r.r for r in got.collect()} == {s: 1 + sum(o < s for o in [*stamps, stamps[0]]) for s in stamps}


def test_hex_words(spark):
    big = "f" * 64
    df = spark.createDataFrame([(f"{5:064x}",), (f"{(1 << 100) + 7:064x}",), (big,)], "w string")
    out = df.select("w", small_number(F.col("w")).alias("n"), big_number(F.col("w")).alias("t")).collect()
    assert [int(r.n) if r.n is not None else None for r in out] == [5, (1 << 100) + 7, None]
    assert [r.t for r in out] == ["5", str((1 << 100) + 7), str(int(big, 16))]


def test_slug_and_settlement_edges(spark):
    df = spark.createDataFrame([("btc-updown-15m-1700000000",), ("x-99999999999",), ("a-b",), ("updown-15m-",)], "s string")
    assert [r[0] for r in df.select(C.slug_epoch("s")).collect()] == [1700000000, 0, 0, 0]
    m = spark.createDataFrame([(["Up", "Down"], [1.0, 0.0], "Down"), (["Up", "Down"], [0.5, 0.5], "Up"), (None, None, "Up"), (["Up", "Down"], [0.0, 1.0], "Maybe")],
                              "outcomes array<string>, outcome_prices array<double>, outcome string")
    assert [r[0] for r in m.select(C.settle_price()).collect()] == [0.0, None, None, None]
    assert [r[0] for r in m.select(C.resolved_outcome()).collect()] == ["Up", None, None, "Down"]


def test_islands_are_further_apart_than_the_reach(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice("ab"), rnd.randrange(5000)) for _ in range(300)]
    found = matching.with_islands(spark.createDataFrame(rows, "k string, t bigint"), ["k"], 10).collect()
    assert len(found) == len(rows)
    for k in "ab":
        mine = sorted((r.t, r._island, r._rows) for r in found if r.k == k)
        for (t, island, _), (u, other, _) in zip(mine, mine[1:], strict=False):
            assert island == other or u - t > 10
        assert all(n == sum(o[1] == island for o in mine) for _, island, n in mine)


def test_pairs_in_a_busy_minute_are_divided(spark):
    """Five hundred buys of each side in one minute, divided into parts of 64: every pair once."""
    from tradelens.plans import positions
    rows = [("u", "m", "c", at(k % 50), f"e{k:04d}", "Up" if k % 2 else "Down", "BUY", 0.4, 1.0) for k in range(600)] + [("v", "m", "c", at(5), "e1", "Up", "BUY", 0.4, 1.0), ("v", "m", "c", at(9), "e2", "Down", "BUY", 0.4, 1.0)]
    df = spark.createDataFrame(rows, "username string, market_slug string, condition_id string, ts timestamp, event_key string, outcome string, side string, price double, size double")
    want = sum(a[0] == b[0] and a[5] != b[5] and a[3] <= b[3] and a[4] < b[4] for a in rows for b in rows)
    found = positions.complete_set_pairs(df, most_legs=64)
    assert found.count() == want == found.select("username", "event_key_1", "event_key_2").distinct().count()


def test_weighted_quantiles_equal_those_of_the_rows(spark):
    rnd = random.Random(3)
    rows = [("g", rnd.randrange(40), rnd.randrange(1, 6)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    flat = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    how = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    assert exact_quantiles(df, ["g"], F.col("v"), how, weight=F.col("n")).collect() == exact_quantiles(flat, ["g"], F.col("v"), how).collect()


def test_lookups_of_two_keys_equal_two_joins(spark):
    from tradelens.operators.asof import asof_lookups
    rnd = random.Random(15)
    left = [(rnd.choice(["a", "b", None]), rnd.choice(["a", "b", "c"]), at(rnd.randrange(300_000)) if rnd.random() < 0.95 else None, i) for i in range(200)]
    right = [(rnd.choice("ab"), at(rnd.randrange(300_000)), i) for i in range(80)]
    ldf = spark.createDataFrame(left, "k string, o string, ts timestamp, id int")
    rdf = spark.createDataFrame(right, "a string, ts timestamp, q int")
    both = {r.id: (r.k_q, r.o_q) for r in asof_lookups(ldf, rdf, {"k_": "k", "o_": "o"}, "a", tie=["q"], segment_seconds=5000).collect()}
    one = {r.id: r.k_q for r in asof_join(ldf, rdf, "k", "a", prefix="k_", tie=["q"]).collect()}
    other = {r.id: r.o_q for r in asof_join(ldf, rdf, "o", "a", prefix="o_", tie=["q"]).collect()}
    assert both == {i: (one[i], other[i]) for i in one} and len(both) == 200
