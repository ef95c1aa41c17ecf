"""Order lifecycle: placement to fill or cancel, latency histograms, fill model, order streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numeric import clamp, count_if, div, div0, millis_between
from tradelens.operators.asof import asof_nearest
from tradelens.operators.quantiles import exact_quantiles
from tradelens.operators.scan import ordered_scan, time_segment
from tradelens.session import checkpointed

PLACE_COLUMNS = ("price", "size", "tick_size", "best_bid_price", "best_ask_price")


def order_lifecycle(strategy_orders: DataFrame, status: DataFrame) -> DataFrame:
    """One row per order: first placement, first fill, cancel, replaces, latencies, ticks off the bid."""
    ok = F.col("success")
    place = F.when(ok & (F.col("action") == "PLACE"), F.struct("ts", "event_key"))
    first = F.min_by(F.struct("ts", *PLACE_COLUMNS), place)
    names = F.max_by(F.struct("market_slug", "token_id", "direction"), F.struct("ts", "event_key"))
    placed = strategy_orders.filter(F.col("order_id").isNotNull() & (F.col("order_id") != "")).groupBy("order_id").agg(
        names.alias("_n"), first.alias("_p"), F.min(F.when(ok & (F.col("action") == "CANCEL"), F.col("ts"))).alias("cancel_ts"),
        count_if(ok & (F.col("action") == "REPLACE")).alias("replace_count"), F.min("ts").alias("first_strategy_ts"), F.max("ts").alias("last_strategy_ts"))
    filled = F.col("matched_size") > 0
    polled = status.filter(F.col("order_id").isNotNull() & (F.col("order_id") != "")).groupBy("order_id").agg(
        F.coalesce(F.max("matched_size"), F.lit(0.0)).alias("filled_size"), F.min(F.when(filled, F.col("ts"))).alias("first_fill_ts"),
        F.min_by("matched_size", F.when(filled, F.struct("ts", "event_key"))).alias("first_matched_size"),
        F.max("requested_size").alias("requested_size"), F.max_by("exchange_status", F.struct("ts", "event_key", "exchange_status")).alias("last_exchange_status"))
    rows = placed.join(polled, "order_id", "left").select(
        "order_id", "_n.*", F.col("_p.ts").alias("placed_ts"), F.col("_p.price").alias("placed_price"), F.col("_p.size").alias("placed_size"),
        F.col("_p.tick_size").alias("tick_size"), F.col("_p.best_bid_price").alias("bid_at_place"), F.col("_p.best_ask_price").alias("ask_at_place"),
        "first_fill_ts", "filled_size", "first_matched_size", "requested_size", "last_exchange_status", "cancel_ts", "replace_count",
        "first_strategy_ts", "last_strategy_ts")
    ticks = F.floor(F.round(div(F.col("placed_price") - F.col("bid_at_place"), "tick_size"), 6)).cast("bigint")
    return rows.withColumns({
        "fill_latency_ms": millis_between("placed_ts", "first_fill_ts"), "cancel_latency_ms": millis_between("placed_ts", "cancel_ts"),
        "ticks_above_best_bid": ticks})


def lifecycle_summary(orders: DataFrame) -> DataFrame:
    latency = F.col("fill_latency_ms")
    placed = count_if(F.col("placed_ts").isNotNull())
    rows = orders.withColumn("scope", F.lit("ALL"))
    base = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("orders_seen"), placed.alias("orders_placed"), count_if(F.col("first_fill_ts").isNotNull()).alias("orders_with_fill"),
        count_if(F.col("cancel_ts").isNotNull()).alias("orders_canceled"),
        count_if(F.col("first_fill_ts").isNull() & F.col("cancel_ts").isNull()).alias("orders_unresolved"),
        (F.avg(latency) / 1000).alias("avg_fill_latency_s"), F.avg("replace_count").alias("avg_replaces_per_order"),
        div0(F.sum("replace_count"), placed).alias("replaces_per_placed_order"))
    quant = exact_quantiles(rows, ["scope"], latency / F.lit(1000.0), {"median_fill_latency_s": 0.5, "p90_fill_latency_s": 0.9}, interpolate=True)
    return base.join(quant, "scope", "left")


def histogram(orders: DataFrame, value: Column, name: str, where: Column | None = None) -> DataFrame:
    rows = orders if where is None else orders.filter(where)
    return rows.withColumn(name, value).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("orders"))


def seconds_bucket(ms: str) -> Column:
    return F.floor(F.col(ms) / F.lit(1000)).cast("bigint")


def fill_by_tick(orders: DataFrame) -> DataFrame:
    rows = orders.filter(F.col("placed_ts").isNotNull() & F.col("ticks_above_best_bid").isNotNull())
    done = F.col("first_fill_ts").isNotNull()
    base = rows.groupBy("ticks_above_best_bid").agg(
        F.count(F.lit(1)).alias("orders"), count_if(done).alias("filled_orders"),
        F.round(count_if(done) * 100.0 / F.count(F.lit(1)) + 1e-9, 2).alias("fill_rate_pct"))
    quant = exact_quantiles(rows.filter(done), ["ticks_above_best_bid"], F.col("fill_latency_ms") / F.lit(1000.0), {"median_fill_latency_s": 0.5}, interpolate=True)
    return base.join(quant, "ticks_above_best_bid", "left")


def geometric_p(latency_ms: Column, poll_ms: int) -> Column:
    """Fill probability per poll whose geometric median is the given latency."""
    polls = F.greatest(F.lit(1.0), F.bround(latency_ms / F.lit(float(poll_ms)), 0))
    return F.when(latency_ms <= 0, 1.0).otherwise(F.lit(1.0) - F.pow(F.lit(0.5), F.lit(1.0) / polls))


def maker_fills(orders: DataFrame) -> DataFrame:
    """Filled orders that rested between bid and ask."""
    return orders.filter(
        (F.col("placed_price") >= F.col("bid_at_place")) & (F.col("placed_price") < F.col("ask_at_place")) & (F.col("fill_latency_ms") >= 0)
        & F.col("ticks_above_best_bid").isNotNull())


def fill_model_per_tick(orders: DataFrame, poll_ms: int = 250, min_samples: int = 5) -> DataFrame:
    rows = maker_fills(orders)
    n = rows.groupBy("ticks_above_best_bid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples)
    med = exact_quantiles(rows, ["ticks_above_best_bid"], F.col("fill_latency_ms").cast("double"), {"median_latency_ms": 0.5}, interpolate=True)
    return n.join(med, "ticks_above_best_bid").withColumn("p_hat", geometric_p(F.col("median_latency_ms"), poll_ms))


def fill_model_calibration(orders: DataFrame, poll_ms: int = 250, min_samples: int = 5) -> DataFrame:
    """Fit ``p(k) = p0 * mult^k`` on the per-tick probabilities; one row."""
    per_tick = fill_model_per_tick(orders, poll_ms, min_samples)
    x, y = F.col("ticks_above_best_bid").cast("double"), F.ln(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col("p_hat"))))
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    level = F.coalesce(F.regr_intercept(y, x), F.max(y))
    fit = per_tick.agg(F.count(F.lit(1)).alias("ticks"), F.least(F.lit(1.0), F.exp(level)).alias("p0"), F.exp(slope).alias("mult"), F.max("p_hat").alias("p_max"))
    share = F.col("first_matched_size") / F.col("requested_size")
    rows = maker_fills(orders).withColumns({"share": F.when((share > 0) & (share <= 1), F.round(share, 6)),
                                           "k0": F.when(F.col("ticks_above_best_bid") == 0, F.col("fill_latency_ms").cast("double"))})
    frac = exact_quantiles(rows, [], F.col("share"), {"median_first_fill_share": 0.5}, interpolate=True)
    lat = exact_quantiles(rows, [], F.col("k0"), {"q10": 0.1, "q50": 0.5, "q90": 0.9}, interpolate=True)
    p = lambda c: geometric_p(F.col(c), poll_ms)
    factor = lambda q: lat.select(clamp(div(p(q), p("q50")), 0.1, 5.0).alias("f")).scalar()
    return fit.select(F.lit("ALL").alias("scope"), "*", frac.scalar().alias("median_first_fill_share"), factor("q90").alias("queue_factor_min"), factor("q10").alias("queue_factor_max"))


def fills_from_status(status: DataFrame, strategy_orders: DataFrame) -> DataFrame:
    """Positive steps of the cumulative matched size as trade prints of their market."""
    polls = status.filter(F.col("matched_size").isNotNull() & F.col("order_id").isNotNull())
    steps = ordered_scan(polls, ["order_id"], time_segment("ts"), ["ts", "event_key"], previous={"_before": F.col("matched_size")})
    fills = steps.withColumn("delta_size", F.col("matched_size") - F.coalesce("_before", F.lit(0.0))).filter(
        (F.col("delta_size") > 0) & F.col("requested_price").isNotNull())
    mapping = strategy_orders.filter(F.col("market_slug").isNotNull()).groupBy("order_id").agg(
        F.max_by(F.struct("market_slug", "direction"), F.struct("ts", "event_key")).alias("_m"))
    return fills.join(mapping, "order_id").select(
        "order_id", "ts", F.col("_m.market_slug").alias("market_slug"), F.when(F.upper("_m.direction") == "UP", "Up").otherwise("Down").alias("outcome"),
        "side", F.col("requested_price").alias("price"), F.col("delta_size").alias("size"))


def order_dashboard(strategy_orders: DataFrame, status: DataFrame) -> DataFrame:
    """Orders, fills and cancels per market."""
    ok = F.col("success")
    placed = strategy_orders.groupBy("market_slug").agg(
        F.count_distinct("order_id").alias("orders"), count_if(ok & (F.col("action") == "PLACE")).alias("places"),
        count_if(ok & (F.col("action") == "REPLACE")).alias("replaces"), count_if(ok & (F.col("action") == "CANCEL")).alias("cancels"),
        count_if(~ok).alias("failures"), F.max("ts").alias("last_event_at"))
    fills = fills_from_status(status, strategy_orders).groupBy("market_slug").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("size").alias("filled_size"), F.sum(F.col("price") * F.col("size")).alias("filled_notional"))
    return placed.join(fills, "market_slug", "left").fillna({"fills": 0, "filled_size": 0.0, "filled_notional": 0.0})


# ---- order streams ---------------------------------------------------------------------------


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the left-closed bin; the last bin is closed, larger values overflow into one more, smaller ones have none."""
    last = len(edges) - 2
    label = F.lit(None).cast("int")
    for i in reversed(range(last + 1)):
        upper = value <= edges[i + 1] if i == last else value < edges[i + 1]
        label = F.when((value >= edges[i]) & upper, i).otherwise(label)
    return F.coalesce(label, F.when(value > edges[-1], last + 1))


# Bin edges of the four compared distributions.
CADENCE_BINS = (0, 0.25, 0.5, 1, 2, 5, 10)
LATENCY_BINS = (0, 2, 5, 10, 30, 60, 120)
IMBALANCE_BINS = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8)


def order_stream_score(first: DataFrame, second: DataFrame, key: str = "market_slug", cadence=CADENCE_BINS, latency=LATENCY_BINS) -> DataFrame:
    """Distances of cadence, reprice rate, pair latency and imbalance between two trade streams.

    Both need ``market_slug, token_id, outcome, ts, event_key, price, size``. The streams are stacked with a tag and read once; one ordered scan gives gaps and repricings,
    one scan the nearest trade of the opposite outcome in either direction, and one aggregate counts the bins of all components.
    """
    columns = [key, "token_id", "outcome", "ts", "event_key", "price", "size"]
    both = checkpointed(first.select(F.lit("a").alias("stream"), *columns).unionByName(second.select(F.lit("b").alias("stream"), *columns)))
    cell = lambda name, label: F.struct(F.lit(name).alias("component"), label.cast("int").alias("bin"))

    gaps = ordered_scan(both, ["stream", "token_id"], time_segment("ts"), ["ts", "event_key"], previous={"_p": F.col("ts"), "_price": F.col("price")})
    gap = (F.unix_micros("ts") - F.unix_micros("_p")) / F.lit(1e6)
    repriced = (F.col("price") != F.col("_price")).cast("int")
    paced = gaps.select("stream", F.explode(F.array(cell("cadence_l1", bin_of(gap, cadence)), cell("reprice_l1", repriced))).alias("c"))

    # a trade looks among the trades of the other outcome of its market
    place = lambda outcome: F.concat_ws("|", "stream", outcome, key)
    sided = both.filter(F.col("outcome").isin("Up", "Down")).withColumns({"_own": place("outcome"), "_other": place(F.when(F.col("outcome") == "Up", "Down").otherwise("Up"))})
    sided = sided.filter(F.col(key).isNotNull())
    nearest = asof_nearest(sided.select("stream", "_other", "ts", "event_key"), sided.select("_own", "ts", "event_key"), "_other", "_own", tie=["event_key"])
    signed = (F.unix_micros("nearest_ts") - F.unix_micros("ts")) / F.lit(1e6)
    paired = nearest.filter(signed > 0).select("stream", cell("pair_latency_l1", bin_of(signed, latency)).alias("c"))

    size = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("size"))), F.lit(0.0))
    sides = both.groupBy("stream", key).agg(size("Up").alias("u"), size("Down").alias("d"))
    tilt = F.when(F.col("u") + F.col("d") > 0, F.abs(F.col("u") - F.col("d")) / (F.col("u") + F.col("d")))
    tilted = sides.select("stream", cell("imbalance_l1", bin_of(tilt, IMBALANCE_BINS)).alias("c"))

    counts = paced.unionByName(paired).unionByName(tilted).select("stream", "c.*").filter("bin IS NOT NULL").groupBy("component", "bin").agg(
        count_if(F.col("stream") == "a").alias("x"), count_if(F.col("stream") == "b").alias("y"))
    totals = counts.groupBy("component").agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
    shares = counts.join(totals, "component")
    return shares.groupBy("component").agg(F.sum(F.abs(div0("x", "all_x") - div0("y", "all_y"))).alias("l1"))
