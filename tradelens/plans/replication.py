"""How well a quoting rule would have reproduced reference trades, and how alike two users trade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.functions.numeric import avg_if, count_if, div, div0, sum_if
from tradelens.operators.quantiles import exact_quantiles

# Limits of the quoting rule.
MAX_SECONDS_TO_END = 3600
MIN_EDGE = 0.01
MIN_EDGE_V2 = 0.0099
TAKER_MAX_EDGE = 0.015
TAKER_MAX_SPREAD = 0.02
NEAR_BID = 0.01
AT_QUOTE = 0.005
EPS = 1e-9


def replay_input(enriched_opposite: DataFrame) -> DataFrame:
    """Up/down trades with both sides of the book; quotes may be missing."""
    bid = F.coalesce("ws_best_bid_price", "best_bid_price")
    other = F.col("ws_opp_best_bid_price")
    rows = enriched_opposite.withColumn("series", C.replay_series("market_slug")).filter("series != 'other'")
    return rows.withColumns({
        "our_best_bid": bid, "other_best_bid": other,
        "complete_set_edge": F.lit(1.0) - F.coalesce(bid, F.lit(0.0)) - F.coalesce(other, F.lit(0.0)),
        "has_our_tob": F.coalesce(bid > 0, F.lit(False)), "has_other_tob": F.coalesce(other > 0, F.lit(False)),
    })


def _outcome(rows: DataFrame, quote: Column, shares: Column, would: str = "would_quote") -> DataFrame:
    hit = F.col(would) & F.col("likely_would_fill")
    return rows.withColumns({
        "our_quote_price": quote, "our_quote_size": shares,
        "simulated_pnl": F.when(hit, (F.col("settle_price") - quote) * shares).otherwise(0.0),
    })


def _in_window() -> Column:
    return F.coalesce(F.col("seconds_to_end").between(0, MAX_SECONDS_TO_END), F.lit(False))


def decide(rows: DataFrame, sizes: Column | None = None) -> DataFrame:
    """Whether the rule would have quoted and filled each reference trade (v1 rules)."""
    edge = F.coalesce(F.col("has_our_tob") & F.col("has_other_tob") & (F.col("complete_set_edge") >= MIN_EDGE - EPS), F.lit(False))
    fill = F.coalesce(F.col("price") <= F.col("our_best_bid") + NEAR_BID + EPS, F.lit(False))
    staged = rows.withColumns({"in_time_window": _in_window(), "has_sufficient_edge": edge, "likely_would_fill": fill}).withColumn(
        "would_quote", F.col("in_time_window") & F.col("has_sufficient_edge"))
    quote, fills = F.col("would_quote"), F.col("likely_would_fill")
    kind = (
        F.when(quote & fills, "MATCH").when(quote, "WOULD_QUOTE_NO_FILL").when(~F.col("in_time_window"), "OUTSIDE_TIME_WINDOW")
        .when(~F.col("has_sufficient_edge"), "INSUFFICIENT_EDGE").otherwise("NO_TOB_DATA"))
    shares = sizes if sizes is not None else C.replica_size("series", "seconds_to_end")
    return _outcome(staged.withColumn("match_type", kind), F.col("our_best_bid"), shares)


def decide_clean(clean: DataFrame) -> DataFrame:
    """The same on the clean table with one flat size per series."""
    return decide(clean.withColumns({"has_our_tob": F.lit(True), "has_other_tob": F.lit(True)}), C.flat_size("series"))


def decide_v2(clean: DataFrame) -> DataFrame:
    """Rule with a taker mode for thin edges and tight spreads."""
    spread = F.col("our_best_ask") - F.col("our_best_bid")
    edge, price = F.col("complete_set_edge"), F.col("price")
    take = F.coalesce((edge >= MIN_EDGE_V2) & (edge < TAKER_MAX_EDGE) & (spread <= TAKER_MAX_SPREAD + EPS), F.lit(False))
    maker = F.coalesce(price <= F.col("our_best_bid") + AT_QUOTE, F.lit(False))
    taker = F.coalesce(price >= F.col("our_best_ask") - AT_QUOTE, F.lit(False))
    near = F.coalesce(price <= F.col("our_best_bid") + NEAR_BID + EPS, F.lit(False))
    staged = clean.withColumns({
        "our_spread": spread, "in_time_window": _in_window(), "has_sufficient_edge": edge >= MIN_EDGE_V2, "should_take": take,
        "is_maker_fill": maker, "is_taker_fill": taker,
    }).withColumns({
        "would_trade": F.col("in_time_window") & F.col("has_sufficient_edge"),
        "likely_would_fill": F.when(F.col("should_take"), F.col("is_taker_fill")).otherwise(near),
    })
    trade, mode = F.col("would_trade"), F.col("should_take")
    kind = (
        F.when(trade & mode & F.col("is_taker_fill"), "TAKER_MATCH").when(trade & ~mode & F.col("is_maker_fill"), "MAKER_MATCH")
        .when(trade & mode & F.col("is_maker_fill"), "TAKER_MODE_BUT_MAKER_FILL")
        .when(trade & ~mode & F.col("is_taker_fill"), "MAKER_MODE_BUT_TAKER_FILL")
        .when(trade & ~F.col("likely_would_fill"), "WOULD_TRADE_NO_FILL").when(~F.col("in_time_window"), "OUTSIDE_TIME_WINDOW")
        .when(~F.col("has_sufficient_edge"), "INSUFFICIENT_EDGE").otherwise("UNKNOWN"))
    quote = F.when(mode, F.col("our_best_ask")).otherwise(F.col("our_best_bid"))
    out = staged.withColumns({"match_type": kind, "is_match": trade & F.col("likely_would_fill")})
    return _outcome(out, quote, C.replica_size("series", "seconds_to_end"), "would_trade")


def _pct(part: Column, whole: Column) -> Column:
    return F.round(div(part * 100.0, whole) + EPS, 2)


def replication_scores(decisions: DataFrame, keys: Sequence[str], would: str = "would_quote", matched: Column | None = None) -> DataFrame:
    """Rates, size and PnL comparison per group."""
    hit = matched if matched is not None else F.col("match_type") == "MATCH"
    n, quoted, matches = F.count(F.lit(1)), count_if(F.col(would)), count_if(hit)
    gap = F.col("price") - F.col("our_quote_price")
    return decisions.groupBy(*keys).agg(
        n.alias("total_trades"), quoted.alias("would_quote"), matches.alias("matches"), _pct(quoted, n).alias("quote_rate_pct"),
        _pct(matches, n).alias("match_rate_pct"), _pct(matches, F.nullif(quoted, F.lit(0))).alias("fill_rate_pct"),
        avg_if(gap, hit).alias("avg_price_diff"), avg_if(F.abs(gap), hit).alias("avg_abs_price_diff"),
        avg_if("size", hit).alias("avg_actual_size"), avg_if("our_quote_size", hit).alias("avg_our_size"),
        div(avg_if("size", hit), avg_if("our_quote_size", hit)).alias("size_ratio"),
        F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("reference_pnl"), sum_if("simulated_pnl", hit).alias("simulated_pnl"),
        sum_if("realized_pnl", hit).alias("reference_pnl_on_matches"), F.avg("complete_set_edge").alias("avg_edge"))


def edge_medians(decisions: DataFrame, keys: Sequence[str], matched: Column) -> DataFrame:
    """Interpolated medians of the price gap on matches and of the edge."""
    gap = F.when(matched, F.round(F.col("price") - F.col("our_quote_price"), 6))
    a = exact_quantiles(decisions, keys, gap, {"median_price_diff": 0.5}, interpolate=True)
    b = exact_quantiles(decisions, keys, F.round("complete_set_edge", 6), {"median_edge": 0.5}, interpolate=True)
    return b.join(a, list(keys), "left")


def match_types(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return decisions.groupBy(*keys, "match_type").agg(F.count(F.lit(1)).alias("trades"))


def maker_taker(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n, trade, mode = F.count(F.lit(1)), F.col("would_trade"), F.col("should_take")
    maker, taker = F.col("is_maker_fill"), F.col("is_taker_fill")
    aligned_t, aligned_m = count_if(mode & taker), count_if(~mode & maker & trade)
    return decisions.groupBy(*keys).agg(
        n.alias("total_trades"), count_if(maker).alias("maker_fills"), count_if(taker).alias("taker_fills"), _pct(count_if(maker), n).alias("maker_pct"),
        _pct(count_if(taker), n).alias("taker_pct"), count_if(mode).alias("would_take"), count_if(~mode & trade).alias("would_make"),
        _pct(count_if(mode), F.nullif(count_if(trade), F.lit(0))).alias("taker_rate_pct"), aligned_t.alias("aligned_taker"), aligned_m.alias("aligned_maker"),
        _pct(aligned_t + aligned_m, F.nullif(count_if(trade), F.lit(0))).alias("mode_alignment_pct"))


# ---- distribution distance -------------------------------------------------------------------


def mix_distance(rows: DataFrame, first: Column, second: Column, dims: Mapping[str, Column]) -> DataFrame:
    """L1 distance between two groups' normalised histograms, one row per dimension.

    The dimensions are stacked, so one aggregate builds every histogram of both groups.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("bin")) for n, c in dims.items()])
    counts = rows.filter(first | second).select(first.alias("a"), second.alias("b"), F.explode(cells).alias("c")).groupBy("c.dimension", "c.bin").agg(
        count_if(F.col("a")).alias("na"), count_if(F.col("b")).alias("nb"))
    totals = counts.groupBy("dimension").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return counts.join(totals, "dimension").groupBy("dimension").agg(
        F.sum(F.abs(div0("na", "ta") - div0("nb", "tb"))).alias("l1"))


def distribution_score(distances: DataFrame) -> DataFrame:
    return distances.agg(F.avg("l1").alias("avg_l1"), F.greatest(F.lit(0.0), F.lit(100.0) * (1 - F.avg("l1") / 2)).alias("score"))
