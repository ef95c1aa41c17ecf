"""Market, book and settlement column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelens.functions.numeric import col, div, seconds_between

# Slug markers, window length and resolution cut-offs of the markets.
SLUG_15M = "updown-15m-"
SLUG_15M_SECONDS = 900
RESOLVED_HIGH = 0.999
RESOLVED_LOW = 0.001
UINT32_MAX = 4_294_967_295

# Quote size in shares by series and seconds to end; (upper bound, shares), then the rest.
REPLICA_SIZES = {
    "btc-15m": ([(60, 11.0), (180, 13.0), (300, 17.0), (600, 19.0)], 20.0),
    "eth-15m": ([(60, 8.0), (180, 10.0), (300, 12.0), (600, 13.0)], 14.0),
    "btc-1h": ([(60, 9.0), (180, 10.0), (300, 11.0), (600, 12.0), (900, 14.0), (1200, 15.0), (1800, 17.0)], 18.0),
    "eth-1h": ([(60, 7.0), (300, 8.0), (600, 9.0), (900, 11.0), (1200, 12.0), (1800, 13.0)], 14.0),
}
# Flat quote size per series.
FLAT_SIZES = {"btc-15m": 19.0, "eth-15m": 14.0, "btc-1h": 18.0, "eth-1h": 14.0}


def signed(side: Column | str, value: Column) -> Column:
    return F.when(col(side) == "BUY", value).otherwise(-value)


def slug_epoch(slug: Column | str) -> Column:
    """Last dash-separated token as an unsigned 32-bit number, 0 when it is none."""
    token = F.element_at(F.split(col(slug), "-"), -1)
    number = F.when(token.rlike("^[0-9]{1,10}$"), token.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.when(number > UINT32_MAX, F.lit(0).cast("bigint")).otherwise(number)


def is_15m(slug: Column | str) -> Column:
    return F.instr(col(slug), SLUG_15M) > 0


def slug_end(slug: Column | str) -> Column:
    epoch = slug_epoch(slug)
    return F.when(is_15m(slug) & (epoch > 0), F.timestamp_seconds(epoch + SLUG_15M_SECONDS))


def seconds_to_slug_end(slug: Column | str, ts: Column | str) -> Column:
    return slug_epoch(slug) + SLUG_15M_SECONDS - F.unix_seconds(col(ts))


def series_of(slug: Column | str, title: Column | str) -> Column:
    return (
        F.when(is_15m(slug), "updown-15m")
        .when(F.instr(F.lower(col(title)), "up or down") > 0, "up-or-down")
        .when(F.instr(F.lower(col(slug)), "updown") > 0, "updown")
        .otherwise("other")
    )


def replay_series(slug: Column | str) -> Column:
    s = col(slug)
    return (
        F.when(s.startswith("btc-updown-15m-"), "btc-15m")
        .when(s.startswith("eth-updown-15m-"), "eth-15m")
        .when(s.startswith("bitcoin-up-or-down-"), "btc-1h")
        .when(s.startswith("ethereum-up-or-down-"), "eth-1h")
        .otherwise("other")
    )


def is_updown(slug: Column | str) -> Column:
    return col(slug).contains("updown") | col(slug).contains("up-or-down")


def asset_of(slug: Column | str) -> Column:
    """Upper-case first slug token of a 15-minute market, empty otherwise."""
    return F.when(is_15m(slug), F.upper(F.split_part(col(slug), F.lit("-"), F.lit(1)))).otherwise("")


def book_known(captured: str = "tob_captured_at", bid: str = "best_bid_price", ask: str = "best_ask_price") -> Column:
    return F.coalesce(F.col(captured).isNotNull() & (F.col(bid) > 0) & (F.col(ask) > 0), F.lit(False))


def exec_type(known: Column, eps: float = 1e-6, price: str = "price", bid: str = "best_bid_price",
              ask: str = "best_ask_price") -> Column:
    """Where a trade printed against the book; the first rule that applies wins."""
    p, b, a = F.col(price), F.col(bid), F.col(ask)
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    at_ask, at_bid = p >= a - F.lit(eps), p <= b + F.lit(eps)
    return (
        F.when(~known, "UNKNOWN")
        .when(buy & at_ask, "TAKER_LIKE")
        .when(buy & at_bid, "MAKER_LIKE")
        .when(sell & at_bid, "TAKER_LIKE")
        .when(sell & at_ask, "MAKER_LIKE")
        .when((p > b + F.lit(eps)) & (p < a - F.lit(eps)), "INSIDE")
        .otherwise("OUTSIDE")
    )


def exec_type_loose(price: str, bid: str, ask: str, mid: str, eps: float = 1e-3) -> Column:
    """Variant that tolerates a one-sided book and has no OUTSIDE class."""
    p, b, a = F.col(price), F.col(bid), F.col(ask)
    buy, sell = F.col("side") == "BUY", F.col("side") == "SELL"
    return (
        F.when((a > 0) & buy & (p >= a - F.lit(eps)), "TAKER_LIKE")
        .when((b > 0) & buy & (p <= b + F.lit(eps)), "MAKER_LIKE")
        .when((b > 0) & sell & (p <= b + F.lit(eps)), "TAKER_LIKE")
        .when((a > 0) & sell & (p >= a - F.lit(eps)), "MAKER_LIKE")
        .when(F.col(mid) > 0, "INSIDE")
        .otherwise("UNKNOWN")
    )


def edge_vs_mid(price: str = "price", mid: str = "mid") -> Column:
    gap = F.col(mid) - F.col(price)
    return F.when(F.col(mid) > 0, F.when(F.col("side") == "BUY", gap).when(F.col("side") == "SELL", -gap))


def effective_spread(price: str = "price", mid: str = "mid") -> Column:
    return F.when(F.col(mid) > 0, F.lit(2.0) * F.abs(F.col(price) - F.col(mid)))


def imbalance(bid_size: Column | str, ask_size: Column | str) -> Column:
    b, a = col(bid_size), col(ask_size)
    return F.when((b + a) > 0, div(b - a, b + a))


def is_resolved(prices: Column | str = "outcome_prices") -> Column:
    p = col(prices)
    return F.coalesce((F.array_max(p) >= RESOLVED_HIGH) & (F.array_min(p) <= RESOLVED_LOW), F.lit(False))


def settle_price(outcome: Column | str = "outcome", outcomes: Column | str = "outcomes",
                 prices: Column | str = "outcome_prices") -> Column:
    """Settlement value of an outcome once its market is resolved."""
    index = F.array_position(col(outcomes), col(outcome)).cast("int")
    return F.when(is_resolved(prices) & (index > 0), F.try_element_at(col(prices), F.nullif(index, F.lit(0))))


def resolved_outcome(outcomes: Column | str = "outcomes", prices: Column | str = "outcome_prices") -> Column:
    index = F.array_position(col(prices), F.array_max(col(prices))).cast("int")
    return F.when(is_resolved(prices), F.try_element_at(col(outcomes), F.nullif(index, F.lit(0))))


def trade_pnl(settle: Column, price: str = "price", size: str = "size") -> Column:
    gain = settle - F.col(price)
    return F.col(size) * F.when(F.col("side") == "SELL", -gain).otherwise(gain)


def opposite_token(tokens: Column | str = "token_ids", outcomes: Column | str = "outcomes",
                   outcome: Column | str = "outcome") -> Column:
    """The other token of a two-outcome market."""
    index = F.array_position(col(outcomes), col(outcome)).cast("int")
    two = F.size(col(tokens)) == 2
    return F.when(two & index.isin(1, 2), F.try_element_at(col(tokens), F.lit(3) - index))


def replica_size(series: Column | str, seconds_to_end: Column | str) -> Column:
    s, left = col(series), F.coalesce(col(seconds_to_end), F.lit(0))
    out = None
    for name, (steps, rest) in REPLICA_SIZES.items():
        shares = None
        for bound, size in steps:
            shares = F.when(left < bound, size) if shares is None else shares.when(left < bound, size)
        shares = shares.otherwise(rest)
        out = F.when(s == name, shares) if out is None else out.when(s == name, shares)
    return out.otherwise(0.0)


def flat_size(series: Column | str) -> Column:
    out = None
    for name, shares in FLAT_SIZES.items():
        out = F.when(col(series) == name, shares) if out is None else out.when(col(series) == name, shares)
    return out


def bucket_label(value: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Label of the left-closed bin holding ``value``; the last bin is closed, above it is overflow."""
    names = list(labels or [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:])])
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    last = len(edges) - 2
    for i, name in enumerate(names[: last + 1]):
        upper = value <= edges[i + 1] if i == last else value < edges[i + 1]
        out = out.when((value >= edges[i]) & upper, name)
    return out.when(value > edges[-1], f">{edges[-1]:g}")


def seconds_to(ts: Column | str, end: Column | str) -> Column:
    return seconds_between(ts, end)
