"""Order-book side columns: arrays of ``struct<price, size>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradelens.functions.columns import imbalance
from tradelens.functions.numeric import col


def top_levels(levels: Column | str, n: int, descending: bool) -> Column:
    """Best ``n`` levels: highest bids or lowest asks first."""
    ordered = F.array_sort(col(levels))
    return F.slice(F.reverse(ordered) if descending else ordered, 1, n)


def volume(levels: Column | str) -> Column:
    return F.aggregate(col(levels), F.lit(0.0), lambda acc, level: acc + level["size"])


def usable(levels: Column | str) -> Column:
    """Levels with a positive price and size."""
    return F.filter(col(levels), lambda level: (level["price"] > 0) & (level["size"] > 0))


def best_price(levels: Column | str, highest: bool) -> Column:
    prices = F.transform(col(levels), lambda level: level["price"])
    return F.array_max(prices) if highest else F.array_min(prices)


def book_metrics(bids: Column | str, asks: Column | str, band: float = 0.01, depth: int = 10) -> dict[str, Column]:
    """Volumes and imbalance of the top levels, and the size resting within ``band`` of the mid."""
    top_bids = usable(top_levels(bids, depth, True))
    top_asks = usable(top_levels(asks, depth, False))
    mid = (best_price(bids, True) + best_price(asks, False)) / 2
    bid_volume, ask_volume = volume(top_bids), volume(top_asks)
    near = volume(F.filter(top_bids, lambda x: x["price"] >= mid * (1 - band))) + volume(
        F.filter(top_asks, lambda x: x["price"] <= mid * (1 + band)))
    return {
        "total_bid_volume": bid_volume,
        "total_ask_volume": ask_volume,
        "book_imbalance": imbalance(bid_volume, ask_volume),
        "depth_near_mid": F.when(mid > 0, near),
    }
