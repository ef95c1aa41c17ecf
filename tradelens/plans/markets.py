"""Market table jobs: resolutions, token prices, arbitrage scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.plans.positions import latest_quotes

WINNER_PRICE = 0.99


def resolution_extract(markets: DataFrame, resolved: Column) -> DataFrame:
    """Resolved flag and the first outcome priced as the winner; index -1 and no name when there is none."""
    marked = F.transform("outcome_prices", lambda p: p >= WINNER_PRICE)
    index = F.coalesce(F.array_position(marked, True), F.lit(0).cast("bigint")) - 1
    hit = F.when(resolved, index).otherwise(-1).cast("int")
    name = F.when(hit >= 0, F.get("outcomes", hit)).otherwise("")
    return markets.select(
        "condition_id", F.col("slug").alias("market_slug"), resolved.alias("is_resolved"),
        F.coalesce(name, F.lit("")).alias("winning_outcome"), hit.alias("winning_outcome_index"),
        "outcome_prices", "outcomes", F.col("end_date").alias("end_time"))


def token_prices(ws_tob: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Mid of the newest quote, else its last trade price."""
    quotes = latest_quotes(ws_tob).withColumnRenamed("asset_id", "token_id")
    if tokens is not None:
        quotes = quotes.join(tokens, "token_id", "left_semi")
    both = (F.col("best_bid_price") > 0) & (F.col("best_ask_price") > 0)
    price = F.when(both, (F.col("best_bid_price") + F.col("best_ask_price")) / 2).otherwise(F.col("last_trade_price"))
    return quotes.select("token_id", price.alias("price"))


def arb_scan(markets: DataFrame, ws_tob: DataFrame, as_of: Column, days: int = 7, min_edge: float = 0.02,
             min_size: float = 50.0) -> DataFrame:
    """Live two-outcome markets near their end whose two asks sum to clearly less than one."""
    soon = as_of + F.make_dt_interval(F.lit(days))
    live = markets.withColumn("end_date", F.coalesce("end_date", C.slug_end("slug"))).filter(
        F.col("active") & (F.col("end_date") > as_of) & (F.col("end_date") <= soon) & (F.size("token_ids") == 2))
    legs = live.select("slug", "end_date", F.posexplode("token_ids").alias("leg", "asset_id"))
    quotes = latest_quotes(ws_tob).select("asset_id", "best_ask_price", "best_ask_size")
    pick = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    priced = legs.join(quotes, "asset_id").groupBy("slug", "end_date").agg(
        pick(0, "best_ask_price").alias("yes_ask"), pick(0, "best_ask_size").alias("yes_size"),
        pick(1, "best_ask_price").alias("no_ask"), pick(1, "best_ask_size").alias("no_size"))
    edge = F.lit(1.0) - (F.col("yes_ask") + F.col("no_ask"))
    return priced.withColumns({"edge": edge, "max_shares": F.least("yes_size", "no_size")}).filter(
        (F.col("yes_ask") > 0) & (F.col("no_ask") > 0) & (F.round("edge", 9) >= min_edge) & (F.col("yes_size") >= min_size)
        & (F.col("no_size") >= min_size))
