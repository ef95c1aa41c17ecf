"""The driver's contract and fixed numeric cases."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tradelens.plans import follow, traders


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all("r6(" not in s and "v_" + "trades_raw AS" not in s[:5] for s in entry.oracle_sql().values())


def test_mirror_sizing_scales_by_capital_and_weight(spark):
    df = spark.createDataFrame([("a", "BUY", 1000.0, 0.5, 0.10, 100000.0), ("b", "SELL", 1000.0, 0.5, 0.10, None), ("c", "BUY", 1.0, 0.5, 0.10, 100000.0)],
                               "k string, side string, shares double, price double, weight double, trader_capital double")
    rows = {r.k: r for r in follow.mirror_sizing(df, fund_capital=10_000, min_trade_usd=5.0).collect()}
    assert float(rows["a"].fund_shares) == 10.0 and float(rows["a"].limit_price) == 0.51
    assert float(rows["b"].fund_shares) == 100.0 and float(rows["b"].limit_price) == 0.49
    assert float(rows["c"].fund_shares) == 0.0


def test_classifier_first_category_wins_ties(spark):
    m = spark.createDataFrame([("lakers-win-nba-championship",), ("btc-nba",), ("nothing",)], "market_slug string")
    patterns = {"CRYPTO": [r"\bbtc\b"], "SPORTS": [r"\bnba\b", "lakers", "championship"]}
    rows = {r.market_slug: r for r in traders.classify_markets(m, patterns).collect()}
    assert (rows["lakers-win-nba-championship"].category, rows["lakers-win-nba-championship"].confidence) == ("SPORTS", 0.75)
    assert rows["btc-nba"].category == "CRYPTO" and rows["nothing"].category == "OTHER"


def test_entry_has_rows(spark):
    assert entry.entry(spark).filter(F.col("position_shares").isNotNull()).limit(1).count() == 1
