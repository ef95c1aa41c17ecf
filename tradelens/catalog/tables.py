"""The engine's tables as plain projections of the given parquet tables.

Every method is lazy and reads only the columns it needs. ``oracle_views.py`` states the same
projections in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions import columns as C
from tradelens.operators.latest import latest_per_key
from tradelens.plans import enrich
from tradelens.session import pin_utc

TRADERS = 200
AS_OF = "2001-11-10 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def seconds(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))


def event_key() -> Column:
    """What a line's trade is known by."""
    return F.concat_ws("-", F.lit("evt"), F.col("l_orderkey"), F.col("l_linenumber"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
                 if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(casts) if casts else df

    # ---- lines -------------------------------------------------------------------------------

    def lines(self, owners: DataFrame | None = None) -> DataFrame:
        """Order lines with the market, token, price and clock every trading table shares. With ``owners`` (by l_orderkey) joined before, so that no derived text is shuffled."""
        pk = F.col("l_partkey")
        li = self.read("lineitem")
        li = li if owners is None else li.join(owners, "l_orderkey")
        slug = F.when(
            pk % 2 == 0,
            F.concat(F.when(pk % 4 == 0, "btc").otherwise("eth"), F.lit("-updown-15m-"),
                     F.unix_seconds("l_shipdate").cast("string")),
        ).otherwise(F.concat(F.lit("topic-"), (pk % 40).cast("string")))
        offset = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + pk * 31) % F.when(pk % 2 == 0, 900).otherwise(86400)
        return li.select(
            "*",
            slug.alias("slug"),
            F.when(F.col("l_linestatus") == "O", "Up").otherwise("Down").alias("outcome"),
            (F.col("l_shipdate") + seconds(offset)).alias("ts"),
            event_key().alias("event_key"),
            F.round(F.lit(0.05) + F.lit(9) * F.col("l_discount"), 2).alias("price"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )

    @staticmethod
    def _trade_columns() -> list[Column]:
        pk = F.col("l_partkey")
        title = F.when(pk % 2 == 0, F.concat(F.upper(F.split_part("slug", F.lit("-"), F.lit(1))), F.lit(" 15m"))).when(
            pk % 40 % 3 == 0, F.concat(F.lit("Topic "), (pk % 40).cast("string"), F.lit(" Up or Down"))
        ).otherwise(F.concat(F.lit("Topic "), (pk % 40).cast("string")))
        return [
            F.col("ts"),
            F.col("l_suppkey").alias("version"),
            F.col("slug").alias("market_slug"),
            title.alias("title"),
            F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("token_id"),
            F.concat(F.lit("c-"), F.col("slug")).alias("condition_id"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("outcome"),
            F.when(F.col("outcome") == "Up", 0).otherwise(1).alias("outcome_index"),
            F.col("price"),
            F.col("l_quantity").alias("size"),
            (F.col("price") * F.col("l_quantity")).alias("notional"),
            F.when(F.col("l_linenumber") != 7, F.concat(F.lit("0xT"), F.col("l_orderkey").cast("string")))
            .alias("transaction_hash"),
        ]

    def _owned_lines(self) -> DataFrame:
        owners = self.read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.concat(F.lit("u"), (F.col("o_custkey") % TRADERS).cast("string")).alias("username"),
        )
        return self.lines(owners)

    @staticmethod
    def _address() -> Column:
        return F.concat(F.lit("0xA"), F.substring("username", 2, 9)).alias("proxy_address")

    def trades_raw(self) -> DataFrame:
        """User trades with replays: several versions per (username, event_key)."""
        return self._owned_lines().select(F.col("username"), F.col("event_key"), self._address(), *self._trade_columns())

    def trades(self) -> DataFrame:
        """The newest version of each trade. The numbers of its line stand for the event key, which is made of them: lines that met for the join are not shuffled again."""
        line = ["l_orderkey", "l_linenumber"]
        rows = latest_per_key(self._owned_lines().select("username", *line, *self._trade_columns()), ["username", *line], ["version"])
        return rows.select("username", event_key().alias("event_key"), self._address(), *[c for c in rows.columns if c not in ("username", *line)])

    # ---- books -------------------------------------------------------------------------------

    def _quoted(self) -> DataFrame:
        """Top-of-book snapshots taken when a trade arrived."""
        sk = F.col("l_suppkey")
        bid = F.when(sk % 11 != 0, F.round(F.col("price") - F.lit(0.01) * (sk % 4), 2))
        return self.lines().filter(sk % 5 != 0).select(
            F.col("event_key").alias("trade_key"),
            F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("token_id"),
            (F.col("ts") + seconds(sk * 37 % 4000 / F.lit(1000.0))).alias("captured_at"),
            F.col("slug").alias("market_slug"),
            F.col("outcome"),
            bid.alias("best_bid_price"),
            F.col("l_quantity").alias("best_bid_size"),
            F.round(F.col("price") - F.lit(0.01) * (sk % 4) + F.lit(0.02), 2).alias("best_ask_price"),
            (F.col("l_partkey") % 30 + 1).cast("double").alias("best_ask_size"),
        )

    @staticmethod
    def _with_levels(quoted: DataFrame) -> DataFrame:
        """The first levels and totals of the book, all from its best quotes."""
        b, a = F.col("best_bid_price"), F.col("best_ask_price")
        level = lambda p, s: F.struct(F.round(p, 2).alias("price"), s.alias("size"))
        return quoted.select(
            "*",
            F.round((a + b) / 2, 4).alias("mid"),
            F.round(a - b, 4).alias("spread"),
            F.array(level(b, F.col("best_bid_size")), level(b - 0.01, F.col("best_bid_size") * 2)).alias("bid_levels"),
            F.array(level(a + 0.01, F.col("best_ask_size") * 2), level(a, F.col("best_ask_size"))).alias("ask_levels"),
            (F.col("best_bid_size") * 3).alias("total_bid_volume"),
            (F.col("best_ask_size") * 3).alias("total_ask_volume"),
        )

    def tob_raw(self) -> DataFrame:
        """Top-of-book snapshots taken when a trade arrived, with the first levels of the book."""
        return self._with_levels(self._quoted())

    def tob(self) -> DataFrame:
        """The newest snapshot of each trade. What follows from the best quotes is added after the newest is found, as it decides no tie."""
        return self._with_levels(latest_per_key(self._quoted(), ["trade_key", "token_id"], ["captured_at"]))

    def ws_tob(self) -> DataFrame:
        """Continuous top-of-book per token."""
        offset = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 900
        bid = F.round(F.col("price") - F.lit(0.01) * (F.col("l_suppkey") % 2), 2)
        return self.lines().select(
            F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("asset_id"),
            (F.col("l_shipdate") + seconds(offset)).alias("ts"),
            bid.alias("best_bid_price"),
            F.col("l_quantity").alias("best_bid_size"),
            F.round(bid + F.lit(0.01), 2).alias("best_ask_price"),
            (F.col("l_quantity") + 1).alias("best_ask_size"),
            F.col("price").alias("last_trade_price"),
            F.col("seq"),
            F.col("l_suppkey").alias("offset"),
        )

    def market_trades(self) -> DataFrame:
        """Public prints of all participants."""
        offset = (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7) % 900
        return self.lines().select(
            F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("token_id"),
            F.col("slug").alias("market_slug"),
            (F.col("l_shipdate") + seconds(offset)).alias("ts"),
            F.when(F.col("l_linenumber") % 2 == 0, "SELL").otherwise("BUY").alias("side"),
            F.col("price"),
            F.col("l_quantity").alias("size"),
            F.col("event_key"),
        )

    # ---- markets -----------------------------------------------------------------------------

    def markets_raw(self) -> DataFrame:
        """Market metadata snapshots."""
        pk = F.col("l_partkey")
        kind = F.when(pk % 2 == 0, F.datediff(F.col("l_shipdate"), F.lit("1970-01-01").cast("date"))).otherwise(
            (pk % 40).cast("int"))
        token = lambda name: F.concat(F.col("slug"), F.lit(f":{name}"))
        arr = lambda a, b: F.array(F.lit(a), F.lit(b))
        return self.lines().withColumn("kind", kind).select(
            "slug",
            (F.col("l_shipdate") + seconds(F.col("l_suppkey"))).alias("captured_at"),
            F.concat(F.lit("m-"), F.col("slug")).alias("market_id"),
            F.concat(F.lit("c-"), F.col("slug")).alias("condition_id"),
            F.when(pk % 2 == 1, F.to_timestamp(F.lit("2001-01-01")) + seconds(F.col("kind") * 86400))
            .when(F.col("kind") % 2 == 0, F.timestamp_seconds(C.slug_epoch("slug") + 900)).alias("end_date"),
            F.array(F.lit("Up"), F.lit("Down")).alias("outcomes"),
            F.when(F.col("kind") % 3 == 0, arr(1.0, 0.0)).when(F.col("kind") % 3 == 1, arr(0.0, 1.0))
            .otherwise(arr(0.5, 0.5)).alias("outcome_prices"),
            F.array(token("Up"), token("Down")).alias("token_ids"),
            (F.col("kind") % 3 == 2).alias("active"),
            F.col("l_extendedprice").alias("volume_num"),
            F.col("seq"),
        )

    def markets(self) -> DataFrame:
        return latest_per_key(self.markets_raw(), ["slug"], ["captured_at"])

    def resolutions(self) -> DataFrame:
        """Condition-level resolutions; open markets have no row."""
        m = self.markets()
        prices = F.col("outcome_prices")
        return m.filter(C.is_resolved(prices)).select(
            "condition_id",
            F.col("slug").alias("market_slug"),
            F.lit(True).alias("is_resolved"),
            C.resolved_outcome().alias("winning_outcome"),
            (F.array_position(prices, F.array_max(prices)) - 1).cast("int").alias("winning_outcome_index"),
            F.coalesce("end_date", C.slug_end("slug"), "captured_at").alias("resolution_time"),
        )

    # ---- trader tables -----------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self.read("customer").select(
            F.concat(F.lit("u"), (F.col("c_custkey") % TRADERS).cast("string")).alias("username"),
            F.concat(F.lit("0xA"), (F.col("c_custkey") % TRADERS).cast("string")).alias("proxy_address"),
            "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey",
        )

    def score_history(self) -> DataFrame:
        ck, bal = F.col("c_custkey"), F.col("c_acctbal")
        strategy = (
            F.when(F.col("c_mktsegment") == "BUILDING", "ARBITRAGEUR").when(F.col("c_mktsegment") == "MACHINERY", "MARKET_MAKER")
            .when(F.col("c_mktsegment") == "AUTOMOBILE", "DIRECTIONAL_FUNDAMENTAL")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "HYBRID").otherwise("UNKNOWN")
        )
        total = (F.lit(30) + ck * 13 % 70).cast("int")
        return self.customers().select(
            "proxy_address", "username", ck.alias("version"),
            total.alias("total_score"),
            F.when(total >= 80, "DIAMOND").when(total >= 60, "GOLD").when(total >= 40, "SILVER").otherwise("BRONZE").alias("tier"),
            strategy.alias("strategy_type"),
            F.round(bal / 2500, 4).alias("sharpe_ratio"),
            F.round((ck * 29 % 100) / F.lit(100.0), 2).alias("strategy_confidence"),
            (F.to_timestamp(F.lit("2001-09-01")) + seconds(ck % 70 * 86400)).alias("calculated_at"),
        )

    def scores(self) -> DataFrame:
        return latest_per_key(self.score_history(), ["proxy_address"], ["version"])

    def profiles(self) -> DataFrame:
        """Per-trader profile built from the trades themselves."""
        t = self.trades()
        return t.groupBy("proxy_address").agg(
            F.max("username").alias("username"),
            F.count(F.lit(1)).alias("total_trades"),
            F.sum("notional").alias("total_volume_usd"),
            F.count_distinct("market_slug").alias("unique_markets"),
            F.min("ts").alias("first_trade_at"),
            F.max("ts").alias("last_trade_at"),
            (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days_active"),
        )

    def trader_pnl(self) -> DataFrame:
        ck = F.col("c_custkey")
        raw = self.customers().filter(ck % 9 != 0).select(
            "proxy_address", ck.alias("version"),
            F.round(F.col("c_acctbal") * 3 - 9000, 2).alias("total_realized_pnl"),
            (ck % 40 + 1).alias("closed_positions"),
            F.round((ck * 17 % 101) / F.lit(100.0), 2).alias("win_rate"),
        )
        return latest_per_key(raw, ["proxy_address"], ["version"])

    def ml_scores(self) -> DataFrame:
        ck = F.col("c_custkey")
        raw = self.customers().filter(ck % 4 != 0).select(
            "proxy_address", ck.alias("version"),
            (F.lit(20) + ck * 31 % 80).cast("double").alias("ml_score"),
            F.when(ck * 31 % 80 >= 60, "DIAMOND").when(ck * 31 % 80 >= 40, "GOLD").when(ck * 31 % 80 >= 20, "SILVER")
            .otherwise("BRONZE").alias("ml_tier"),
            F.round(F.col("c_acctbal") / 4000, 4).alias("predicted_sharpe"),
            F.concat(F.lit("v"), (ck % 3 + 1).cast("string")).alias("model_version"),
            (ck % 8).cast("int").alias("cluster_id"),
            F.round((ck * 7 % 100) / F.lit(100.0), 2).alias("anomaly_score"),
        )
        return latest_per_key(raw, ["proxy_address"], ["version"])

    # ---- orders ------------------------------------------------------------------------------

    def _order_lines(self) -> DataFrame:
        base = F.to_timestamp(F.lit("2000-01-01")) + seconds(F.col("l_orderkey") % 1000 * 3600)
        return self.lines().select(
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("order_id"), base.alias("base"),
            F.concat_ws("-", "event_key", "l_suppkey", "l_partkey").alias("event_key"), "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag",
            "l_linestatus", "l_quantity", "price", F.col("slug").alias("market_slug"),
            F.concat(F.col("slug"), F.lit(":"), F.col("outcome")).alias("token_id"), F.upper("outcome").alias("direction"))

    def strategy_orders(self) -> DataFrame:
        n = F.col("l_linenumber")
        bid = F.round(F.col("price") - F.lit(0.01) * (F.col("l_partkey") % 3), 2)
        return self._order_lines().filter(n <= 3).select(
            "order_id", "event_key", "market_slug", "token_id", "direction",
            F.when(n == 1, "PLACE").when((n == 3) & (F.col("l_returnflag") == "R"), "CANCEL").otherwise("REPLACE").alias("action"),
            (F.col("base") + seconds((n * 700 + F.col("l_suppkey") % 100) / F.lit(1000.0))).alias("ts"), "price", F.col("l_quantity").alias("size"),
            F.lit(0.01).alias("tick_size"), bid.alias("best_bid_price"), F.round(bid + F.lit(0.05), 2).alias("best_ask_price"),
            (F.col("l_suppkey") % 9 != 0).alias("success"))

    def order_status(self) -> DataFrame:
        n = F.col("l_linenumber")
        return self._order_lines().filter(n >= 2).select(
            "order_id", "event_key", (F.col("base") + seconds((n * 900 + F.col("l_partkey") % 300) / F.lit(1000.0))).alias("ts"),
            F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.col("price").alias("requested_price"),
            F.lit(60.0).alias("requested_size"), F.when(F.col("l_returnflag") != "R", (n - 1) * 10.0).alias("matched_size"),
            F.col("l_linestatus").alias("exchange_status"))

    # ---- event stream ------------------------------------------------------------------------

    def quotes(self) -> DataFrame:
        e = self.read("events").filter(F.col("event_type").isin("view", "click"))
        bid = F.round(F.lit(0.05) + (F.col("event_id") % 80) / F.lit(100.0), 2)
        return e.select(
            (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("asset_id"),
            "ts", bid.alias("bid"), F.round(bid + F.lit(0.02), 2).alias("ask"),
            F.col("value").alias("bid_size"), F.col("event_id"),
        )

    def prints(self) -> DataFrame:
        e = self.read("events").filter(F.col("event_type") == "purchase")
        return e.select(
            (F.get_json_object("props", "$.k").cast("int") % 10).cast("string").alias("asset_id"),
            "ts", F.col("value").alias("size"), F.col("event_id"),
        )

    # ---- enriched chain ----------------------------------------------------------------------

    def enriched(self) -> DataFrame:
        return enrich.trade_enrich(self.trades(), self.tob(), self.markets())

    def research(self) -> DataFrame:
        return enrich.research_columns(self.enriched())

    def enriched_ws(self) -> DataFrame:
        return enrich.with_ws_book(self.enriched(), self.ws_tob())

    def enriched_opposite(self) -> DataFrame:
        return enrich.with_both_books(self.enriched(), self.ws_tob())

    def strong_traders(self) -> DataFrame:
        return self.scores().filter("total_score >= 60").select("username")
