"""Streaming jobs run to completion over the given tables and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.catalog.q_ingest import messages, trade_payload, wrap
from tradelens.catalog.q_reports import rounded
from tradelens.catalog.registry import query
from tradelens.catalog.tables import Tables
from tradelens.operators.latest import latest_per_key
from tradelens.session import work_folder
from tradelens.sources.envelopes import envelope_normalize
from tradelens.streaming import jobs, state


class StreamTables(Tables):
    """The same projections over streaming reads of the given files."""

    def read(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        df = self.spark.readStream.schema(schema).parquet(f"{self.dir}/{name}*.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(casts) if casts else df


def live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.dir)


def drained(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over all available data into Parquet and return the table."""
    root = work_folder(t.spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


def drained_batches(t: Tables, stream: DataFrame, name: str, batch_fn, mode: str = "append") -> str:
    root = work_folder(t.spark, name)
    stream.writeStream.outputMode(mode).foreachBatch(batch_fn(f"{root}/out")).option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True).start().awaitTermination()
    return f"{root}/out"


def drained_in_slices(t: Tables, rows: DataFrame, ts: str, keys: list[str], build, name: str, slices: int = 3) -> DataFrame:
    """Run a stream over ``rows`` in slices of time, each after a restart from the checkpoint, so that state is carried over. Within a slice a key is in one file."""
    root = work_folder(t.spark, name)
    first, last = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    stream = build(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in/*"))
    place = F.floor((F.unix_micros(ts) - F.lit(first)) * slices / F.lit(last - first + 1))
    for k in range(slices):
        rows.filter(place == k).repartition(*keys).write.parquet(f"{root}/in/{k}")
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("kafka_event_source", """SELECT 'k' || event_id AS kafka_key, CASE WHEN event_id % 3 < 2 THEN make_timestamp(CAST(floor(epoch_us(ts)/1000000) AS BIGINT)*1000000) ELSE ts END AS ts,
  CASE WHEN event_id % 5 <> 0 THEN 'feed-' || (event_id % 4) ELSE 'unknown' END AS source, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE 'unknown' END AS type, event_id AS kafka_offset FROM events""")
def kafka_event_source(t: Tables):
    return drained(t, envelope_normalize(messages(live(t))), "events").select("kafka_key", "ts", "source", "type", "kafka_offset")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(t: Tables):
    e = live(t).read("events").select("event_id", "user_id", "event_type", "ts")
    return drained(t, jobs.stream_dedup(e.unionByName(e), key="event_id"), "dedup").select("event_id", "user_id", "event_type")


@query("stream_minute_bars", """SELECT CAST(user_id AS VARCHAR) AS token_id, date_trunc('minute', ts) AS minute, count(*) AS trade_count, r4(sum(value)) AS volume, r4(sum(value*(event_id % 100)/100.0::DOUBLE)) AS notional FROM events
GROUP BY 1, 2 HAVING date_trunc('minute', max(ts)) + INTERVAL 1 MINUTE <= (SELECT make_timestamp(CAST(floor(epoch_us(max(ts))/1000) AS BIGINT)*1000) - INTERVAL 10 MINUTE FROM events)""")
def stream_minute_bars(t: Tables):
    e = live(t).read("events").select(F.col("user_id").cast("string").alias("token_id"), "ts", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                                      ((F.col("event_id") % 100) / F.lit(100.0)).alias("price"), F.col("value").alias("size"))
    return rounded(drained(t, jobs.stream_minute_bars(e), "bars").select("token_id", "minute", "trade_count", "volume", "notional"), 4)


@query("stream_latest_book", """SELECT asset_id, ts, bid, ask FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_quotes) WHERE rn = 1""")
def stream_latest_book(t: Tables):
    q = t.quotes().withColumnRenamed("event_id", "seq").select("asset_id", "ts", "seq", "bid", "ask")
    changes = drained_in_slices(t, q, "ts", ["asset_id"], state.latest_book, "book")
    return latest_per_key(changes, ["asset_id"], ["ts", "seq"]).select("asset_id", "ts", "bid", "ask")


def _text(c: str):
    return F.col(c).cast("string")


#: Table, event type, the column that is summed up, and its SQL: one feed for each typed table.
FEEDS = [
    ("user_trades", "venue.user.trade", "size", "l_quantity"), ("market_trades", "venue.market.trade", "price", "price"), ("clob_tob", "venue.clob.tob", "best_bid_size", "l_quantity"),
    ("gamma_markets", "venue.gamma.market", "volume_num", "l_extendedprice"), ("tx_receipts", "chain.tx.receipt", "gas_used", "l_quantity"), ("ws_tob", "market_ws.tob", "best_bid_size", "l_quantity"),
    ("ws_trades", "market_ws.trade", "size", "l_quantity"), ("strategy_orders", "strategy.maker.order", "size", "l_quantity"), ("limit_orders", "executor.order.limit", "price", "price"),
    ("market_orders", "executor.order.market", "amount", "l_quantity"), ("cancel_orders", "executor.order.cancel", "success", "CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END"),
    ("order_status", "executor.order.status", "matched_size", "l_quantity"), ("global_trades", "venue.global.trade", "notional", "price*l_quantity"),
]


def payloads():
    """The payload of each feed, in the order of FEEDS."""
    size, trade, price = F.col("l_quantity"), trade_payload(), F.col("price")
    slug, order = F.col("slug"), _text("l_orderkey")
    return [
        F.struct(F.lit("u").alias("username"), trade.alias("trade")), F.struct(slug.alias("marketSlug"), trade.alias("trade")),
        F.struct(F.struct(order.alias("tradeKey")).alias("trigger"), F.struct(F.struct(_text("price").alias("price"), _text("l_quantity").alias("size")).alias("bestBid")).alias("book")),
        F.struct("slug", F.struct(_text("l_partkey").alias("id"), F.col("l_extendedprice").alias("volumeNum")).alias("market")),
        F.struct(F.concat(F.lit("0x"), order).alias("txHash"), size.cast("bigint").alias("gasUsed")), F.struct(slug.alias("assetId"), price.alias("bestBid"), size.alias("bestBidSize")),
        F.struct(slug.alias("assetId"), price, size.alias("size")), F.struct(F.lit("maker").alias("strategy"), F.lit("PLACE").alias("action"), size.alias("size")),
        F.struct(slug.alias("tokenId"), size.alias("size"), price), F.struct(slug.alias("tokenId"), size.alias("amount")),
        F.struct(order.alias("orderId"), (F.col("l_suppkey") % 2 == 0).alias("success")), F.struct(order.alias("orderId"), size.alias("matchedSize")), F.struct(order.alias("id"), price, size.alias("size")),
    ]


def _fanned() -> str:
    cells = [(name, value) for name, _, _, value in FEEDS]
    cases = " ".join(f"WHEN {k} THEN CAST({value} AS DOUBLE)" for k, (_, value) in enumerate(cells))
    names = ", ".join(f"'{n}'" for n, _ in cells)
    return f"""SELECT table_name, month, count(*) AS rows, r2(sum(value)) AS value, min(event_key) AS first_key, max(event_key) AS last_key FROM
  (SELECT [{names}][CAST((l_orderkey + l_linenumber) % {len(cells)} AS INTEGER) + 1] AS table_name, strftime(ts, '%Y-%m') AS month, event_key, CASE (l_orderkey + l_linenumber) % {len(cells)} {cases} END AS value FROM v_lines) GROUP BY ALL"""


@query("event_fanout", _fanned())
def event_fanout(t: Tables):
    """One raw stream with the events of all thirteen tables; each line of the table is an event of one of them."""
    rows = live(t).lines()
    route = (F.col("l_orderkey") + F.col("l_linenumber")) % len(FEEDS)
    kind, data = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, ((_, event_type, _, _), payload) in enumerate(zip(FEEDS, payloads(), strict=True)):
        kind, data = F.when(route == k, event_type).otherwise(kind), F.when(route == k, F.to_json(payload)).otherwise(data)
    events = rows.select("ts", F.lit("feed").alias("source"), kind.alias("type"), data.alias("data"), F.col("event_key").alias("kafka_key"), F.lit(0).alias("kafka_partition"),
                         F.col("l_orderkey").alias("kafka_offset"), F.col("ts").alias("kafka_timestamp"))
    path = drained_batches(t, events, "fanout", lambda root: jobs.fan_out([f[0] for f in FEEDS], root, grain="month"))
    out = None
    for name, _, column, _ in FEEDS:
        table = t.spark.read.parquet(f"{path}/{name}").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.col(column).cast("double")).alias("value"), F.min("event_key").alias("first_key"), F.max("event_key").alias("last_key"))
        table = table.select(F.lit(name).alias("table_name"), "*")
        out = table if out is None else out.unionByName(table)
    return rounded(out, 2)


@query("late_version_reconcile", """SELECT event_key, version, price, size FROM (SELECT event_key, l_suppkey AS version, price, l_quantity AS size, row_number() OVER (PARTITION BY event_key ORDER BY l_suppkey DESC, price DESC, l_quantity DESC) AS rn FROM v_lines) WHERE rn = 1""")
def late_version_reconcile(t: Tables):
    rows = live(t).lines().select("event_key", F.col("l_suppkey").alias("version"), "price", F.col("l_quantity").alias("size"))
    path = drained_batches(t, rows, "versions", jobs.reconcile_late)
    return jobs.latest(t.spark.read.parquet(path), ["event_key"], "version").select("event_key", "version", "price", "size")


@query("mirror_signals", """SELECT 'u' || user_id AS username, CAST(event_id AS VARCHAR) AS event_key, ts, event_type AS side, r4(value) AS size, r4(s.total_score/100.0) AS weight FROM events e JOIN v_scores s ON s.username = 'u' || e.user_id WHERE s.total_score >= 80""")
def mirror_signals(t: Tables):
    e = live(t).read("events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("username"), F.col("event_id").cast("string").alias("event_key"), "ts", F.lit("m").alias("market_slug"),
        F.lit("t").alias("token_id"), F.col("event_type").alias("side"), F.lit(0.5).alias("price"), F.col("value").alias("size"))
    members = t.scores().filter("total_score >= 80").select("username", (F.col("total_score") / F.lit(100.0)).alias("weight"), F.lit(1e5).alias("estimated_capital_usd"))
    out = drained(t, state.mirror_signals(e, members), "mirror")
    return rounded(out.select(F.lower("username").alias("username"), "event_key", "ts", "side", "size", "weight"), 4)


_DRAINED = "(SELECT make_timestamp(CAST(floor(epoch_us(max(ts))/1000) AS BIGINT)*1000) - INTERVAL 10 MINUTE FROM events)"


@query("stream_capped_signals", """WITH RECURSIVE s AS (SELECT event_type AS fund_type, CAST(event_id AS VARCHAR) AS signal_id, ts, value, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn FROM events),
f AS (SELECT fund_type, day, 0::BIGINT AS rn, NULL::VARCHAR AS signal_id, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS value, 0 AS nth, 0.0::DOUBLE AS used, FALSE AS taken FROM (SELECT DISTINCT fund_type, day FROM s)
  UNION ALL SELECT s.fund_type, s.day, s.rn, s.signal_id, s.ts, s.value, f.nth + (f.nth < 5 AND f.used + s.value <= 300 + 1e-9)::INTEGER, f.used + CASE WHEN f.nth < 5 AND f.used + s.value <= 300 + 1e-9 THEN s.value ELSE 0 END,
    f.nth < 5 AND f.used + s.value <= 300 + 1e-9 FROM f JOIN s ON s.fund_type = f.fund_type AND s.day = f.day AND s.rn = f.rn + 1)
SELECT fund_type, signal_id, ts AS detected_at, r6(value) AS notional, nth, r6(used) AS day_notional FROM f WHERE taken""")
def stream_capped_signals(t: Tables):
    e = t.read("events").select(
        F.col("event_type").alias("fund_type"), F.col("event_id").cast("string").alias("signal_id"), F.col("ts").alias("detected_at"), F.col("value").alias("notional"),
        F.lit(0.9).alias("confidence"), F.lit(0.5).alias("strength"), F.lit("BUY").alias("action"))
    return rounded(drained_in_slices(t, e, "detected_at", ["fund_type"], lambda s: state.capped_signals(s, 5, 300.0), "caps"))


@query("signal_cooldown", f"""WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS k, CAST(event_id AS VARCHAR) AS signal_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn,
  greatest(max(ts) OVER (PARTITION BY user_id), {_DRAINED}) AS now FROM events),
f AS (SELECT k, 0::BIGINT AS rn, NULL::VARCHAR AS signal_id, NULL::TIMESTAMP AS ts, TIMESTAMP '1970-01-01' AS free_at, FALSE AS sent FROM (SELECT DISTINCT k FROM s)
  UNION ALL SELECT k, rn, signal_id, ts, CASE WHEN sent THEN due + INTERVAL 3600 SECOND ELSE free_at END, sent
  FROM (SELECT *, due <= now AND epoch_us(due) - epoch_us(ts) <= 300000000 AS sent FROM (SELECT s.*, f.free_at, greatest(s.ts, f.free_at) AS due FROM f JOIN s ON s.k = f.k AND s.rn = f.rn + 1)))
SELECT k AS cooldown_key, signal_id, ts AS detected_at, free_at - INTERVAL 3600 SECOND AS released_at FROM f WHERE sent""")
def signal_cooldown(t: Tables):
    e = t.read("events").select(F.col("user_id").cast("string").alias("market_slug"), F.col("event_id").cast("string").alias("signal_id"), F.col("ts").alias("detected_at"))
    return drained_in_slices(t, e, "detected_at", ["market_slug"], lambda s: state.cooldown(s, 3600), "cooldown")


@query("delayed_signals", f"""SELECT event_type AS fund_type, CAST(event_id AS VARCHAR) AS signal_id, ts AS detected_at, props AS payload FROM events WHERE ts + INTERVAL 300 SECOND <= {_DRAINED}""")
def delayed_signals(t: Tables):
    e = live(t).read("events").select(F.col("event_type").alias("fund_type"), F.col("event_id").cast("string").alias("signal_id"), F.col("ts").alias("detected_at"), F.col("props").alias("payload"))
    return drained(t, state.delayed_signals(e, 300), "delayed")


@query("stream_position_state", """WITH RECURSIVE s AS (SELECT 'u' || user_id AS k, CAST(event_id AS VARCHAR) AS event_key, event_type = 'view' AS sell, (event_id % 90 + 5)/100.0::DOUBLE AS price, value + 1 AS size,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn FROM events),
f AS (SELECT k, 0::BIGINT AS rn, NULL::VARCHAR AS event_key, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS pnl FROM (SELECT DISTINCT k FROM s)
  UNION ALL SELECT s.k, s.rn, s.event_key, CASE WHEN sell THEN round(shares - least(shares, size), 9) ELSE shares + size END,
    CASE WHEN NOT sell THEN (shares*cost + size*price)/(shares + size) WHEN round(shares - least(shares, size), 9) > 0 THEN cost ELSE 0 END,
    pnl + CASE WHEN sell THEN least(shares, size)*(price - cost) ELSE 0 END FROM f JOIN s ON s.k = f.k AND s.rn = f.rn + 1)
SELECT k AS fund_type, event_key, r4(shares) AS shares, r4(cost) AS avg_cost, r4(pnl) AS realized_pnl FROM f WHERE rn > 0""")
def stream_position_state(t: Tables):
    e = t.read("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fund_type"), F.lit("t").alias("token_id"), F.col("event_id").cast("string").alias("event_key"), "ts",
        F.when(F.col("event_type") == "view", "SELL").otherwise("BUY").alias("side"), ((F.col("event_id") % 90 + 5) / F.lit(100.0)).alias("price"), (F.col("value") + 1).alias("size"))
    out = drained_in_slices(t, e, "ts", ["fund_type"], lambda s: state.position_state(s, keep_seconds=400 * state.DAY), "positions")
    return rounded(out.drop("token_id"), 4)


@query("stream_edge_drops", """SELECT proxy_address, calculated_at, total_score, peak AS recent_peak FROM (SELECT *, max(total_score) OVER (PARTITION BY proxy_address ORDER BY calculated_at, version ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS peak
  FROM v_score_history) WHERE peak - total_score > 15""")
def stream_edge_drops(t: Tables):
    h = t.score_history().select("proxy_address", "calculated_at", "version", "total_score")
    return drained_in_slices(t, h, "calculated_at", ["proxy_address"], lambda s: state.edge_drops(s, keep_seconds=400 * state.DAY), "edge-drops")


@query("stream_alert_dedup", """SELECT DISTINCT left(md5('insider:' || CASE WHEN version % 2 = 0 THEN 'VOLUME_SPIKE' ELSE 'WHALE_ANOMALY' END || ':' || market_slug || ':' || CASE WHEN outcome = 'Up' THEN 'YES' ELSE 'NO' END || ':'
  || CAST(CAST(floor(notional/1000)*1000 AS BIGINT) AS VARCHAR)), 16) AS dedup_key FROM v_trades_raw WHERE version % 10 = 0 OR version % 5 IN (1, 2)""")
def stream_alert_dedup(t: Tables):
    """All alerts come in one batch, so each key passes once, whatever the version of a trade."""
    n = F.col("version")
    alerts = live(t).lines().select("*", F.col("l_suppkey").alias("version"), F.col("slug").alias("market_slug"), (F.col("price") * F.col("l_quantity")).alias("total_volume_usd")).select(
        F.col("event_key").alias("alert_id"), "market_slug", F.when(n % 2 == 0, "VOLUME_SPIKE").otherwise("WHALE_ANOMALY").alias("signal_type"),
        F.when(n % 10 == 0, "CRITICAL").when(n % 5 == 1, "HIGH").when(n % 5 == 2, "MEDIUM").otherwise("LOW").alias("severity"), F.when(F.col("outcome") == "Up", "YES").otherwise("NO").alias("direction"),
        "total_volume_usd", F.col("ts").alias("detected_at"))
    return drained(t, jobs.stream_alert_dedup(alerts), "alerts").select("dedup_key")


# ---- batch sinks -----------------------------------------------------------------------------


@query("parquet_table_sink", "SELECT CAST(strftime(ts, '%Y-%m') AS VARCHAR) AS month, count(*) AS rows, r2(sum(notional)) AS notional FROM v_trades GROUP BY 1")
def parquet_table_sink(t: Tables):
    from tradelens.sources.sinks import write_table
    path = work_folder(t.spark, "trades")
    write_table(t.trades(), path, grain="month", cluster_by=["market_slug"])
    back = t.spark.read.option("inferSchema", "false").parquet(path)
    return rounded(back.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.sum("notional").alias("notional")), 2)


@query("versioned_upsert_sink", "SELECT proxy_address, total_score, tier, (SELECT count(*) FROM v_score_history) AS history_rows FROM v_scores")
def versioned_upsert_sink(t: Tables):
    from tradelens.sources import sinks
    root = work_folder(t.spark, "scores")
    h = t.score_history()
    for part in (h.filter("version % 2 = 0"), h.filter("version % 2 = 1")):
        sinks.append_versions(part, f"{root}/current", f"{root}/history")
    sinks.compact(t.spark, f"{root}/current", f"{root}/compacted", ["proxy_address"], ["version"])
    n = t.spark.read.parquet(f"{root}/history").agg(F.count(F.lit(1)).alias("history_rows"))
    return t.spark.read.parquet(f"{root}/compacted").select("proxy_address", "total_score", "tier", n.scalar().alias("history_rows"))


@query("bucket_merge_sink", "SELECT proxy_address, version, total_score, tier FROM (SELECT *, row_number() OVER (PARTITION BY proxy_address ORDER BY version DESC) AS rn FROM v_score_history) WHERE rn = 1")
def bucket_merge_sink(t: Tables):
    """Three merges of versions that come out of order into a table in hash buckets."""
    from tradelens.sources import sinks
    path = f"{work_folder(t.spark, 'buckets')}/scores"
    h = t.score_history().select("proxy_address", "version", "total_score", "tier")
    for k in (1, 0, 2):
        sinks.merge_versions(t.spark, h.filter(F.col("version") % 3 == k), path, ["proxy_address"], ["version"], buckets=16)
    return t.spark.read.parquet(path).select("proxy_address", "version", "total_score", "tier")


@query("snapshot_export")
def snapshot_export(t: Tables):
    from tradelens.sources import sinks
    busiest = t.trades().groupBy("username").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("username", F.struct("n", "username")).alias("u"))
    user = busiest.first()["u"]
    sets = sinks.snapshot_sets(t.trades(), t.market_trades(), t.ws_tob(), user)
    return sinks.snapshot_export(sets, work_folder(t.spark, "snapshot"), {"username": user}).select("dataset", "rows", "first_ts", "last_ts", "username")
