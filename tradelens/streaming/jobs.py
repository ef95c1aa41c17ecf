"""Streaming forms of the table jobs: fan-out, dedup, bars, latest book, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tradelens.operators.latest import latest_per_key
from tradelens.plans.follow import alert_key, severity_level
from tradelens.sources.projections import PROJECTIONS, is_type, project
from tradelens.sources.sinks import write_table

WATERMARK = "10 minutes"


def trade_key(*parts: str) -> Column:
    """Stable key of a trade from the fields that identify it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def stream_dedup(events: DataFrame, key: str = "event_key", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Drop keys already seen within the watermark; state holds keys, not rows, and expires."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def stream_minute_bars(prints: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Minute bars in append mode: a bar is written once the watermark has passed its end."""
    size, price = F.col("size"), F.col("price")
    flow = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, size)), F.lit(0.0))
    bars = prints.withWatermark("ts", watermark).groupBy("token_id", F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(size).alias("volume"), F.sum(size * price).alias("notional"),
        F.min(price).alias("low_price"), F.max(price).alias("high_price"), flow("BUY").alias("buy_volume"), flow("SELL").alias("sell_volume"))
    return bars.select("token_id", F.col("w.start").alias("minute"), "trade_count", "volume", "notional",
                       F.try_divide("notional", "volume").alias("vwap"), "low_price", "high_price", "buy_volume", "sell_volume")


def stream_alert_dedup(alerts: DataFrame, ttl: str = "1 hour", min_severity: int = 2) -> DataFrame:
    """Alerts severe enough, one per key within ``ttl`` of event time; keys leave the state after it."""
    keyed = alerts.filter(severity_level() >= min_severity).withColumn(
        "dedup_key", alert_key(F.col("signal_type"), F.col("market_slug"), F.col("direction"), F.col("total_volume_usd")))
    return keyed.withWatermark("detected_at", ttl).dropDuplicatesWithinWatermark(["dedup_key"])


def fan_out(tables: Sequence[str], root: str, grain: str = "day"):
    """Batch function that writes each typed table of one micro-batch.

    The batch is persisted once so the payloads are read from the source a single time. Batches may be
    replayed after a failure: tables are read through their latest-per-key view, which drops copies. One pass tells which event types
    a batch holds, so only their tables are projected.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            held = batch.agg(*[F.count_if(is_type(PROJECTIONS[name])).alias(name) for name in tables]).first()
            for name in tables:
                if held[name]:
                    write_table(project(batch, name).withColumn("batch_id", F.lit(batch_id)), f"{root}/{name}", grain=grain)
        finally:
            batch.unpersist()

    return write


def start_fan_out(events: DataFrame, tables: Sequence[str], root: str, checkpoint: str, **trigger) -> DataStreamWriter:
    writer = events.writeStream.foreachBatch(fan_out(tables, root)).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger) if trigger else writer


def reconcile_late(path: str):
    """Batch function that appends every version; the reader keeps the highest (see ``latest``)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return write


def latest(table: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return latest_per_key(table.drop("batch_id"), keys, [version])


def writer(df: DataFrame, checkpoint: str, mode: str = "append", options: Mapping[str, str] | None = None) -> DataStreamWriter:
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    for key, value in (options or {}).items():
        out = out.option(key, value)
    return out
