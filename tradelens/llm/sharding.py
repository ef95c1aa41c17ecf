"""Shards by jump consistent hashing: a key and the number of shards decide, no ring table is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its generator and the span of its 31-bit draw.
MULTIPLIER, SPAN = "2862933555777941757", float(1 << 31)
TWO_33, TWO_64 = str(2 ** 33), str(2 ** 64)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard from 0 to shards - 1 of a 64-bit key. The walk jumps forward at each step, so it takes at most ``shards`` steps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wide = lambda v: F.lit(v).cast("decimal(20,0)")
    unsigned = F.when(key < 0, key.cast("decimal(20,0)") + wide(TWO_64)).otherwise(key.cast("decimal(20,0)")).cast("decimal(20,0)")

    def step(state: Column, _: Column) -> Column:
        state_key = ((state["key"] * F.lit(MULTIPLIER).cast("decimal(18,0)" if len(MULTIPLIER) < 19 else "decimal(19,0)") + F.lit(1)) % wide(TWO_64)).cast("decimal(20,0)")
        draw = F.floor(state_key / wide(TWO_33)).cast("bigint")
        ahead = F.floor((state["next"] + 1) * (F.lit(SPAN) / (draw + 1))).cast("bigint")
        live = state["next"] < shards
        return F.struct(F.when(live, state_key).otherwise(state["key"]).alias("key"), F.when(live, state["next"]).otherwise(state["at"]).alias("at"),
                        F.when(live, ahead).otherwise(state["next"]).alias("next"))

    start = F.struct(unsigned.alias("key"), F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def key_hash(doc_id: Column) -> Column:
    """Keys that count up are mixed first. A null id has a hash of its own."""
    return F.xxhash64(doc_id.cast("bigint"))


def with_shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", name: str = "shard") -> DataFrame:
    """The documents with their shard in column ``name``; one pass, no shuffle. Equal ids share a shard, whatever their text; null ids share one too.

    A column of the documents that is called ``name`` is replaced by the shard. Rows that repeat stay as they are, an empty table stays empty.
    """
    return docs.withColumn(name, jump_shard(key_hash(F.col(doc_id)), shards))


def shard_slots(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", per_segment: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 length plus 1; a null text counts as empty, with checksum 0. The slot counts
    from 0 without a gap inside a shard. It orders by hashed segment, id, checksum and size; segments are
    counted first, so no task holds a whole shard. Rows equal in all of these take neighbouring slots.
    An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    segments = max(1, -(-docs.count() // per_segment))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({
        "shard": jump_shard(key_hash(F.col("doc_id")), shards), "grown_shard": jump_shard(key_hash(F.col("doc_id")), shards + 1),
        "segment": F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(segments)),
    })
    totals = rows.groupBy("shard", "segment").agg(F.sum("n").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "segment", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "segment").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("last", F.sum("n").over(inside)).join(offsets, ["shard", "segment"])
    first = F.col("offset") + F.col("last") - F.col("n")
    placed = placed.select("*", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
