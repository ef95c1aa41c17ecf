"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected equally often, at the rate target / size. The rate is summed
up along the documents, one random offset is added, and a document is emitted once for each integer
that its part of the sum crosses. Documents are ordered by size, so that the emitted sizes keep near the target.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import NON_BLANK_RUN
from tradelens.session import checkpointed

WEIGHTS = (5, 2, 1)
#: Bound on how often a source may repeat, and the seed of the offset.
MOST, SEED = 3, 17


def offset(seed: int = SEED) -> float:
    return round(random.Random(seed).random(), 6)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_BLANK_RUN)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: sources in order of code point (null last) weigh ``weights`` in turn and share all sizes.

    ``sized`` has source, size and n (rows that are alike). A target stops at ``most`` times its source's size and the
    excess goes to the others by weight. With sources sorted by bound / weight, the level that fills them is the largest
    of (total - bounds before) / (weights from here on). The table has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    pull = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / pull.cast("double"))
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", per_segment: int = 4096) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0, a null source is a source of its own, and a source without words has target 0. Rows that
    repeat count one by one. Copies depend on seed, ids and sizes alone, so a rerun agrees. No document is taken more
    than ``most`` times. An empty table gives no rows.

    Row numbers within a source come from segments (size band, hash of the id): rows are numbered inside a
    segment, and counts of the segments before are added, so no task holds a whole source.
    """
    sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sized = checkpointed(sized.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    rows = sized.agg(F.sum("n")).first()[0] or 0
    segments = max(1, -(-rows // per_segment))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    sized = sized.withColumns({"band": F.length(F.bin("size")), "segment": F.pmod(hashed, F.lit(segments))})
    keys = ["source", "band", "segment"]
    counts = sized.groupBy(*keys).agg(F.sum("n").alias("rows"))
    bands = counts.groupBy("source", "band").agg(F.sum("rows").alias("rows"))
    lower = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("source", "band", F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("band_offset"))
    earlier = Window.partitionBy("source", "band").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("segment_offset"))
    targets = source_targets(sized, weights, most)
    same = lambda left, right, names: [left[k].eqNullSafe(right[k]) for k in names]
    starts = counts.join(bands, same(counts, bands, ["source", "band"])).select(*[counts[k] for k in keys], (F.col("segment_offset") + F.col("band_offset")).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("n").over(inside))
    placed = placed.join(starts, same(placed, starts, keys)).select(placed["*"], starts["start"])
    placed = placed.join(targets, same(placed, targets, ["source"])).select(placed["*"], targets["source_size"], targets["target"])
    first = F.col("start") + F.col("upto") - F.col("n")
    placed = placed.select("*", F.explode(F.sequence(first + 1, first + F.col("n"))).alias("rank"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    crossed = lambda upto: F.floor(upto.cast("double") * rate + F.lit(offset(seed)))
    copies = F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.lit(most)).cast("bigint")
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it; those taken 0 times are left out.

    Rows are matched by id, source and size. Where several rows agree in these, their copies are dealt out among them in order of text hash.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_key"))  # the row is packed, so its names clash with none
    taken = mix(docs, doc_id=doc_id, text=text, source=source, **how).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = checkpointed(taken.filter("copies > 0"))
    met = rows.alias("d").join(taken.alias("t"), F.expr("d.doc_id <=> t.doc_id AND d.source <=> t.source AND d.size = t.size")).select("d.*", "t.copies", "t.rows")
    out = met.filter("rows = 1").select("row", F.col("copies").alias("share"))
    if not taken.filter("rows > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("text_key"))
        share = F.floor(F.col("copies") / F.col("rows")) + F.when(turn <= F.col("copies") % F.col("rows"), 1).otherwise(0)
        out = out.unionByName(met.filter("rows > 1").withColumn("share", share).filter("share > 0").select("row", "share"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("share")))).select("row.*")
