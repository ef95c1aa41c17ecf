"""Exact deduplication by skew-safe combining.

Each task first combines its own copies (the map side of the first aggregate), then salted groups
of a digest are merged, then the salt winners are merged globally. The full normalised text is a
grouping key at each of these stages, so equal digests of different texts never meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import BLANKS
from tradelens.session import checkpointed

#: A rank is code points * RADIX + (HALF - id), or + 0 for a null id: more code points win, then the smallest id.
HALF, RADIX = 2 ** 63, 2 ** 65


def normalised(text: Column) -> Column:
    """The text without any of the six ASCII blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _decimal(value: Column | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(38,0)")


def _combine(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 32,
                 digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical without blanks. Of equal texts the one with the most code points
    stays, then the smallest id; a null id comes after all others. Null and empty texts are equal.
    Of rows that repeat with the same id and length exactly one is kept. An empty table gives no rows,
    and other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.char_length("t").alias("points"), normalised(F.col("t")).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    rank = _decimal(F.col("points")) * F.lit(str(RADIX)).cast("decimal(20,0)") + F.coalesce(_decimal(HALF) - _decimal(F.col("doc_id")), _decimal(0))
    ranked = rows.withColumn("best", rank.cast("decimal(38,0)")).withColumn("n", F.lit(1).cast("bigint"))
    salted = _combine(ranked.withColumn("salt", F.spark_partition_id() % salts), ["digest", "salt", "content"])
    winners = _combine(salted, ["digest", "content"])
    groups = checkpointed(winners.select("digest", "best", F.col("n").alias("group_size")))

    # Equal digests of different texts: those few rows are matched by their text instead.
    clashes = groups.groupBy("digest").count().filter("count > 1").select("digest")
    members = rows.groupBy("digest", "doc_id", "points").agg(F.count(F.lit(1)).alias("n"))
    if clashes.isEmpty():
        placed = members.join(groups, "digest")
    else:
        clashing = rows.join(clashes, "digest", "left_semi").groupBy("digest", "content", "doc_id", "points").agg(F.count(F.lit(1)).alias("n"))
        apart = winners.join(clashes, "digest", "left_semi").withColumnRenamed("n", "group_size")
        placed = members.join(clashes, "digest", "left_anti").join(groups, "digest").unionByName(
            clashing.join(apart, ["digest", "content"]).drop("content"))
    rest = F.col("best") % F.lit(str(RADIX)).cast("decimal(20,0)")
    keep_id = F.when(rest > 0, (_decimal(HALF) - rest).cast("bigint"))
    points = ((F.col("best") - rest) / F.lit(str(RADIX)).cast("decimal(20,0)")).cast("bigint")
    placed = placed.withColumns({"keep_id": keep_id, "wins": F.col("doc_id").eqNullSafe(keep_id) & (F.col("points") == points)})
    copies = placed.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "digest")
