"""Benchmark decontamination as a prefix-filtered set join.

Windows of item words are sets of five-word shingles. Documents first pass a bit filter of all item shingles; the shingles
that remain are counted over all documents, which orders them by rarity. A whole window must be found, so its rarest shingle
alone is the necessary prefix: only that one is joined. Length and positional bounds follow, then the window's words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.bloom import bit_rows, gathered, holds, probes
from tradelens.llm.common import small_batches, utf8, values, words_of
from tradelens.session import checkpointed

SHINGLE, WINDOW = 5, 10
#: Size of the filter (2**BITS bits, 2 MB), its probes, and words hashed at a time.
BITS, PROBES, BLOCK = 24, 2, 1 << 16
#: An odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]).cumprod(dtype=np.uint64)


def gram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Rolling hash of each run of n words: differences of prefix sums over the joined bytes, scaled back to position 0."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = (lengths + 1).cumsum() - 1
    starts = (ends - lengths)[:len(words) - n + 1]
    sums = np.concatenate([np.zeros(1, np.uint64), (data * _powers(BASE, len(data))).cumsum(dtype=np.uint64)])
    return (sums[ends[n - 1:]] - sums[starts]) * _powers(INVERSE, len(data) + 1)[starts]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, window, length, grams: each window of each item with its shingles in order and their filter slots."""
    for batch in batches:
        items, windows, lengths, grams, slots = [], [], [], [], []
        for item, text in zip(values(batch, "item_id"), utf8(batch, "text"), strict=True):
            words = words_of(text)
            length = min(WINDOW, len(words))
            size = min(SHINGLE, length)
            for start in range(len(words) - length + 1 if words else 0):
                run = words[start:start + length]
                items.append(item), windows.append(b" ".join(run)), lengths.append(length)
                grams.append([b" ".join(run[i:i + size]) for i in range(length - size + 1)])
                slots.append(np.concatenate(probes(gram_hashes(run, size), BITS, PROBES)).astype(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([
            pa.array(items, pa.string()), pa.array(windows, pa.binary()), pa.array(lengths, pa.int32()), pa.array(grams, pa.list_(pa.binary())),
            pa.array(slots, pa.list_(pa.int64()))], ["item_id", "window", "length", "grams", "slots"])


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_hit, item_ids.

    n_hit counts the words inside any window of ten item words; an item of fewer words is one window. item_ids lists, as sorted
    strings, the items with a window in the document. Null texts have no words, items without words no window, items with a
    null id hit but are not listed. Rows that repeat give the same result each; copies of an id with different texts are told apart
    by text_key. An empty table of either kind gives no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = checkpointed(items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
        _item_windows, "item_id string, window binary, length int, grams array<binary>, slots array<bigint>"))
    filter_ = spark.sparkContext.broadcast(gathered(bit_rows(windows.select(F.explode("slots").alias("slot")), F.col("slot")), BITS))
    sizes = sorted({min(SHINGLE, r["length"]) for r in windows.select("length").distinct().collect()})  # at most ten lengths

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n_words", "at", "gram"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out = [[] for _ in names]
            for doc, key, t in zip(values(batch, "doc_id"), values(batch, "text_key"), utf8(batch, "text"), strict=True):
                words = words_of(t)
                found = [(-1, None)]  # the document itself
                for size in sizes:
                    for block in range(0, len(words) - size + 1, BLOCK):
                        some = words[block:block + BLOCK + size - 1]
                        found += [(block + int(i), b" ".join(some[i:i + size])) for i in np.flatnonzero(holds(filter_.value, gram_hashes(some, size), BITS, PROBES))]
                for column, value in zip(out, ([doc] * len(found), [key] * len(found), [len(words)] * len(found), *zip(*found, strict=True)), strict=True):
                    column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))
    seen = checkpointed(rows.mapInArrow(shingles, "doc_id bigint, text_key bigint, n_words bigint, at bigint, gram binary"))
    key = ["doc_id", "text_key"]
    places = seen.filter("at >= 0").select(*key, "n_words", "at", "gram").distinct()

    rarity = places.groupBy("gram").agg(F.count(F.lit(1)).alias("found"))
    distinct = windows.select("window", "length", "grams").distinct()
    ranked = distinct.select("window", "length", "grams", F.posexplode("grams").alias("offset", "gram")).join(rarity, "gram")
    # windows with a shingle that no document has can't occur; of the others the rarest shingle is the prefix
    prefix = ranked.groupBy("window", "length", "grams").agg(F.count(F.lit(1)).alias("known"), F.min_by(F.struct("gram", "offset"), F.struct("found", "gram", "offset")).alias("p"))
    prefix = checkpointed(prefix.filter(F.col("known") == F.size("grams")).select(
        "window", "length", F.col("p.gram").alias("gram"), F.col("p.offset").alias("offset"), F.element_at("grams", 1).alias("head"),
        F.element_at("grams", -1).alias("tail"), (F.size("grams") - 1).alias("reach")))

    candidates = places.join(prefix, "gram").withColumn("start", F.col("at") - F.col("offset"))
    candidates = candidates.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words"))).select(*key, "start", "length", "window", "head", "tail", "reach")
    # first and last shingle together hold every word of a window of up to ten
    first, last = places.alias("first"), places.alias("last")
    verified = candidates.alias("c").join(first, F.expr(
        "c.doc_id <=> first.doc_id AND c.text_key = first.text_key AND c.start = first.at AND c.head = first.gram"), "left_semi")
    verified = verified.alias("c").join(last, F.expr(
        "c.doc_id <=> last.doc_id AND c.text_key = last.text_key AND c.start + c.reach = last.at AND c.tail = last.gram"), "left_semi")
    verified = checkpointed(verified.select(*key, "start", "length", "window"))

    hit = verified.select(*key, "start", "length").distinct().select(*key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("word"))
    hit = hit.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    listed = verified.select(*key, "window").distinct().join(windows.select("window", "item_id").distinct(), "window").select(*key, "item_id").distinct()
    listed = listed.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    found = hit.join(listed, (hit["doc_id"].eqNullSafe(listed["doc_id"])) & (hit["text_key"] == listed["text_key"]), "left").select(
        hit["doc_id"], hit["text_key"], "n_hit", "item_ids")
    base = seen.filter("at < 0").select(*key, "n_words")
    joined = base.join(found, base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_key"] == found["text_key"]), "left")
    return joined.select(base["doc_id"], base["text_key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without any benchmark window. Only the few hit keys are joined back."""
    hit = decontaminate(docs, items, doc_id, text).filter("n_hit > 0").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    return rows.alias("d").join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.text_key = h.text_key"), "left_anti").select("row.*")
