"""Line deduplication with a once-seen and a twice-seen bit filter.

Every task notes the lines of its documents in two filters: seen at least once, and seen in at least two documents. Merging two tasks
keeps the twice-seen bits and adds those that both have seen once. Lines outside the merged twice-seen filter occur in one document
and stay where they are; only the suspects are shuffled, and confirmed by their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.bloom import holds, probes
from tradelens.llm.common import small_batches, utf8, values
from tradelens.session import checkpointed

LEAST_POINTS, LEAST_DOCS, PROBES = 20, 3, 3
#: Bits of a chunk (its positions fit two bytes); bits for a document; bounds of the filter, 512 KB to 32 MB.
CHUNK, PER_DOC, SMALLEST, LARGEST = 16, 256, 22, 28


def filter_bits(docs: int) -> int:
    """Beyond the largest filter more lines become suspects; the result is the same."""
    return min(max((max(docs, 1) * PER_DOC - 1).bit_length(), SMALLEST), LARGEST)


def key_of(line: bytes) -> bytes | None:
    """The line without blanks at its ends and with A-Z lower-cased; None below the least number of code points."""
    key = line.strip().lower()
    if len(key) < LEAST_POINTS or len(key) < 4 * LEAST_POINTS and len(key.decode()) < LEAST_POINTS:
        return None
    return key


def keys_of(text: bytes | None) -> dict[bytes, list[int]]:
    """The keys of a text, each with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        key = key_of(line)
        if key is not None:
            found.setdefault(key, []).append(i)
    return found


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def twice_seen(rows: DataFrame, bits: int) -> np.ndarray:
    """The merged twice-seen filter. Chunks of the task filters are merged one after another in a stream, never gathered."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_hashes(keys_of(t).keys()) for batch in batches for t in utf8(batch, "text")]
        hashes, times = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        sets = []
        for some in (hashes, hashes[times > 1]):
            slots = np.unique(np.concatenate(probes(some, bits, PROBES)))
            chunk = (slots >> np.uint64(CHUNK)).astype(np.int64)
            numbers, starts = np.unique(chunk, return_index=True)
            parts = np.split((slots & np.uint64((1 << CHUNK) - 1)).astype(np.uint16), starts[1:]) if len(numbers) else []
            sets.append({int(n): p.tobytes() for n, p in zip(numbers, parts, strict=True)})
        for some in (list(sets[0])[i:i + 64] for i in range(0, len(sets[0]), 64)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sets[0][c] for c in some], pa.binary()),
                                              pa.array([sets[1].get(c, b"") for c in some], pa.binary())], ["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])
        for batch in batches:
            for chunk, a, b in zip(values(batch, "chunk"), values(batch, "once"), values(batch, "twice"), strict=True):
                if chunk != current:
                    if current is not None and twice.any():
                        yield done()
                    current, once, twice = chunk, np.zeros(1 << CHUNK, dtype=bool), np.zeros(1 << CHUNK, dtype=bool)
                a = np.frombuffer(a, dtype=np.uint16)
                twice[np.frombuffer(b, dtype=np.uint16)] = True
                twice[a[once[a]]] = True
                once[a] = True
        if current is not None and twice.any():
            yield done()

    notes = rows.select("text").mapInArrow(note, "chunk int, once binary, twice binary")
    merged = notes.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in merged.collect():  # at most 2**bits bits in all
        out[r["chunk"] << CHUNK - 3:(r["chunk"] + 1) << CHUNK - 3] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Lines end at a line feed; a null or empty text is one empty line. A key found in at least three documents loses all its lines, except
    in the document with the largest id that holds it. A null id is one document, before all others. Rows that repeat an
    id count as one document and lose the same keys. If all lines go, the text is empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bits = bits or filter_bits(docs.count())
    filter_ = spark.sparkContext.broadcast(twice_seen(rows, bits))  # at most 32 MB

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "text_key", "key", "lines"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        for batch in batches:
            out = [[] for _ in names]
            for doc, mark, t in zip(values(batch, "doc_id"), values(batch, "text_key"), utf8(batch, "text"), strict=True):
                found = keys_of(t)
                some = [k for k, maybe in zip(found, holds(filter_.value, _hashes(found.keys()), bits, PROBES), strict=True) if maybe]
                for column, value in zip(out, ([doc] * len(some), [mark] * len(some), some, [found[k] for k in some]), strict=True):
                    column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    marked = rows.withColumn("text_key", F.xxhash64("text"))
    suspects = checkpointed(marked.mapInArrow(suspect, "doc_id bigint, text_key bigint, key binary, lines array<int>"))
    held = suspects.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    repeated = held.groupBy("key").agg(F.count(F.lit(1)).alias("found"), F.max("doc_id").alias("keeper")).filter(F.col("found") >= LEAST_DOCS).select("key", "keeper")
    repeated = checkpointed(repeated)
    # a repeated row brings its lines twice, which drops them once
    going = suspects.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_list("lines")).alias("lines"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for t, going_ in zip(utf8(batch, "text"), values(batch, "lines"), strict=True):
                lines, gone = (t or b"").split(b"\n"), set(going_ or ())
                n_lines.append(len(lines)), n_dropped.append(len(gone))
                kept.append(b"\n".join([line for i, line in enumerate(lines) if i not in gone]) if gone else t or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "kept_text"])

    joined = marked.alias("d").join(going.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.text_key = g.text_key"), "left")
    return joined.select("d.doc_id", "d.text", "g.lines").mapInArrow(drop, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")
