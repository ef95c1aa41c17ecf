"""Ranked lexical search by Block-Max MaxScore.

The index has one row per shard of documents: the postings of each term in compressed blocks, and of each block what bounds its scores.
A search reads a shard's lists from the highest bound down. Lists whose bounds together can't reach the k-th score so far are non-essential:
they are asked only about documents found before, and a document goes before its block is decompressed where the block's bound won't lift it.
Shards of a task share their heaps; the heaps of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import small_batches, utf8, values, words_of
from tradelens.session import checkpointed, work_folder

#: Documents and postings at which a shard is full, postings of a block, bytes of item texts searched at a time.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, ITEM_BYTES = 8192, 2_000_000, 128, 8 << 20
#: Fixed values of the contract's score: hundredths that a text's length counts, and the scale of a term's part.
LENGTH_PART, SCALE = 75, 1_000_000_000
#: No document has this many terms.
LONGEST = 1 << 62

_COLUMNS = {
    "doc_ids": "array<bigint>", "lengths": "array<bigint>", "terms": "array<binary>", "counts": "array<bigint>", "block_of": "array<int>",
    "first": "array<int>", "last": "array<int>", "size": "array<int>", "short_one": "array<bigint>", "most": "array<bigint>", "short_many": "array<bigint>",
    "at": "array<bigint>", "payload": "binary", "n_docs": "bigint", "n_terms": "bigint",
}
_KINDS = {"array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "binary": pa.binary(), "bigint": pa.int64()}


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest whole bytes that hold the largest, that width first."""
    width = 1 if (top := int(numbers.max())) < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + n * width


class _Builder:
    """Postings of one shard."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = 0

    def add(self, doc_id: int | None, n: int, found: Counter) -> None:
        place = len(self.doc_ids)
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.postings += len(found)
        for term, tf in found.items():
            docs, tfs = self.lists.setdefault(term, ([], []))
            docs.append(place)
            tfs.append(tf)

    def row(self) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in _COLUMNS}
        lengths, payload, at = np.array(self.lengths, dtype=np.int64), [], 0
        for term in sorted(self.lists):
            docs, tfs = (np.array(x, dtype=np.int64) for x in self.lists[term])
            out["terms"].append(term)
            out["counts"].append(len(docs))
            out["block_of"].append(len(out["at"]))
            for start in range(0, len(docs), BLOCK):
                d, tf = docs[start:start + BLOCK], tfs[start:start + BLOCK]
                n, many = lengths[d], tf > 1
                data = _packed(np.diff(d, prepend=d[0])) + _packed(tf)
                for name, value in (
                    ("first", d[0]), ("last", d[-1]), ("size", len(d)), ("short_one", n[~many].min(initial=LONGEST)), ("most", tf.max()),
                    ("short_many", n[many].min(initial=LONGEST)), ("at", at),
                ):
                    out[name].append(int(value))
                payload.append(data)
                at += len(data)
        out["block_of"].append(len(out["at"]))
        out |= {"doc_ids": self.doc_ids, "lengths": self.lengths, "payload": b"".join(payload), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}
        return pa.RecordBatch.from_arrays([pa.array([out[name]], _KINDS[kind]) for name, kind in _COLUMNS.items()], list(_COLUMNS))


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index, written once as Parquet: a row per shard, made where the documents are, without a shuffle.

    ``vocabulary`` limits the postings, not the lengths, to the terms that will be searched; it is sent to all tasks, so the caller bounds it. A shard holds at most
    ``shard_docs`` documents and little more than SHARD_POSTINGS postings. Null texts have no terms.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched, shard = wanted.value, _Builder()
        for batch in batches:
            for doc, t in zip(values(batch, "doc_id"), utf8(batch, "text"), strict=True):
                words = words_of(t)
                shard.add(doc, len(words), Counter(words if searched is None else filter(searched.__contains__, words)))
                if len(shard.doc_ids) >= shard_docs or shard.postings >= SHARD_POSTINGS:
                    yield shard.row()
                    shard = _Builder()
        if shard.doc_ids:
            yield shard.row()

    folder = work_folder(spark, "lexical-index")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _COLUMNS.items())).write.parquet(folder)
    return spark.read.parquet(folder)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence in the query adds, before the term's weight. Grows with tf and falls with m."""
    return (SCALE * tf) // (1000 * tf + 8 * m)


class _Shard:
    """A row of the index, with the bounds that its blocks have under the statistics of all documents."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        ints = lambda name: np.asarray(row[name], dtype=np.int64)
        soften = lambda n: 100 - LENGTH_PART + (LENGTH_PART * n * n_docs) // n_terms
        self.m = soften(ints("lengths"))
        self.places = {term: i for i, term in enumerate(row["terms"])}
        self.block_of, self.first, self.last, self.size, self.at, self.payload = ints("block_of"), ints("first"), ints("last"), ints("size"), ints("at"), row["payload"]
        one, most, many = ints("short_one"), ints("most"), ints("short_many")
        bound = lambda tf, n: np.where(n < LONGEST, _part(tf, soften(np.where(n < LONGEST, n, 0))), 0)
        self.bound = np.maximum(bound(np.ones_like(one), one), bound(most, many))
        self.opened = 0

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and occurrences in some blocks of one list, in order."""
        docs, tfs = [], []
        for b in blocks.tolist():
            steps, at = _unpacked(self.payload, int(self.at[b]), int(self.size[b]))
            docs.append(self.first[b] + steps.cumsum())
            tfs.append(_unpacked(self.payload, at, int(self.size[b]))[0])
        self.opened += len(docs)
        return np.concatenate(docs), np.concatenate(tfs)

    def best(self, query: dict[bytes, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents among which are all of the shard's best k with a score of ``least`` or more. The query has a weight for each term."""
        found = [(t, w) for t, w in ((self.places.get(term), w) for term, w in query.items()) if t is not None and w > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = [(slice(self.block_of[t], self.block_of[t + 1]), w) for t, w in found]
        lists = sorted(((int(self.bound[s].max()) * w, s, w) for s, w in spans), key=lambda x: (-x[0], x[1].start))
        rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0).tolist()  # what the lists from here on add at most
        score = np.zeros(len(self.m), dtype=np.int64)
        least = max(least, 1)

        def kth(of: np.ndarray) -> int:
            return int(np.partition(of, -k)[-k]) if len(of) >= k else 0

        essential = 0
        while essential < len(lists) and rest[essential] >= least:
            _, s, w = lists[essential]
            docs, tf = self.postings(np.arange(s.start, s.stop))
            score[docs] += w * _part(tf, self.m[docs])
            least = max(least, kth(score))
            essential += 1
        docs = np.flatnonzero((score > 0) & (score + rest[essential] >= least))
        for j in range(essential, len(lists)):
            _, s, w = lists[j]
            block = np.searchsorted(self.last[s], docs) + s.start
            inside = block < s.stop
            inside[inside] = self.first[block[inside]] <= docs[inside]
            lift = np.zeros(len(docs), np.int64)
            lift[inside] = w * self.bound[block[inside]]
            stay = score[docs] + lift + rest[j + 1] >= least
            docs, block, inside = docs[stay], block[stay], inside[stay]
            if inside.any():
                there, tf = self.postings(np.unique(block[inside]))
                asked = docs[inside]
                spot = np.minimum(np.searchsorted(there, asked), len(there) - 1)
                hit = there[spot] == asked
                score[asked[hit]] += w * _part(tf[spot[hit]], self.m[asked[hit]])
            least = max(least, kth(score[docs]))
            docs = docs[score[docs] + rest[j + 1] >= least]
        return docs, score[docs]


def _order(entry: tuple[int, int | None]) -> tuple:
    """Highest score first, then the smallest id, a null id last."""
    return -entry[0], entry[1] is None, entry[1] or 0


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(words_of(t)) for t in utf8(batch, "text")]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["item_no", "terms", "times"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           shard_docs: int = SHARD_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0, equal scores by id (a null id last).

    Every row of ``items`` is an item of its own, every row of ``docs`` a document, repeated ids too. Texts that are null or have no term match nothing; an
    empty table of either kind gives no rows. Other columns are not read. Items are sent to the tasks in blocks of about ``item_bytes``; with one block only its
    terms are indexed, with more all terms are, so the documents are read once in any case.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = checkpointed(items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).withColumn("item_no", F.monotonically_increasing_id()))
    blocks = -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes)
    parsed = checkpointed(given.select("item_no", "text").mapInArrow(_item_terms, "item_no bigint, terms array<binary>, times array<bigint>"))
    in_block = lambda b: parsed.filter(F.pmod(F.xxhash64("item_no"), F.lit(max(blocks, 1))) == b).filter(F.size("terms") > 0)
    queries = [[(r["item_no"], dict(zip(map(bytes, r["terms"]), r["times"], strict=True))) for r in in_block(b).collect()] for b in range(blocks if blocks == 1 else 0)]
    index = build_index(docs, frozenset(t for _, q in queries[0] for t in q) if queries else None, doc_id, text, shard_docs)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    heaps = []
    for b in range(blocks if n_docs else 0):
        asked = queries[b] if queries else [(r["item_no"], dict(zip(map(bytes, r["terms"]), r["times"], strict=True))) for r in in_block(b).collect()]
        terms = in_block(b).select(F.explode("terms").alias("term")).distinct()
        counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
        weight = {bytes(r["term"]): term_weight(n_docs, r["df"]) for r in counted.join(terms, "term", "left_semi").collect()}  # the terms of one block
        weighed = spark.sparkContext.broadcast([(no, {t: weight[t] * times for t, times in q.items() if t in weight}) for no, q in asked])

        def run(batches: Iterator[pa.RecordBatch], weighed=weighed) -> Iterator[pa.RecordBatch]:
            heap: dict[int, list[tuple[int, int | None]]] = {no: [] for no, _ in weighed.value}
            for batch in batches:
                for row in batch.to_pylist():
                    shard = _Shard(row, n_docs, n_terms)
                    for no, query in weighed.value:
                        top = heap[no]
                        places, scores = shard.best(query, k, top[-1][0] if len(top) == k else 0)
                        heap[no] = sorted([*top, *((s, row["doc_ids"][p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True))], key=_order)[:k]
            flat = [(no, s, d) for no, top in heap.items() for s, d in top]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(3)], ["item_no", "score", "doc_id"])

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a row is a whole shard
        heaps.append(checkpointed(index.drop("n_docs", "n_terms", "counts").mapInArrow(run, "item_no bigint, score bigint, doc_id bigint")))
        small_batches(spark)
        weighed.unpersist()
    merged = heaps[0] if heaps else spark.createDataFrame([], "item_no bigint, score bigint, doc_id bigint")
    for more in heaps[1:]:
        merged = merged.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).join(given.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
