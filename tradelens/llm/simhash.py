"""Near-duplicates by SimHash with a hierarchical index in Gray order.

Distinct fingerprints are keyed by the bits of one of three blocks: with two differing bits at most, two fingerprints share a block.
Within a key, fingerprints are sorted by Gray rank and every few of them form a node that holds the bits they
share; nodes form nodes above. The index is joined with itself from the top: a pair of nodes whose shared bits differ in more than
two places is pruned with everything below. A key with too many fingerprints is split by blocks of its remaining bits, which again must
agree in one of three, so groups stay bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import small_batches, utf8, values
from tradelens.session import checkpointed, released, stored

SEED, SHINGLE, DISTANCE, BLOCKS = 42, 3, 2, 3
#: Children of a node, node pairs expanded at a time, and the size from which a key is split.
FANOUT, SLICE, LARGE = 16, 4096, 2048
ALL = (1 << 64) - 1


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``shingle`` words of the whole text, repeats included, in blocks; of the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    for start in range(0, max(len(words) - shingle + 1, 1 if words else 0), block):
        some = words[start:start + block + shingle - 1]
        joined = b" ".join(some)
        lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        ends = (lengths + 1).cumsum() - 1
        size = min(shingle, len(some))
        spans = zip((ends - lengths)[:len(some) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(some) - size + 1)


def _majority(blocks: Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: bytes | None, block: int = 1 << 16, shingle: int = SHINGLE) -> int:
    """Bit b is set if more than half the shingle hashes have it; 0 without words."""
    return _majority(shingle_hashes(text, shingle, block))


def _keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fp: one row per input row, from the whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t) for t in utf8(batch, "text")], pa.int64())], ["doc_id", "text_key", "fp"])

    return _keyed_rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of a code in the Gray sequence, in which neighbours differ by one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(mask: int) -> list[int]:
    """The mask joined by each third of the bits that it leaves free."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(len(free) * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [mask | sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Index:
    """Levels of nodes over sorted codes; a node is the bits its codes share and their values."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        nodes = [(np.full(len(codes), ALL, dtype=np.uint64), codes, np.arange(len(codes)), np.ones(len(codes), dtype=np.int64))]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(place % FANOUT == 0)
            shared, pattern = nodes[-1][0], nodes[-1][1]
            both, either = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            nodes.append((np.bitwise_and.reduceat(shared, starts) & ~(both ^ either), both, starts, np.diff(np.append(starts, len(group)))))
            group = group[starts]
        self.nodes = nodes

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of codes within the distance, in slices."""
        top = np.arange(len(self.nodes[-1][1]))
        yield from self._below(len(self.nodes) - 1, top, top)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            yield a[a != b], b[a != b]
            return
        shared, pattern = self.nodes[level - 1][:2]
        first, size = self.nodes[level][2:]
        for s in range(0, len(a), SLICE):
            left, right = a[s:s + SLICE], b[s:s + SLICE]
            times = size[left] * size[right]
            which = np.repeat(np.arange(len(left)), times)
            within = np.arange(len(which)) - np.repeat(times.cumsum() - times, times)
            x = first[left][which] + within // size[right][which]
            y = first[right][which] + within % size[right][which]
            near = (x <= y) | (left != right)[which]
            differ = (pattern[x] ^ pattern[y]) & shared[x] & shared[y]
            near &= np.bitwise_count(differ) <= DISTANCE
            yield from self._below(level - 1, x[near], y[near])


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place that each place is linked to, without a list of the pairs."""
    parent = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = parent[x]

    for a, b in pairs:
        while len(a):
            a, b = find(a), find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return find(np.arange(n))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, root: for each fingerprint that has a link in its key, the first of those linked to it there. Rows come sorted by key."""
    names = ("mask", "value", "fp")

    def linked(mask: np.ndarray, value: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(codes), value, mask))
        mask, value, codes = mask[order], value[order], codes[order]
        group = np.concatenate([[0], ((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])).cumsum()])
        root = _roots(len(codes), _Index(codes, group).pairs())
        tied = root != np.arange(len(codes))
        return pa.RecordBatch.from_arrays([pa.array(codes[tied].view(np.int64)), pa.array(codes[root[tied]].view(np.int64))], ["fp", "root"])

    rest = [np.zeros(0, np.uint64)] * 3
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in names]
        rest = [np.concatenate([r, c]) for r, c in zip(rest, columns, strict=True)]
        mask, value, _ = rest
        changes = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        if len(changes):  # the last key may go on in the next batch
            cut = changes[-1] + 1
            yield linked(*[r[:cut] for r in rest])
            rest = [r[cut:] for r in rest]
    if len(rest[0]):
        yield linked(*rest)


def links(codes: DataFrame, large: int = LARGE) -> DataFrame:
    """fp, root: edges that connect the distinct fingerprints of ``codes`` exactly as the pairs within the distance do."""
    masks = _split(0)
    level = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    done = []
    while True:
        level = level.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        masks = [m for m in masks if (ALL ^ m).bit_count() > 12]  # a key with few free bits is bounded by them
        hot = checkpointed(level.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("mask", "value"))
        if not masks or hot.isEmpty():
            done.append(level)
            break
        below = {m: _split(m) for m in masks}
        children = F.create_map(*[x for m, parts in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))])
        splits = hot.filter(F.col("mask").isin([_signed(m) for m in masks]))
        done.append(level.join(splits, ["mask", "value"], "left_anti").select("fp", "mask", "value"))
        level = level.join(splits, ["mask", "value"], "left_semi").select("fp", F.explode(F.element_at(children, F.col("mask"))).alias("mask"))
        masks = [p for parts in below.values() for p in parts]
    keyed = done[0]
    for more in done[1:]:
        keyed = keyed.unionByName(more)
    keyed.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    found = checkpointed(keyed.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_link, "fp bigint, root bigint").distinct())
    small_batches(keyed.sparkSession)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges (fp, root) is connected to.

    Each round takes the smaller label across every edge, hooks it to the node and to its former label, and
    follows labels once. Labels are stored each round, so that the next is planned by their real size; the number of rounds follows the logarithm of the longest chain.
    """
    labels = stored(edges.select(F.explode(F.array("fp", "root")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        left, right = labels.toDF("fp", "a"), labels.toDF("root", "b")
        met = edges.join(left, "fp").join(right, "root").filter("a <> b").select("fp", "root", "a", "b", F.least("a", "b").alias("low"))
        met = met.select(F.explode(F.array("fp", "root", "a", "b")).alias("node"), F.col("low").alias("offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        met = checkpointed(met)
        if met.isEmpty():
            return labels
        lower = checkpointed(labels.join(met, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label")))
        up = lower.toDF("label", "above")
        labels = stored(lower.join(up, "label").select("node", F.least("label", "above").alias("label")), "labels")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, fp, group_fp, component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest id reachable. Copies share a fingerprint and are
    never paired. Texts without words (null too) have fingerprint 0, which links like any other. A null id never names a component
    unless it has no other, then component_id is null. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, doc_id, text))
    codes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = components(links(codes.select("fp"))).toDF("fp", "label")
    grouped = codes.join(named, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("group_fp"))
    grouped = checkpointed(grouped)
    ids = checkpointed(grouped.groupBy("group_fp").agg(F.min("first_id").alias("component_id")))
    of_code = checkpointed(grouped.select("fp", "group_fp").join(ids, "group_fp"))
    return rows.join(of_code, "fp").select("doc_id", "text_key", "fp", "group_fp", "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """The documents, all columns, one of each component: the smallest id, of repeated ids the smallest text hash, of equal rows one.

    Components are those of ``near_groups``, or with ``similarity`` those of ``similar_groups``.
    Only ids and hashes are compared across documents; texts move once, for the join with those that stay.
    """
    found = near_groups(docs, doc_id, text).withColumnRenamed("group_fp", "group") if similarity is None else similar_groups(docs, similarity, doc_id=doc_id, text=text)
    found = found.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("s"))
    stays = checkpointed(best.select("s.doc_id", "s.text_key", "s.n"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    kept = rows.alias("d").join(stays.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.text_key = s.text_key")).select("d.*", "s.n")
    if stays.filter("n > 1").isEmpty():
        return kept.select("row.*")
    # rows that repeat: any of them, as their id and text agree
    return kept.filter("n = 1").select("row.*").unionByName(kept.filter("n > 1").dropDuplicates(["doc_id", "text_key"]).select("row.*"))


# ---- similar texts ---------------------------------------------------------------------------

#: Words of a shingle where similarity counts; bands of the MinHash sketch and rows of each: a pair at 0.8 shares a band with probability 0.99.
WIDE, BANDS, ROWS = 5, 20, 7


def _sketch(hashes: np.ndarray) -> list[int]:
    """One hash per band: of the least values of its rows, each under a multiplication of its own."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, ALL, dtype=np.uint64)
    for start in range(0, len(hashes), 4096):
        mixed = hashes[start:start + 4096]
        mixed = (mixed ^ (mixed >> np.uint64(29)))[:, None] * factors[None, :]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _set_of(text: bytes | None) -> np.ndarray:
    blocks = list(shingle_hashes(text, WIDE))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, dtype="<u8")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, class, n, fp, bands: the class stands for the set of shingles, so copies and texts that only repeat themselves share it."""
    for batch in batches:
        classes, sizes, codes, bands = [], [], [], []
        for t in utf8(batch, "text"):
            own = _set_of(t)
            classes.append(xxhash.xxh3_128_digest(own.tobytes())), sizes.append(len(own))
            codes.append(_majority(iter([own]))), bands.append(_sketch(own) if len(own) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(codes, pa.int64()),
                                          pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "class", "n", "fp", "bands"])


def _marks(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the one bigint column by its remainder, in words of 64; of bounded size, so other values may find their bit set."""
    size = min(max(1 << (64 * keys.count()).bit_length(), 64), MARKS)
    place = keys.toDF("key").select(F.pmod("key", F.lit(size)).alias("place"))
    words = place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits")).toArrow()
    marks = np.zeros(size // 64, dtype=np.uint64)
    marks[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return marks


def _marked(marks: np.ndarray, batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    place = batch.column(batch.schema.get_field_index(name)).to_numpy() % (64 * len(marks))
    bits = marks[place // 64] >> (place % 64).astype(np.uint64) & np.uint64(1)
    return batch.filter(pa.array(bits.astype(bool)))


def _only(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets that one of the classes may have, so that a join moves few of them."""
    marks = _marks(checkpointed(classes.select(F.xxhash64("class").alias("key")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marked(marks, batch, "key").select(["class", "shingles"])

    return sets.withColumn("key", F.xxhash64("class")).mapInArrow(run, "class binary, shingles array<bigint>")


def _sets(marks: np.ndarray):
    """class, shingles: of the texts that have their bit, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found = {}
            for t in utf8(_marked(marks, batch, "text_key"), "text"):
                own = _set_of(t)
                name = xxhash.xxh3_128_digest(own.tobytes())
                if name not in seen:
                    seen.add(name)
                    found[name] = own.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["class", "shingles"])

    return run


#: Classes of a bucket up to which all of them are compared in one task.
MOST_CLASSES = 64
#: Shingles are ordered by how many texts of a sample hold them: one text in SHARE, LEAST texts at least; the FREQUENT commonest are told from the rest.
SHARE, LEAST, FREQUENT = 32, 8192, 1 << 16
#: Bits that tell which texts are read again, at most.
MARKS = 1 << 25
#: Rounds in which groups are compared: a class has its set in each of its groups, so all of them at once are several times the sets.
COMPARE_ROUNDS = 4
#: Classes of a crowded shingle that meet in one cell, at most about twice as many.
CELL = 1024


def _tied(similarity: float):
    """fp, root: links that connect the classes of a group (rows chunk, class, shingles, sorted by chunk) exactly as its similar pairs do; pairs that are connected already are not compared."""

    def links_of(members: list[tuple[bytes, frozenset[int]]]) -> list[tuple[bytes, bytes]]:
        members = sorted(members, key=lambda m: (len(m[1]), m[0]))
        parent = list(range(len(members)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = []
        for k, (name, own) in enumerate(members):
            for m in range(k + 1, len(members)):
                other = members[m][1]
                if len(own) < similarity * len(other) - 1e-9:
                    break  # the rest is larger still
                if find(k) != find(m):
                    shared = len(own & other)
                    if shared >= (len(own) + len(other) - shared) * similarity - 1e-9:
                        parent[find(m)] = find(k)
                        out.append((name, members[m][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            shingles = batch.column(batch.schema.get_field_index("shingles"))
            for i, (chunk, name) in enumerate(zip(values(batch, "chunk"), values(batch, "class"), strict=True)):
                if chunk != current:
                    out += links_of(members)
                    current, members = chunk, []
                members.append((name, frozenset(shingles[i].values.to_numpy().tolist())))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], ["fp", "root"])
        out = links_of(members)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], ["fp", "root"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [_set_of(t) for t in utf8(batch, "text")]
        shingles, n = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n)], ["shingle", "n"])


def frequent_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and how many. They only set the order of the shingles, any order gives the same groups: the better they are told, the fewer texts meet for nothing."""
    share = max(min(SHARE, docs.count() // LEAST), 1)
    texts = docs.select(F.xxhash64(text).alias("text_key"), F.col(text).cast("string").alias("text")).filter(F.pmod("text_key", F.lit(share)) == 0).dropDuplicates(["text_key"])
    found = texts.mapInArrow(_counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
    rows = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    shingles, n = np.array([r["shingle"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix_of(own: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: so many that two similar sets have one of them in common."""
    place = np.searchsorted(frequent, own)
    known = place < len(frequent)
    known[known] = frequent[place[known]] == own[known]
    n = np.zeros(len(own), dtype=np.int64)
    n[known] = counts[place[known]]
    return own[np.lexsort((own, n))[:len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]]


def _prefixes(similarity: float, frequent: np.ndarray, counts: np.ndarray):
    """shingle, code, pos, n: the prefix of each class, once a task. The code is Spark's xxhash64 of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            codes, sizes, parts = [], [], []
            for t in utf8(batch, "text"):
                own = _set_of(t)
                code = xxhash.xxh64_intdigest(xxhash.xxh3_128_digest(own.tobytes()), SEED)
                if len(own) and code not in seen:
                    seen.add(code)
                    codes.append(code), sizes.append(len(own)), parts.append(prefix_of(own, similarity, frequent, counts))
            lengths = np.array([len(x) for x in parts], dtype=np.int64)
            pos = np.arange(lengths.sum()) - np.repeat(lengths.cumsum() - lengths, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype="<u8"), *parts]).view(np.int64)), pa.array(np.repeat(np.array(codes, dtype=np.uint64), lengths).view(np.int64)),
                                              pa.array(pos.astype(np.int32)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths))], ["shingle", "code", "pos", "n"])

    return run


def shared_prefixes(docs: DataFrame, similarity: float, text: str = "text") -> DataFrame:
    """shingle, code, pos, n, members: the prefix shingles that several classes have, one row per class. Two similar classes have such a shingle in common, their first common one in the order."""
    frequent, counts = frequent_shingles(docs, text)
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_prefixes(similarity, frequent, counts), "shingle bigint, code bigint, pos int, n int")
    of = Window.partitionBy("shingle")
    several = rows.withColumn("low", F.min("code").over(of)).withColumn("high", F.max("code").over(of)).filter("low < high").select("shingle", "code", "pos", "n").distinct()
    return stored(several.withColumn("members", F.count(F.lit(1)).over(of)), "shared")


def _may_be_similar(similarity: float) -> Column:
    """Rows a and b of a shared shingle, a the smaller set: whether the sizes and the shingles from there on allow the similarity, if this is their first common one."""
    least = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.class") < F.col("b.class")))
    return smaller & (F.col("a.n") >= F.col("b.n") * similarity - 1e-6) & (least >= (F.col("a.n") + F.col("b.n")) * (similarity / (1 + similarity)) - 1e-6)


def _left(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows that can be the smaller set of a pair: it has at least the shingles that two sets of its size need."""
    return rows.filter(F.col("n") - F.col("pos") >= F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6)


def close_pairs(shared: DataFrame, similarity: float, most: int) -> DataFrame:
    """a, b: the codes of the pairs of classes that meet in a shingle of up to ``most`` classes and may be similar.

    One of the two prefixes ends first, and of its shingles the other set has those alone that both prefixes have. So the sets have no more in common than these and what is behind the prefix;
    shingles of more classes count as common.
    """
    def behind(side: str) -> Column:
        return F.ceil(F.col(f"{side}.n") * similarity - 1e-9) - 1

    crowd = stored(shared.filter(F.col("members") > most).groupBy("code").agg(F.count(F.lit(1)).alias("crowd")), "crowd")
    rows = shared.filter(F.col("members") <= most).select("shingle", "code", "n").join(crowd, "code", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0)))
    a, b = rows.alias("a"), rows.alias("b")
    meet = F.expr("a.shingle = b.shingle AND (a.n < b.n OR a.n = b.n AND a.code < b.code)") & (F.col("a.n") >= F.col("b.n") * similarity - 1e-6)
    most_common = F.least("a.crowd", "b.crowd") + F.greatest(behind("a"), behind("b"))
    pairs = a.join(b, meet).select(F.col("a.code").alias("a"), F.col("b.code").alias("b"), ((F.col("a.n") + F.col("b.n")) * (similarity / (1 + similarity)) - most_common).alias("wanted"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("wanted").alias("wanted")).filter(F.col("common") >= F.col("wanted") - 1e-6).select("a", "b")


def crowded_pairs(shared: DataFrame, labels: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """fp, root: as ``close_pairs``, without pairs of one label (class, label; a class without one is its own).

    The classes of a shingle are dealt to blocks, and every two blocks meet in a cell of their own, so no task has a whole shingle and every pair meets.
    """
    rows = shared.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    of = Window.partitionBy("shingle")
    rows = rows.withColumn("low", F.min("label").over(of)).withColumn("high", F.max("label").over(of)).filter("low < high")
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / F.lit(cell))).withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = checkpointed(rows.select("shingle", "class", "pos", "n", "label", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")))
    a, b = _left(rows, similarity).alias("a"), rows.alias("b")
    meet = F.expr("a.shingle = b.shingle AND a.first = b.first AND a.second = b.second AND a.label <> b.label AND (a.block <> b.block OR a.first = a.second)")
    return a.join(b, meet & _may_be_similar(similarity)).select(F.col("a.class").alias("fp"), F.col("b.class").alias("root")).distinct()


def _compared(groups: DataFrame, sets: DataFrame, similarity: float, rounds: int = COMPARE_ROUNDS) -> DataFrame:
    """fp, root: links between the classes of each group (column ``classes``). Every group is compared in one of the rounds, whose shuffled sets go before the next."""
    chunked = stored(groups.select(F.md5(F.array_join(F.transform("classes", F.hex), "")).alias("chunk"), "classes"), "chunks")
    found = []
    for k in range(rounds):
        some = chunked.filter(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k).select("chunk", F.explode("classes").alias("class")).join(sets, "class")
        found.append(stored(some.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_tied(similarity), "fp binary, root binary"), "links"))
    released(chunked)
    return reduce(DataFrame.unionByName, found)


def similar_groups(docs: DataFrame, similarity: float, doc_id: str = "doc_id", text: str = "text", most: int = MOST_CLASSES) -> DataFrame:
    """One row per input row: doc_id, text_key, group. Texts whose sets of five-word shingles have a Jaccard similarity of at least ``similarity`` are linked; groups are connected by all such links.

    Texts with the same set are one class; classes, not copies, are compared. First, classes meet in buckets: the components of the Gray-order index over their fingerprints, and the bands of a MinHash
    sketch. Those of a bucket are compared exactly in one task, which gives links, not pairs; in a bucket above ``most`` classes all are compared with the one that shares most buckets, and those that it does not match
    in groups of about ``most``, drawn by hash. That ties most of what is similar at a bounded cost, but not all.
    Then an exact join finds every link between classes that are not tied yet: in one order of all shingles, rare ones first, two similar sets have one of their first shingles in common (``prefix_of``). Pairs that meet there
    and whose sizes and places allow the similarity are compared. A shingle above ``most`` classes is joined in cells, without pairs that are tied; nothing is left out.
    A text without words has the empty set and is similar to its like alone. A null id is an id like any other, repeated rows are members of their class, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = stored(_keyed_rows(docs, doc_id, text).mapInArrow(_described, "doc_id bigint, text_key bigint, class binary, n int, fp bigint, bands array<bigint>"), "described")
    classes = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bands").alias("bands"))
    classes = stored(classes.filter("n > 0"), "classes")
    named = components(links(classes.select("fp").distinct())).toDF("fp", "label")
    by_code = classes.select("class", "fp").join(named, "fp", "left").select("class", F.lit(-1).alias("band"), F.coalesce("label", "fp").alias("key"))
    keyed = by_code.unionByName(classes.select("class", F.posexplode("bands").alias("band", "key")))
    crowded = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = stored(keyed.join(crowded, ["band", "key"]), "met")
    small_batches(docs.sparkSession)
    shared = shared_prefixes(docs, similarity, text)
    coded = classes.select("class", F.xxhash64("class").alias("code"))
    close = close_pairs(shared, similarity, most).join(coded.toDF("fp", "a"), "a").join(coded.toDF("root", "b"), "b")
    close = stored(close.select("fp", "root"), "close")
    crowd = stored(shared.filter(F.col("members") > most).join(coded, "code").select("shingle", "class", "pos", "n", "members"), "crowd")
    released(shared)
    needed = met.select("class").union(close.select(F.explode(F.array("fp", "root")))).union(crowd.select("class")).distinct()
    marks = _marks(checkpointed(needed.join(classes.select("class", "one.text_key"), "class").select("text_key")))
    sets = stored(_keyed_rows(docs, doc_id, text).select("text_key", "text").mapInArrow(_sets(marks), "class binary, shingles array<bigint>").dropDuplicates(["class"]), "sets")

    large = met.filter(F.col("members") > most)
    degree = met.groupBy("class").agg(F.sum("members").alias("degree"))
    centres = large.join(degree, "class").groupBy("band", "key").agg(F.max(F.struct("degree", "class")).alias("c")).select("band", "key", F.col("c.class").alias("centre"))
    starred = checkpointed(large.join(centres, ["band", "key"]).filter("class <> centre").select("band", "key", "class", "centre", "members"))
    x, y = _only(sets, starred.select("class")).toDF("class", "x"), _only(sets, starred.select(F.col("centre").alias("class"))).toDF("centre", "y")
    both = F.size(F.array_intersect("x", "y"))
    stars = checkpointed(starred.select("class", "centre").distinct().join(x, "class").join(y, "centre").filter(
        both >= (F.size("x") + F.size("y") - both) * similarity - 1e-9).select("class", "centre"))
    rest = starred.join(stars, ["class", "centre"], "left_anti").select(
        "band", "key", "class", F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / F.lit(most))).alias("part"))
    small = met.filter(F.col("members") <= most).select("band", "key", "class", F.lit(0).cast("bigint").alias("part"))
    # a group has about ``most`` classes; bands that bring the same ones together count once
    groups = small.unionByName(rest).groupBy("band", "key", "part").agg(F.array_sort(F.collect_set("class")).alias("classes")).filter(F.size("classes") > 1).select("classes").distinct()
    edges = stored(_compared(groups, sets, similarity).unionByName(stars.toDF("fp", "root")).distinct(), "edges")
    labels = components(edges).toDF("class", "label")

    # every pair that is not tied so far; labels that such a pair links are one
    fp, root = labels.toDF("fp", "a"), labels.toDF("root", "b")
    apart = close.join(fp, "fp", "left").join(root, "root", "left").filter(F.coalesce("a", "fp") != F.coalesce("b", "root")).select("fp", "root")
    pairs = checkpointed(apart.unionByName(crowded_pairs(crowd, labels, similarity)).select(F.array("fp", "root").alias("classes")).distinct())
    late = _compared(pairs, _only(sets, pairs.select(F.explode("classes").alias("class"))), similarity)
    late = stored(late.join(fp, "fp", "left").join(root, "root", "left").select(F.coalesce("a", "fp").alias("fp"), F.coalesce("b", "root").alias("root")).distinct(), "edges")
    for done in (sets, met, close, crowd, classes):
        released(done)
    joined = components(late).toDF("label", "joined")
    named = rows.select("doc_id", "text_key", "class").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    return named.join(joined, "label", "left").select("doc_id", "text_key", F.coalesce("joined", "label").alias("group"))
