"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, of equally cheap ones the least audit.

A node is a place between two rows and the role before it (none, system, user, assistant); an arc keeps, reroles or deletes the next row or inserts
one, and has a cost and a letter. The cost DP is a product of (min, +) matrices, one a row, so a conversation may be cut into segments of
neighbouring rows, however long it is. The arcs that lie on cheapest ways are ranked by prefix doubling: ranks of audits of 1, 2, 4, ... letters
come from pairs of ranks before, and pointers that double lead to the end of the segment. Segments are chained by doubling as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import BLANKS, values
from tradelens.session import checkpointed

#: Rows of a segment, and rows that a task works on at a time (whole segments of them).
SEGMENT, CHUNK = 2048, 16384
#: Costs of the contract. A kept or reroled row that is truncated costs one more.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Roles before a place: none, system, user, assistant. What may be inserted (or reroled to) there leads to these.
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = np.array([USER, USER, ASSISTANT, USER])
#: Where a kept row of initial s, u, a, or another leads to from each state; -1: it can't be kept there.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Letters in ASCII order, which settles ties.
LETTERS = np.frombuffer(b"DIKR", dtype=np.uint8)
#: Cost of what has to follow the last row: nothing, user and assistant, assistant, nothing.
LAST = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract: crc32 of ``conv_id:turn`` modulo 20 decides. Nulls count as one space; conv_id and turn stay null."""
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.withColumns({"text": text, "role": F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))})
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")


def _conv(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit("null"))


def _digest(role: Column, text: Column) -> Column:
    """Stands for role and text where they are compared; hexadecimal md5, so that it also orders rows of one turn."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role and text) with its number of copies, which are neighbours, and without the text."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    kind = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 2).otherwise(0)
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select(_conv(F.col("conv_id")).alias("conv"), "turn", _digest(F.col("role"), F.col("text")).alias("digest"), kind.alias("kind"), state.alias("initial"))
    return light.groupBy("conv", "turn", "digest", "kind", "initial").agg(F.count(F.lit(1)).alias("n"))


def _cut(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``seg``, the place of the first row of the segment: a new one begins with each conversation and after ``segment`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(batch.schema.get_field_index("conv"))
            pos = batch.column(batch.schema.get_field_index("pos")).to_numpy()
            fresh = np.ones(len(pos), dtype=bool)
            fresh[0] = names[0].as_py() != conv
            fresh[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(fresh, pos, -1))
            start[start < 0] = first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos - (pos - start) % segment)], [*batch.schema.names, "seg"])
            conv, first = names[-1].as_py(), int(start[-1])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole segments, about CHUNK rows at a time. Rows come sorted by seg and pos."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            seg = table.column("seg").to_numpy()
            cut = int(np.searchsorted(seg, seg[-1]))  # the last may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(np.minimum(x[:, :, 0, None] + y[:, None, 0, :], x[:, :, 1, None] + y[:, None, 1, :]),
                      np.minimum(x[:, :, 2, None] + y[:, None, 2, :], x[:, :, 3, None] + y[:, None, 3, :]))


class _Rows:
    """Neighbouring rows of whole segments as arrays."""

    def __init__(self, table: pa.Table):
        of = lambda name: table.column(name).to_numpy()
        self.seg, self.pos, self.n, self.kind, self.initial = of("seg"), of("pos"), of("n"), of("kind"), of("initial")
        self.dup = ~of("first") & (self.kind != 1)
        self.gone = self.dup | (self.kind == 1)
        self.starts = np.flatnonzero(np.concatenate([[True], self.seg[1:] != self.seg[:-1]]))
        self.ends = np.append(self.starts[1:], len(self.seg))
        self.which = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        extra = DELETE * (self.n - 1)  # copies beyond the first go
        late = TRUNCATED * (self.kind == 2) + extra
        keep = np.where(self.gone[:, None], -1, KEPT[self.initial])
        self.cost = np.full((len(self.seg), 4, 4), FAR)  # row, state before, letter
        self.cost[:, :, 0] = (DELETE + extra)[:, None]
        self.cost[:, :, 1] = INSERT
        self.cost[:, :, 2] = np.where(keep >= 0, late[:, None], FAR)
        self.cost[:, :, 3] = np.where(self.gone, FAR, REROLE + late)[:, None]
        self.to = np.stack([np.broadcast_to(np.arange(4), keep.shape), np.broadcast_to(INSERTED, keep.shape), np.maximum(keep, 0), np.broadcast_to(INSERTED, keep.shape)], axis=2)

    def suffixes(self) -> np.ndarray:
        """From each row to the end of its segment, the least cost from state to state."""
        one = np.full((len(self.seg), 4, 4), FAR)  # the row itself, and what is inserted before it
        row, state = np.indices((len(self.seg), 4))
        for letter in (0, 2, 3):
            np.minimum.at(one, (row, state, self.to[:, :, letter]), self.cost[:, :, letter])
        closed = np.full((4, 4), FAR)
        closed[range(4), range(4)] = 0
        closed[range(4), INSERTED] = INSERT
        closed[[START, SYSTEM], ASSISTANT] = 2 * INSERT
        out = _times(np.broadcast_to(closed, one.shape), one)
        step, left = 1, self.ends[self.which] - np.arange(len(self.seg))
        while (more := np.flatnonzero(left > step)).size:
            out[more] = _times(out[more], out[more + step])
            step *= 2
        return np.minimum(out, FAR)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment: the costs through it from state to state, and its counts."""
    for table in _segments(batches):
        r = _Rows(table)
        total = r.suffixes()[r.starts].reshape(len(r.starts), 16)
        pair = np.concatenate([[0], r.initial[:-1] * 4 + r.initial[1:]])
        inner = np.ones(len(r.seg), dtype=bool)
        inner[r.starts] = False
        illegal = inner & ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        add = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), r.starts))
        yield pa.RecordBatch.from_arrays([
            pa.array(r.seg[r.starts]), table.column("conv").take(pa.array(r.starts)).combine_chunks(), pa.array(r.pos[r.ends - 1]), pa.array(total.tolist(), pa.list_(pa.int64())),
            pa.array(r.initial[r.starts]), pa.array(r.initial[r.ends - 1]), add(r.n * (r.kind == 1)), add(np.where(r.kind == 1, 0, r.n - 1 + r.dup)), add((r.kind == 2) & ~r.dup), add(r.n - 1 + illegal),
        ], ["seg", "conv", "tail", "total", "head_initial", "tail_initial", "blank", "duplicate", "truncated", "illegal"])


_TOTALS = "seg bigint, conv string, tail bigint, total array<bigint>, head_initial int, tail_initial int, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_LINE = "struct<step: int, role: string, kept: boolean, turn: bigint, digest: string>"
_SOLVED = f"seg bigint, conv string, exits array<int>, cost bigint, audit string, lines array<{_LINE}>"


def _ranked(letter: np.ndarray, target: np.ndarray, optimal: np.ndarray, stops: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For each node the letter of its least audit, the doubled pointers, and how many letters the audit has.

    letter, target, optimal: arcs of each node. The arcs of a node have different letters, so audits of length 1 already tell them apart; ranks of length
    2 ** (k + 1) are those of pairs (rank at 2 ** k, rank of the node 2 ** k letters on). ``stops`` nodes at the end have no arcs and the empty audit.
    """
    n = len(target)
    choice = np.argmax(optimal, axis=1)
    jump = np.concatenate([target[np.arange(n), choice], np.arange(n, n + stops)])
    rank = np.concatenate([letter[choice].astype(np.int64) + 1, np.zeros(stops, np.int64)])
    length = np.concatenate([np.ones(n, np.int64), np.zeros(stops, np.int64)])
    pointers = [jump]
    while (jump < n).any():
        pair = rank * (int(rank.max()) + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1]
        length = length + length[jump]
        jump = jump[jump]
        pointers.append(jump)
    # an arc's audit is its letter and then the audit that its target ranks for: the least of the optimal arcs is taken
    key = np.where(optimal, letter[None, :].astype(np.int64) * (len(rank) + 1) + rank[target], np.iinfo(np.int64).max)
    return np.argmin(key, axis=1), pointers, length


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per segment: where each state leads, and for the state it is entered in the cost to the end of the conversation, the audit and the lines that stay."""
    for table in _segments(batches):
        r = _Rows(table)
        n, segs = len(r.seg), len(r.starts)
        at_start = lambda name, rows=r, t=table: [x if x is not None else d for x, d in zip(t.column(name).take(pa.array(rows.starts)).to_pylist(), [None] * len(rows.starts), strict=True)]
        given = at_start("after")
        after = np.array([LAST if x is None else x for x in given], dtype=np.int64)
        entry = np.array([x or 0 for x in at_start("entry")])
        is_last = np.array([x is None for x in given])
        togo = np.minimum((r.suffixes() + after[r.which][:, None, :]).min(axis=2), FAR)
        follow = np.concatenate([togo[1:], togo[:1]])
        follow[r.ends - 1] = after
        node = np.arange(n * 4).reshape(n, 4)
        down = np.concatenate([node[1:], node[:1]])
        down[r.ends - 1] = n * 4 + np.arange(segs * 4).reshape(segs, 4)
        row = np.arange(n)[:, None]
        target, rest = np.empty((n, 4, 4), np.int64), np.empty((n, 4, 4), np.int64)
        for letter in range(4):
            to = r.to[:, :, letter]
            target[:, :, letter], rest[:, :, letter] = (node[row, to], togo[row, to]) if letter == 1 else (down[row, to], follow[row, to])
        optimal = (r.cost + rest == togo[:, :, None]).reshape(n * 4, 4)
        choice, pointers, length = _ranked(np.arange(4), target.reshape(n * 4, 4), optimal, segs * 4)
        exits = (pointers[-1][node[r.starts]] - n * 4) % 4

        begin = node[r.starts, entry]
        steps = length[begin]
        seg_of = np.repeat(np.arange(segs), steps)
        step = np.arange(len(seg_of)) - np.repeat(steps.cumsum() - steps, steps)
        now = begin[seg_of]
        for k, jump in enumerate(pointers):
            now = np.where(step >> k & 1 == 1, jump[now], now)
        letter, at, role = choice[now], now // 4, r.to.reshape(n * 4, 4)[now, choice[now]]
        times = np.where(letter == 1, 1, r.n[at])
        spelt = np.full(int(times.sum()), LETTERS[0], dtype=np.uint8)
        spelt[times.cumsum() - times] = LETTERS[letter]
        spelt, ends = spelt.tobytes().decode("ascii"), np.add.reduceat(times, steps.cumsum() - steps).cumsum()
        left = np.where(is_last, exits[np.arange(segs), entry], ASSISTANT)

        turn, digest = values(table, "turn"), values(table, "digest")
        lines: list[list[tuple]] = [[] for _ in range(segs)]
        for i in np.flatnonzero(letter != 0).tolist():
            kept = letter[i] != 1
            lines[seg_of[i]].append((int(step[i]), None if letter[i] == 2 else _ROLES[int(role[i])], bool(kept), turn[at[i]] if kept else None, digest[at[i]] if kept else None))
        audits = []
        for j, end in enumerate(ends.tolist()):
            closing = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(int(left[j]), ())
            audits.append(spelt[int(ends[j - 1]) if j else 0:end] + "I" * len(closing))
            lines[j] += [(int(steps[j]) + k, _ROLES[s], False, None, None) for k, s in enumerate(closing)]
        kind = pa.list_(pa.struct([("step", pa.int32()), ("role", pa.string()), ("kept", pa.bool_()), ("turn", pa.int64()), ("digest", pa.string())]))
        names = ["step", "role", "kept", "turn", "digest"]
        yield pa.RecordBatch.from_arrays([
            pa.array(r.seg[r.starts]), table.column("conv").take(pa.array(r.starts)).combine_chunks(), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(togo[r.starts, entry]),
            pa.array(audits, pa.string()), pa.array([[dict(zip(names, x, strict=True)) for x in seg] for seg in lines], kind),
        ], ["seg", "conv", "exits", "cost", "audit", "lines"])


def _product(x: Column, y: Column) -> Column:
    return F.array(*[F.least(*[F.get(x, F.lit(i * 4 + k)) + F.get(y, F.lit(k * 4 + j)) for k in range(4)], F.lit(FAR)) for i in range(4) for j in range(4)])


def _composed(x: Column, y: Column) -> Column:
    """First x, then y, as states reached from each state."""
    return F.array(*[F.get(y, F.get(x, F.lit(s))) for s in range(4)])


def _chained(links: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """seg, value over the whole chain that starts at each segment. ``links``: seg, jump (the next in the chain or null), value. Pointers double each round."""
    while not links.filter("jump IS NOT NULL").isEmpty():
        there = links.select(F.col("seg").alias("jump"), F.col("jump").alias("further"), F.col("value").alias("more"))
        met = links.join(there, "jump", "left")
        links = checkpointed(met.select("seg", F.col("further").alias("jump"), F.when(F.col("jump").isNull(), F.col("value")).otherwise(combine(F.col("value"), F.col("more"))).alias("value")))
    return links.select("seg", "value")


def _bounds(lined: DataFrame, segs: DataFrame, following: DataFrame) -> DataFrame:
    """seg, after, entry of the segments of conversations that have several: the costs after the segment (null: the last one) and the state it is entered in."""
    many = segs.join(following.select("conv").distinct(), "conv", "left_semi").select("seg", F.col("total").alias("value"))
    onward = _chained(checkpointed(many.join(following.select("seg", F.col("next_seg").alias("jump")), "seg", "left").select("seg", "jump", "value")), _product)
    tail = lambda s: F.least(*[F.get("value", F.lit(s * 4 + k)) + int(LAST[k]) for k in range(4)])
    costs = onward.select(F.col("seg").alias("next_seg"), F.array(*[tail(s) for s in range(4)]).alias("after"))
    after = checkpointed(many.select("seg").join(following.select("seg", "next_seg"), "seg", "left").join(costs, "next_seg", "left").select("seg", "after"))
    rows = lined.join(after, "seg").withColumn("entry", F.lit(0)).repartition("seg").sortWithinPartitions("seg", "pos")
    exits = checkpointed(rows.mapInArrow(_solve, _SOLVED).select("seg", "exits"))
    # the chain towards the front: the value of a segment maps the state before its predecessor to the state before itself
    back = exits.join(following.select("seg", "next_seg"), "seg").select(F.col("next_seg").alias("seg"), F.col("seg").alias("jump"), F.col("exits").alias("value"))
    identity = F.array(*[F.lit(s) for s in range(4)])
    back = checkpointed(exits.select("seg").join(back, "seg", "left").select("seg", "jump", F.coalesce("value", identity).alias("value")))
    entered = _chained(back, lambda value, more: _composed(more, value))
    return after.join(entered, "seg").select("seg", "after", F.get("value", F.lit(0)).cast("int").alias("entry"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, sha256 of its lines. Lines come in order and go through the hash one by one; none is held."""
    conv, state = None, None
    done: list[tuple[str, str]] = []
    for batch in batches:
        for name, role, text in zip(values(batch, "conv"), values(batch, "role"), values(batch, "text"), strict=True):
            if name != conv:
                if state:
                    done.append((conv, state.hexdigest()))
                conv, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text or ''}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], ["conv", "repaired_sha256"])
        done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(summary, lines) of conversations with columns conv_id, turn, role, text, none of the last two null.

    summary: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. lines: conv, seg, step, role, text, the repaired conversation in order of
    (seg, step). Rows are ordered by turn (nulls first), rows of one turn by a hash of role and text; rows that are alike are neighbours. Roles
    other than s..., u..., a... can't be kept. An empty table gives no rows.

    Texts stay out of all steps but the last join. Conversations are cut into segments of ``segment`` rows, so none has to fit in a task; only
    its audit is one value.
    """
    marked = _marked(rows)
    ordered = marked.repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest")
    kinds = "conv string, turn bigint, digest string, kind int, initial int, n bigint, pos bigint"
    ordered = checkpointed(ordered.select("conv", "turn", "digest", "kind", "initial", "n", F.monotonically_increasing_id().alias("pos")).mapInArrow(_cut(segment), f"{kinds}, seg bigint"))
    firsts = ordered.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    lined = ordered.join(firsts, "pos", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    lined = checkpointed(lined.repartition("seg").sortWithinPartitions("seg", "pos"))
    segs = checkpointed(lined.mapInArrow(_totals, _TOTALS))

    # the next segment begins with the next row, which may be the first of the next partition that has rows
    parts = ordered.groupBy(F.shiftrightunsigned("pos", 33).alias("part")).agg(F.min("pos").alias("head"), F.max("pos").alias("tail"))
    parts = parts.select("tail", F.lead("head").over(Window.orderBy("head")).alias("next_head"))  # one row per partition
    ahead = segs.join(parts, "tail", "left").select("seg", "conv", "tail_initial", F.coalesce("next_head", F.col("tail") + 1).alias("next_seg"))
    nexts = segs.select(F.col("seg").alias("next_seg"), F.col("conv").alias("next_conv"), "head_initial")
    following = checkpointed(ahead.join(nexts, "next_seg").filter("conv = next_conv"))
    none = segs.sparkSession.createDataFrame([], "seg bigint, after array<bigint>, entry int")
    bounds = none if following.isEmpty() else checkpointed(_bounds(lined, segs, following))
    solved = checkpointed(lined.join(bounds, "seg", "left").sortWithinPartitions("seg", "pos").mapInArrow(_solve, _SOLVED))

    pair = F.concat_ws("", "tail_initial", "head_initial")
    across = following.groupBy("conv").agg(F.count_if(~pair.isin("01", "12", "21")).alias("across"))
    counts = segs.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    spelt = solved.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"),
                                       F.min_by("cost", "seg").alias("cost"))
    summary = counts.join(turns, "conv").join(spelt, "conv").join(across, "conv", "left").select(
        "conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("across", F.lit(0))).alias("illegal"), "cost", "audit")

    lines = solved.select("conv", "seg", F.explode("lines").alias("x")).select("conv", "seg", "x.*")
    texts = rows.select(_conv(F.col("conv_id")).alias("conv"), "turn", _digest(F.col("role"), F.col("text")).alias("digest"), F.col("role").alias("own"), "text").dropDuplicates(["conv", "turn", "digest"])
    kept = lines.filter("kept").alias("l").join(texts.alias("t"), F.expr("l.conv = t.conv AND l.turn <=> t.turn AND l.digest = t.digest")).select(
        "l.conv", "l.seg", "l.step", F.coalesce("l.role", "t.own").alias("role"), "t.text")
    return summary, kept.unionByName(lines.filter("NOT kept").select("conv", "seg", "step", "role", F.lit("").alias("text")))


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per original conv_id, a null one too: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after the damage.

    A conversation that lost all rows has zeros, an empty audit and the hash of nothing. Rows that repeat count as duplicates of each other. An empty
    table gives no rows, other columns are not read. The hash runs over a whole conversation, so its lines pass one task one by one.
    """
    rows = damage(conversations)
    summary, lines = repair(rows, segment)
    hashed = lines.repartition("conv").sortWithinPartitions("conv", "seg", "step").select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct().select("conv_id", _conv(F.col("conv_id")).alias("conv"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    out = ids.join(summary, "conv", "left").join(hashed, "conv", "left")
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
