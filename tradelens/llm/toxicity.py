"""Toxicity by compression distance.

Two zstandard dictionaries of equal size. Each is a base trained on windows of ordinary text, behind a part trained on words of its own side: of the toxic sample those
places where toxic documents differ from ordinary ones, of the ordinary sample as many words. A window that the toxic dictionary
packs shorter is a suspect and is looked at again in runs of two words. Every piece is packed behind a carrier that both dictionaries
hold, because a short piece alone is stored as it is and shows no gain. The number and the share of windows with each gain, held against
thresholds calibrated on toxic and ordinary documents, give the score of a text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import small_batches, utf8, values
from tradelens.session import checkpointed

#: Bytes of a window, of its step and of the carrier; words of a run; least gain of a suspect; number of gain classes.
WINDOW, STEP, CARRIER, RUN, SUSPECT, CLASSES = 64, 52, 64, 2, 2, 8
#: Characters of a gram, and how many places of it a document names.
GRAM, CONTEXTS = 6, 4
CUTOFF = 0.7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _features(counts: np.ndarray) -> np.ndarray:
    """Per text: 1, then how many windows gain at least each class (log), and which share of all windows that is."""
    upwards = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:].astype(float)
    share = upwards / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.ones((len(counts), 1)), np.log1p(upwards), np.sqrt(share)])


def _calibrate(counts: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights by Newton steps; a sample that is not drawn in proportion is weighed back to the share of toxic labels."""
    x = _features(counts)
    weight = np.where(toxic == 1, share / max((toxic == 1).mean(), 1e-9), (1 - share) / max((toxic == 0).mean(), 1e-9))
    w, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - ridge @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w


class _Packer:
    """Lengths under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = [self._compressor(d) for d in (ordinary, toxic)]
        self.carrier = commonprefix([ordinary[::-1][:CARRIER], toxic[::-1][:CARRIER]])[::-1]  # the end that both share

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            min_match=5, strategy=zstandard.STRATEGY_GREEDY, window_log=14, hash_log=14, chain_log=14, search_log=3, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(content) < 8:
            return zstandard.ZstdCompressor(compression_params=params)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=held)

    def gain(self, piece: bytes) -> int:
        ordinary, toxic = self.pair
        piece = self.carrier + piece
        return len(ordinary.compress(piece)) - len(toxic.compress(piece))

    def classes(self, text: bytes | None) -> np.ndarray:
        """Number of windows of the whole text in each class of gain; class 0 holds the windows that are no suspects."""
        counts = np.zeros(CLASSES, dtype=np.int64)
        data = (text or b"").lower()
        for start in range(0, len(data), STEP):
            window = data[start:start + WINDOW]
            if self.gain(window) < SUSPECT:
                counts[0] += 1
                continue
            words = window.split()
            best = max((self.gain(b" %b " % b" ".join(words[i:i + RUN])) for i in range(max(1, len(words) - RUN + 1))), default=0)
            counts[min(max(best, 0) + 1, CLASSES - 1)] += 1
        return counts


def _words(text: bytes | None) -> Iterator[tuple[int, str]]:
    """Each word of the whole text, between blanks, with a hash of the word before it."""
    before = 0
    for word in (text or b"").lower().decode().split():
        word = word.strip(".,;:!?#$%&*|\"'()[]<>-")
        if word:
            yield before, f" {word} "
            before = zlib.crc32(word.encode())


def _grams_of(word: str) -> list[str]:
    return [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of the sample. Each document names a few words that stand before the gram in it, chosen by hash, so copies name the same ones and a long text counts no more."""
    for batch in batches:
        grams, before, toxic = [], [], []
        for text, label in zip(utf8(batch, "text"), values(batch, "toxic"), strict=True):
            named: dict[str, set[int]] = {}
            for context, word in _words(text):
                for gram in _grams_of(word):
                    named.setdefault(gram, set()).add(context)
            for gram, contexts in named.items():
                some = sorted(contexts)[:CONTEXTS]
                grams += [gram] * len(some)
                before += some
                toxic += [label] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(before, pa.int64()), pa.array(toxic, pa.int32())], ["gram", "before", "toxic"])


def _piece(word: str, grams: frozenset[str]) -> str | None:
    """The part of the word that grams of the set cover, from the first to the last."""
    at = [i for i in range(len(word) - GRAM + 1) if word[i:i + GRAM] in grams]
    return word[at[0]:at[-1] + GRAM] if at else None


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of whole texts, each with a hash to draw them by."""
    for batch in batches:
        found = [t[i:i + WINDOW] for text in utf8(batch, "text") for t in [(text or b"").lower()] for i in range(0, len(t), WINDOW)]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(w) for w in found], pa.int64()), pa.array(found, pa.binary())], ["draw", "window"])


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of a bounded sample: per label value the ``per_class`` ids with the smallest hashes of those that ``learn`` admits.

    The sample is drawn from the labels alone. An id with several labels counts with its largest, one that several documents bear gives one of them
    (the largest text hash), so the sample has at most ``2 * per_class`` rows whatever repeats.
    """
    ids = labels.filter(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias(label))
    draw = lambda v: ids.filter(F.col(label) == v).orderBy(F.xxhash64(F.col(doc_id), F.lit(7)), doc_id).limit(per_class)
    met = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(draw(0).unionByName(draw(1))), doc_id)
    return met.groupBy(doc_id, label).agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("text", label)


def _trained(size: int, samples: list[bytes], **how: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2000, dictionary: int = 8192, part: int = 2048, evidence: float = 25.0,
        odds: float = 3.0, most_grams: int = 4096, most_pieces: int = 50_000, most_windows: int = 50_000) -> Model:
    """Learns from at most ``per_class`` documents of each label among those whose labels row satisfies ``learn``.

    The base is trained on at most ``most_windows`` windows drawn from all of the ordinary sample. A gram tells toxic text where toxic documents name more words before it than their share of all
    such places lets expect: by a likelihood ratio of ``evidence`` and ``odds`` times as often as ordinary ones do (at most ``most_grams``, the strongest). The toxic part is trained on
    the pieces of toxic words that these grams cover, one for each place (at most ``most_pieces``), the ordinary part on as many words of ordinary documents. The trainer
    chooses what the dictionaries hold. Without toxic or without ordinary documents every text scores the share of toxic labels, or 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = checkpointed(training_rows(docs, labels, learn, "toxic", per_class))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_ordinary = totals.get(1, 0), totals.get(0, 0)
    share = labels.filter(learn & F.col("toxic").isNotNull()).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    nothing = np.zeros(2 * CLASSES - 1)
    nothing[0] = math.log(max(share, 1e-4) / max(1 - share, 1e-4))
    if not n_toxic or not n_ordinary:
        return Model(b"", b"", tuple(nothing))

    places = sample.mapInArrow(_grams, "gram string, before bigint, toxic int").groupBy("gram", "before").agg(F.max(F.col("toxic")).alias("t"), F.max(1 - F.col("toxic")).alias("o"))
    places = checkpointed(places.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    all_t, all_o = (float(x or 1) for x in places.agg(F.sum("t"), F.sum("o")).first())
    t, o, expected = F.col("t"), F.col("o"), (F.col("t") + F.col("o")) * (all_t / (all_t + all_o))
    ratio = 2 * (t * F.ln(t / expected) + F.when(o > 0, o * F.ln(o / (t + o - expected))).otherwise(0.0))
    telling = places.filter((t > expected) & (t * all_o >= odds * o * all_t)).withColumn("ratio", F.when(t > 0, ratio)).filter(F.col("ratio") >= evidence)
    grams = frozenset(r["gram"] for r in telling.orderBy(F.col("ratio").desc(), "gram").limit(most_grams).collect())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bytes, int]] = []
            for text, label in zip(utf8(batch, "text"), values(batch, "toxic"), strict=True):
                for before, word in _words(text):
                    piece = _piece(word, grams) if label else word
                    if piece is not None:
                        out.append((zlib.crc32(word.encode(), before), piece.encode(), label))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int32()))], ["draw", "piece", "toxic"])

    found = sample.mapInArrow(pieces, "draw bigint, piece binary, toxic int").distinct()  # a place that copies share is one
    drawn = lambda label, n: [bytes(r["piece"]) for r in found.filter(F.col("toxic") == label).orderBy("draw", "piece").limit(n).collect()] if n else []
    toxic = drawn(1, most_pieces) if grams else []
    ordinary = drawn(0, len(toxic))
    windows = sample.filter("toxic = 0").select("text").mapInArrow(_windows, "draw bigint, window binary").orderBy("draw", "window").limit(most_windows)
    base = _trained(dictionary, [bytes(r["window"]) for r in windows.collect()])
    own = [_trained(part, some, k=64, d=6, steps=1) if some else b"" for some in (ordinary, toxic)]
    equal = min(map(len, own))
    dictionaries = tuple(x[len(x) - equal:] + base for x in own)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(*dictionaries)
        for batch in batches:
            found = [packer.classes(t).tolist() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "toxic"), pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["toxic", "counts"])

    seen = sample.mapInArrow(tally, "toxic int, counts array<bigint>").collect()  # one short row per document of the sample
    weights = _calibrate(np.array([r["counts"] for r in seen]), np.array([r["toxic"] for r in seen]), share)
    return Model(*dictionaries, tuple(float(w) for w in weights))


def _logits(packer: _Packer, weights: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    return _features(np.array([packer.classes(t) for t in texts]).reshape(-1, CLASSES)) @ weights


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row per input row, from the whole text alone. A null or empty text scores like one without suspects. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(model.ordinary, model.toxic)
        weights = np.array(model.weights)
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(_logits(packer, weights, utf8(batch, "text")), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def reject_toxic(docs: DataFrame, model: Model, cutoff: float = CUTOFF, text: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below the cutoff. Each row is judged by its own text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(model.ordinary, model.toxic)
        weights, bound = np.array(model.weights), math.log(cutoff / (1 - cutoff))
        for batch in batches:
            yield batch.filter(pa.array(_logits(packer, weights, utf8(batch, text)) < bound, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
