"""Language identification with error-correcting output codes.

Each language has a codeword. One linear classifier per bit reads the hashed byte n-grams of a text. The codeword with
the least weighted loss is the answer; a close second makes it ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import small_batches, utf8, values
from tradelens.llm.ngrams import counts, unit

SIZES, BITS = (2, 3), 12
UNKNOWN, MARGIN, PARTS = "und", 0.5, 64


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # slots x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit when decoding


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1 and 1. Few languages get every split of them into two sides, many get random bits, the best of some draws."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 6:
        splits = [[1] + [1 if b >> k & 1 else -1 for k in range(n - 1)] for b in range((1 << n - 1) - 1)]
        return np.array(splits, dtype=np.float32).T
    rng, bits = np.random.default_rng(seed), max(24, 10 * int(np.ceil(np.log2(n))))
    draws = [rng.choice([-1.0, 1.0], size=(n, bits)) for _ in range(64)]
    gap = lambda c: (c @ c.T - bits * np.eye(n) * 2).max()  # noqa: E731  the most alike pair
    return min(draws, key=gap).astype(np.float32)


def train_bits(x: np.ndarray, signs: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once, by Adam on the whole sample."""
    w, b = np.zeros((x.shape[1], signs.shape[1]), np.float32), np.zeros(signs.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        pull = -signs / (1 + np.exp(np.clip(signs * (x @ w + b), -30, 30))) / len(x)
        for k, (p, g) in enumerate(((w, x.T @ pull + ridge * w), (b, pull.sum(axis=0)))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            p -= rate * (state[2 * k] / (1 - 0.9 ** t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999 ** t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, learn: Column, per_language: int = 320, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_languages: int = 256) -> Model:
    """Learns from at most ``per_language`` documents of each language (a multiple of PARTS) among those that ``learn`` admits and whose text has a letter.

    At most ``most_languages`` languages are learnt, those with the most documents (of equals the first by name), so the sample has at most ``most_languages * per_language`` rows and as
    many places of each part of a language. An id that several documents of a language bear gives one of them (the largest text hash).
    Languages and texts that are null are left out. Without any such document there is no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang")).filter(learn & F.col("lang").isNotNull())
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    rows = rows.join(F.broadcast(common), "lang")
    # each of PARTS parts of a language gives its smallest hashes, so that no task reads a whole language
    rows = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(3))).withColumn("part", F.pmod("draw", F.lit(PARTS)))
    spot = F.row_number().over(Window.partitionBy("lang", "part").orderBy("draw", "doc_id"))
    drawn = rows.withColumn("n", spot).filter(F.col("n") <= -(-per_language // PARTS))
    ids = drawn.select("doc_id", "lang").distinct()  # about per_language rows a language at most
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").rlike(r"\p{L}")).join(
        F.broadcast(ids), ["doc_id", "lang"])
    sample = met.groupBy("doc_id", "lang").agg(F.max_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit(counts(t, SIZES, BITS)).astype(np.float16).tobytes() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "lang"), pa.string()), pa.array(found, pa.binary())], ["lang", "vector"])

    taught = sample.select("text", "lang").mapInArrow(features, "lang string, vector binary").collect()
    languages = tuple(sorted({r["lang"] for r in taught}))
    codes = codebook(len(languages))
    if not languages:
        return Model((), codes, np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    x = np.stack([np.frombuffer(r["vector"], dtype=np.float16) for r in taught]).astype(np.float32)
    y = np.array([languages.index(r["lang"]) for r in taught])
    signs = codes[y]
    # a fifth of the sample tells how far each bit can be trusted; then all of it trains
    held = np.arange(len(y)) % 5 == 0
    trust = np.ones(codes.shape[1], np.float32)
    if held.any() and (~held).any():
        w, b = train_bits(x[~held], signs[~held])
        right = ((x[held] @ w + b) * signs[held] > 0).mean(axis=0).clip(0.5, 0.999)
        trust = np.log(right / (1 - right) + 0.1).clip(0.1).astype(np.float32)
    w, b = train_bits(x, signs)
    return Model(languages, codes, w, b, trust / trust.sum() * len(trust))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its probability among all, and the distance to the next."""
    margins = x @ model.weights + model.bias
    loss = np.stack([(np.logaddexp(0, -margins * code) * model.trust).sum(axis=1) for code in model.codes], axis=1)
    best = loss.argmin(axis=1)
    ranked = np.sort(loss, axis=1)
    share = 1 / np.exp(ranked[:, :1] - ranked).sum(axis=1)
    gap = ranked[:, 1] - ranked[:, 0] if ranked.shape[1] > 1 else np.full(len(x), np.inf)
    return best, share, gap


def identify(docs: DataFrame, model: Model, margin: float = MARGIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous: one row per input row, from the whole text alone. No shuffle.

    A null text, one without a letter, or any text where no language was learnt, gets ``und`` with score 0 and is ambiguous.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = utf8(batch, "text"), values(batch, "letters")
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            known = [i for i, has in enumerate(letters) if has and model.languages]
            if known:
                x = np.stack([unit(counts(texts[i], SIZES, BITS)) for i in known])
                for i, best, share, gap in zip(known, *decode(model, x), strict=True):
                    lang[i], score[i], unsure[i] = model.languages[best], share, gap < margin
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
