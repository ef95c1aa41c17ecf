"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, gated attention weighs the passages, and the weighted
sum is scored. Only documents are labelled; the attention learns which passages matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import small_batches, utf8, values
from tradelens.llm.ngrams import passages
from tradelens.llm.toxicity import training_rows

#: Bytes of a passage, its n-grams and slots, and the width of the encoding.
PASSAGE, SIZES, BITS, WIDTH = 512, (1, 2), 9, 16
CUTOFF = 0.7


@dataclass(frozen=True)
class Model:
    """Parameters by name, or only a prior where nothing could be learnt."""

    params: dict[str, np.ndarray]
    prior: float


def _encode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ p["encode"] + p["encode0"])


def _forward(p: dict[str, np.ndarray], h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """h: encoded passages of all bags one after another; bag i begins at starts[i] and has sizes[i] of them."""
    open_, gate = np.tanh(h @ p["attend"]), 1 / (1 + np.exp(-(h @ p["gate"])))
    raw = (open_ * gate) @ p["pick"]
    top = np.maximum.reduceat(raw, starts)
    e = np.exp(raw - np.repeat(top, sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    logit = z @ p["score"] + p["score0"]
    return {"h": h, "open": open_, "gate": gate, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(p, _encode(p, x), starts, sizes)
    d_logit = weight * (f["p"] - y) / weight.sum()
    d_z = np.repeat(d_logit, sizes)[:, None] * p["score"]
    d_a = (d_z * f["h"]).sum(axis=1)
    d_raw = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, starts), sizes))
    both = f["open"] * f["gate"]
    d_open = d_raw[:, None] * p["pick"] * f["gate"] * (1 - f["open"] ** 2)
    d_gate = d_raw[:, None] * p["pick"] * both * (1 - f["gate"])
    d_h = f["a"][:, None] * d_z + d_open @ p["attend"].T + d_gate @ p["gate"].T
    d_in = d_h * (1 - f["h"] ** 2)
    return {"encode": x.T @ d_in, "encode0": d_in.sum(axis=0), "attend": f["h"].T @ d_open, "gate": f["h"].T @ d_gate, "pick": both.T @ d_raw,
            "score": f["z"].T @ d_logit, "score0": d_logit.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, ridge: float = 1e-4,
          seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of bags."""
    rng, slots = np.random.default_rng(seed), 1 << BITS
    p = {"encode": rng.normal(0, 1.0, (slots, WIDTH)), "encode0": np.zeros(WIDTH), "attend": rng.normal(0, 0.3, (WIDTH, WIDTH)),
         "gate": rng.normal(0, 0.3, (WIDTH, WIDTH)), "pick": rng.normal(0, 0.3, WIDTH), "score": rng.normal(0, 0.3, WIDTH), "score0": np.zeros(())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for some in (order[i:i + batch] for i in range(0, len(order), batch)):
            sizes = np.array([len(bags[i]) for i in some])
            x = np.concatenate([bags[i] for i in some]).astype(np.float32)
            t += 1
            for k, g in _gradients(p, x, np.cumsum(sizes) - sizes, sizes, y[some], weight[some]).items():
                g = g + ridge * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500, longest: int = 40_000) -> Model:
    """Learns from at most ``per_class`` documents of each label, whole ones of at most ``longest`` code points.

    The sample is weighed back to the shares of the labels. With labels of one kind only, or none, every text scores their share, or 0.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(docs.filter(F.length("text") <= longest), labels, learn, "quality", per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.concatenate(list(passages(t, PASSAGE, SIZES, BITS))).astype(np.float16).tobytes() for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(values(b, "quality"), pa.int32()), pa.array(found, pa.binary())], ["quality", "vectors"])

    taught = sample.mapInArrow(features, "quality int, vectors binary").collect()
    share = labels.filter(learn & F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    prior = min(max(share, 1e-4), 1 - 1e-4)
    y = np.array([r["quality"] for r in taught], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model({}, prior)
    bags = [np.frombuffer(r["vectors"], dtype=np.float16).reshape(-1, 1 << BITS) for r in taught]
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)
    return Model(train(bags, y, weight), prior)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, top_passage: one row per input row, from the whole text alone; top_passage has the largest attention. No shuffle.

    A null or empty text is one empty passage.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, top = [], []
            for t in utf8(batch, "text"):
                if not model.params:
                    score.append(model.prior), top.append(0)
                    continue
                h = np.concatenate([_encode(model.params, x) for x in passages(t, PASSAGE, SIZES, BITS)])
                f = _forward(model.params, h, np.array([0]), np.array([len(h)]))
                score.append(float(f["p"][0])), top.append(int(f["a"].argmax()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(top, pa.int64())], ["doc_id", "score", "top_passage"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, top_passage bigint")
