"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features: words and word pairs of the lower-case text, hashed into ``2^bits``
slots with value log(1 + count), scaled to length 1. A word is a run of letters and digits or
a run of other marks, so that ``the&&&`` shares a feature with ``the``. Nothing but the text is a feature.

Training reads at most ``max_labels`` labelled documents, the first by a hash of their
id, hashes them on the executors and runs the updates on the driver: follow-the-regularised-leader
is sequential, and the bound keeps it small. Weights are ``2^bits`` floats. Every whole text
is then scored as a sparse dot product in Arrow batches.

Null and empty texts have no features and get the score of the bias. Null labels are no
labels; of several labels of a document the highest counts. Without labels, or with one
class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import small

BITS = 18
MAX_LABELS = 6_000
EPOCHS = 3
TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x20\x09-\x0d]+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text."""
    crc = zlib.crc32
    words = np.array([crc(w) for w in TOKENS.findall((text or b"").lower())], np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = (words[:-1] * np.uint64(0x9E3779B1) + words[1:]) * np.uint64(0x9E3779B97F4A7C15)
    ones = words * np.uint64(0x9E3779B97F4A7C15)
    slots, counts = np.unique(np.concatenate([ones, pairs]) >> np.uint64(64 - bits), return_counts=True)
    values = np.log1p(counts)
    return slots.astype(np.int64), values / math.sqrt(float(values @ values))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS,
          alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> Model:
    """FTRL-proximal over the rows in order, ``epochs`` times; the bias is a feature without penalty."""
    n = 1 << bits
    positive = sum(y for *_, y in rows)
    if positive in (0, len(rows)):
        share = (positive + 0.5) / (len(rows) + 1)
        return Model(np.zeros(n, np.float32), math.log(share / (1 - share)), bits)
    z, g2, bias_z, bias_g2 = np.zeros(n), np.zeros(n), 0.0, 0.0

    def current(z, g2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))

    for _ in range(epochs):
        for slots, values, y in rows:
            zs, gs = z[slots], g2[slots]
            w = current(zs, gs)
            b = -bias_z * alpha / (beta + math.sqrt(bias_g2))
            error = sigmoid(float(w @ values) + b) - y
            g = error * values
            z[slots] = zs + g - (np.sqrt(gs + g * g) - np.sqrt(gs)) / alpha * w
            g2[slots] = gs + g * g
            bias_z += error - (math.sqrt(bias_g2 + error * error) - math.sqrt(bias_g2)) / alpha * b
            bias_g2 += error * error
    return Model(current(z, g2).astype(np.float32), -bias_z * alpha / (beta + math.sqrt(bias_g2)), bits)


def _hasher(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), bits) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())), batch.column("y")],
                ["slots", "values", "y"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, column: str, learnable: Column, limit: int | None = None) -> DataFrame:
    """(doc_id, text, y) of the labelled documents that may be learned from; with a limit the first by hash of id."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(
        F.max(F.col(column).cast("int")).alias("y"))
    if limit is not None:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(small(known, limit or labels.count()), "doc_id").select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, column: str = "quality",
        max_labels: int = MAX_LABELS, bits: int = BITS) -> Model:
    """Train on the labelled documents where ``learnable`` (a condition on doc_id) holds."""
    rows = labelled(docs, labels, column, learnable, max_labels).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).select(
        "text", "y").mapInArrow(_hasher(bits), "slots array<int>, values array<float>, y int").toArrow().combine_chunks()
    if not len(rows):
        return train([], bits)
    lists, values = (rows.column(c).chunk(0) for c in ("slots", "values"))
    slots, values, bounds = lists.values.to_numpy(), values.values.to_numpy(), lists.offsets.to_numpy()
    y = rows.column("y").to_pylist()
    return train([(slots[a:b], values[a:b], k) for a, b, k in zip(bounds, bounds[1:], y)], bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, bits = shared.value
        for batch in batches:
            found = []
            for t in batch.column("text"):
                slots, values = features(t.as_py(), bits)
                found.append(sigmoid(float(weights[slots] @ values) + bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
