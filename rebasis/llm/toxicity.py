"""Toxicity by compression distance.

Two zstandard dictionaries: the ordinary one is trained on windows of ordinary text; the
toxic one is not trained but raw content: a list of segments that toxic text has and ordinary text
has not, followed by the ordinary one. A window is compressed with both. Since what both hold lies at equal distances,
the lengths differ by what only toxic text explains: the compression distance.

Toxic segments are the words and word pairs whose document frequencies differ between
the classes: at least four times as frequent, by a z-value of at least 5 and a third of the
highest. They are counted over all labelled documents, on the executors.

A document's features are the share, number and largest distance of its windows beyond
a calibrated distance, the one that separates the training documents best; a logistic
regression of them is the score. Calibration and the ordinary dictionary read at most
``max_labels`` labelled documents, the first by a hash of their id; windows cover whole texts.

Null and empty texts are one empty window of distance 0. Null labels are no labels; of
several labels of a document the highest counts. Without labels or with one class
only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import small, stored, text_words
from rebasis.llm.quality_model import labelled, sigmoid

WINDOW = 64
LEVEL = 3
DICTIONARY = 2048
MAX_LABELS = 8_000
SEGMENTS = 256
TRAIN_WINDOWS = 20_000
MIN_DOCS, MIN_RATIO, MIN_Z = 3, 4.0, 5.0


def windows(text: bytes | None, width: int = WINDOW) -> list[bytes]:
    """The lower-case text with single spaces, cut before the first word that starts beyond ``width``."""
    words = (text or b"").lower().split()
    if not words:
        return [b""]
    line = b" " + b" ".join(words) + b" "
    out, at = [], 0
    while at < len(line) - 1:
        to = line.find(b" ", at + width)
        to = len(line) - 1 if to < 0 else to
        out.append(line[at: to + 1])  # the space at a cut belongs to both windows
        at = to
    return out


def parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False,
        write_dict_id=False)


class Distance:
    """Compressed length with the ordinary dictionary, less that with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.pair = []
        for raw in (ordinary, toxic + ordinary):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters())
            self.pair.append(zstandard.ZstdCompressor(compression_params=parameters(), dict_data=d).compress)

    def __call__(self, text: bytes | None) -> np.ndarray:
        a, b = self.pair
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)])


def features(distances: np.ndarray, bar: int) -> list[float]:
    far = distances >= bar
    n = int(far.sum())
    return [n / len(distances), math.log1p(n), float(min(max(distances.max(), 0), 12)) / 12]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    bar: int
    weights: np.ndarray  # of the features; the last is the bias


def toxic_segments(rows: DataFrame) -> list[bytes]:
    """Words and pairs of (text, y) rows that mark label 1, by their z-value, most telling last."""
    words = rows.select("y", text_words(F.lower(F.col("text").cast("string"))).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(
        F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = float(totals.n1), float(totals.n - totals.n1)
    if not n1 or not n0:
        return []
    found = words.select("y", F.explode(F.array_distinct(F.concat("w", pairs))).alias("segment"))
    # only what toxic text has often enough is looked for in ordinary text
    ones = stored(found.where("y = 1").groupBy("segment").agg(F.count("*").alias("a")).where(F.col("a") >= MIN_DOCS), "segments")
    zeros = found.where("y = 0").join(small(ones.select("segment"), ones.count()), "segment").groupBy("segment").agg(
        F.count("*").alias("b0"))
    counts = ones.join(zeros, "segment", "left").withColumn("b", F.coalesce("b0", F.lit(0)))
    pa_, pb = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    both = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (pa_ - pb) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    best = (
        counts.where(pa_ > MIN_RATIO * pb).select("segment", z.alias("z")).where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "segment").limit(SEGMENTS).collect()  # the dictionary's size
    )
    return [r.segment.encode() for r in reversed(best) if r.z >= best[0].z / 3]


def ordinary_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on ordinary windows, evenly spaced over all of them; raw content if there are too few."""
    cut = [w for t in texts for w in windows(t) if len(w) >= 16]
    cut = cut[:: max(1, len(cut) // TRAIN_WINDOWS)]
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[:size]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def calibrate(distances: list[np.ndarray], y: np.ndarray) -> tuple[int, np.ndarray]:
    """The distance and the weights with the least logistic loss on the training documents."""
    best = None
    for bar in range(2, 9):
        x = np.array([features(d, bar) for d in distances])
        w = logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0] - 1e-9:
            best = loss, bar, w
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, column: str = "toxic", max_labels: int = MAX_LABELS) -> Model:
    """Dictionaries and calibration from labelled documents where ``learnable`` (a condition on doc_id) holds."""
    segments = toxic_segments(labelled(docs, labels, column, learnable))
    rows = labelled(docs, labels, column, learnable, max_labels).toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or b""))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return Model(b"", b"", 1, np.array([0.0, 0.0, 0.0, math.log(share / (1 - share))]))
    ordinary = ordinary_dictionary([r["text"] for r in rows if not r["y"]])
    toxic = b" " + b" ".join(segments) + b" " if segments else b""
    measure = Distance(toxic, ordinary)
    bar, weights = calibrate([measure(r["text"]) for r in rows], y)
    return Model(toxic, ordinary, bar, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the model of a few kB goes along with the tasks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    toxic, ordinary, bar, weights = model.toxic, model.ordinary, model.bar, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Distance(toxic, ordinary)
        for batch in batches:
            found = []
            for t in batch.column("text"):
                x = features(measure(t.as_py()), bar) if toxic else [0.0, 0.0, 0.0]
                found.append(sigmoid(float(weights[:-1] @ x) + float(weights[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
