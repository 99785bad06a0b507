"""Quality classifier by compression under two Zstandard dictionaries (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what is fitted on: labelled rows of each class for a dictionary and for the calibration, and bytes of a text used so.
DICTIONARY_ROWS, CALIBRATION_ROWS, TRAINING_BYTES = 1000, 3000, 1 << 16
DICTIONARY_BYTES, LEVEL = 112 << 10, 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of either class and the weights of the calibration."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """text bytes -> features; one compressor of each kind, for one task."""
        sides = []
        for data in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        good, bad = (s.compress for s in sides)
        return lambda x: features(len(good(x)), len(bad(x)), len(x))


def features(good: int, bad: int, size: int) -> tuple[float, float, float]:
    """The compressed-size difference per byte, alone and against the text's length."""
    d = (bad - good) / max(size, 1)
    return d, d * np.log1p(size), float(np.log1p(size))


def probability(x: np.ndarray, weights) -> np.ndarray:
    w = np.asarray(weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Weights (constant first) of a logistic regression, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = probability(x, w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labels: DataFrame, label: str, value: int, rows: int, skip: int = 0) -> list[bytes]:
    """Whole labelled texts of one class up to TRAINING_BYTES long: the `rows` first by a hash of doc_id, after `skip`."""
    ids = labels.filter(F.col(label) == value).groupBy("doc_id").agg(F.xxhash64("doc_id").alias("_order"))
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAINING_BYTES) & (F.length("text") > 0))
    # Long texts leave less than `rows` of the chosen ids, never more.
    chosen = ids.orderBy("_order", "doc_id").limit(rows + skip)
    found = texts.join(F.broadcast(chosen), "doc_id").orderBy("_order", "doc_id").select("text").collect()
    return [r.text.encode() for r in found[skip:]]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> CompressionModel:
    """Fit on bounded samples of labelled rows: other rows make the dictionaries than make the calibration.

    Without rows of either class the dictionaries are empty and every score is the share of label 1
    (a half without any label).
    """
    kept = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    good, bad = (sample(docs, kept, label, v, DICTIONARY_ROWS + CALIBRATION_ROWS) for v in (1, 0))
    parts = [(x[: len(x) // 4], x[len(x) // 4 :]) for x in (good, bad)]
    dicts = [_dictionary(p[0]) for p in parts]
    model = CompressionModel(dicts[0], dicts[1], ())
    score = model.scorer()
    x = np.array([score(t) for p in parts for t in p[1]] or np.zeros((0, 3)), float).reshape(-1, 3)
    y = np.concatenate([np.full(len(p[1]), v, float) for p, v in zip(parts, (1, 0), strict=True)])
    counts = {r[label]: r["count"] for r in kept.groupBy(label).count().collect()}
    if len(set(y)) < 2:
        prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return CompressionModel(dicts[0], dicts[1], (float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0))
    w = list(logistic(x, y))
    # The two classes were sampled alike; the constant is moved to their true shares.
    w[0] += float(np.log(max(counts[1], 1) / max(counts[0], 1)) - np.log(y.sum() / (len(y) - y.sum())))
    return CompressionModel(dicts[0], dicts[1], tuple(w))


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(texts)[-DICTIONARY_BYTES:]


def quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a column `out` more: how likely label 1 is for the whole text, 0 to 1.

    Null and empty texts get the score of a text of no bytes; equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = sent.value.scorer()
        for texts in batches:
            x = np.array([one((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts], float).reshape(-1, 3)
            yield pa.array(probability(x, sent.value.weights), pa.float64())

    return docs.withColumn(out, F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")))
