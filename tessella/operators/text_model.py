"""A three-class text model fitted and applied in Spark, with its metadata as a relation.

Words are hashed to a fixed number of features; a softmax regression is fitted by gradients that
tasks sum over their rows, so fitting takes all labelled texts and sends one number a feature and
class to the driver each round. Weights go to the tasks once, by broadcast: their size is a parameter.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scoring import LABELS, score_batches
from tessella.scratch import written

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ModelParams:
    buckets: int = 4096
    rounds: int = 30
    rate: float = 4.0
    momentum: float = 0.9
    batch: int = 32


def features(text: str | None, buckets: int) -> tuple[list[int], list[float]]:
    """Hashed words of a whole text, in order of feature, and their counts scaled to length one; null is empty."""
    counts: dict[int, int] = {}
    for word in WORD.findall((text or "").lower()):
        k = crc32(word.encode()) % buckets
        counts[k] = counts.get(k, 0) + 1
    size = sum(n * n for n in counts.values()) ** 0.5
    found = sorted(counts.items())
    return [k for k, _ in found], [n / size for _, n in found]


def _logits(weights: np.ndarray, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A row a text, a column a class; the last weight of a class is its constant."""
    return np.stack([np.bincount(row, weights=w[index] * value, minlength=n) + w[-1] for w in weights], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Class probabilities of a batch of whole texts."""
    found = [features(t, weights.shape[1] - 1) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(i) for i, _ in found])
    index, value = (np.array([x for f in found for x in f[j]], dtype=t) for j, t in ((0, np.int64), (1, np.float64)))
    return softmax(_logits(weights, index, value, row, len(texts)))


def fit(df: DataFrame, text: str, label: str, p: ModelParams = ModelParams()) -> np.ndarray:
    """Weights, a row a class, from all rows whose label is one of the three; gradient descent with momentum from zero.

    Features are written once, and read each round. Without labelled rows all weights are zero, and
    all classes alike.
    """
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col(label)) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, p.buckets) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))], names=["y", "i", "v"])

    rows = df.where(F.col(label).isin(*LABELS)).select(F.col(text).cast("string").alias("t"), place.cast("int").alias("y"))
    rows = written(rows.mapInArrow(hashed, "y int, i array<int>, v array<double>"), "features")
    n, weights = rows.count(), np.zeros((len(LABELS), p.buckets + 1))
    speed = np.zeros_like(weights)

    def gradient(ahead: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(ahead)
            for batch in batches:
                lists = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                index, value = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                off = softmax(_logits(ahead, index, value, row, batch.num_rows))
                off[np.arange(batch.num_rows), batch.column(0).to_numpy()] -= 1
                for c, g in enumerate(total):
                    g[:-1] += np.bincount(index, weights=value * off[row, c], minlength=len(g) - 1)
                    g[-1] += off[:, c].sum()
            c, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k), pa.array(total[c, k])], names=["c", "k", "g"])

        out = np.zeros_like(ahead)
        for r in rows.mapInArrow(run, "c long, k long, g double").groupBy("c", "k").agg(F.sum("g").alias("g")).collect():  # a row a weight at most
            out[r["c"], r["k"]] = r["g"]
        return out / n

    for _ in range(p.rounds if n else 0):
        speed = p.momentum * speed - p.rate * gradient(weights + p.momentum * speed)
        weights = weights + speed
    return weights


def predict(df: DataFrame, text: str, weights: np.ndarray, p: ModelParams = ModelParams()) -> DataFrame:
    """``df`` with class probabilities in batches of whole texts, and the columns derived from them; null texts are empty."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    return score_batches(df, text, lambda: lambda texts: probabilities(texts, shared.value), p.batch)


def metadata(df: DataFrame, text: str, weights: np.ndarray, p: ModelParams = ModelParams()) -> DataFrame:
    """One row about the model and one run of it over ``df``: its size and settings, texts, batches, seconds and texts a second."""
    start = time.perf_counter()
    n = predict(df.select(text), text, weights, p).where("confidence >= 0").count()
    took = time.perf_counter() - start
    row = ("hashed-words softmax", ",".join(LABELS), len(LABELS), weights.size, p.buckets, p.rounds, p.rate, p.momentum, p.batch, n, -(-n // p.batch), round(took, 3), round(n / took, 1), "cpu")
    schema = "model string, labels string, n_classes int, n_parameters long, buckets int, rounds int, rate double, momentum double, batch int, n_texts long, least_batches long, seconds double, texts_per_second double, device string"
    return df.sparkSession.createDataFrame([row], schema)
