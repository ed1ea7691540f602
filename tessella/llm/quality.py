"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``width`` bytes are learned as one weight table per offset, so a filter's response is a
sum of table rows chosen by the bytes: no embedding step and no string handling. A document is
covered to its end by chunks that overlap by ``width - 1`` bytes or more; responses pass a ReLU
and are max-pooled over short strips of each chunk. Strip maxima are combined into the document's
largest and mean response of every filter, and a logistic layer turns these into one probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NetParams:
    """Sizes of the network and of its training sample, the only bounded part."""

    filters: int = 16
    width: int = 5
    chunk: int = 8192
    #: Bytes of a strip over which a chunk's responses are pooled.
    strip: int = 128
    #: Labelled documents of each class that are learned from, at most, in order of a hash.
    sample: int = 1500
    #: Bytes of each of them that an epoch sees; the epochs' pieces are spread over the whole text.
    piece: int = 2048
    epochs: int = 8
    rate: float = 0.01
    seed: int = 7


@dataclass
class Net:
    """Learned weights: ``table[offset, byte, filter]``, filter biases, and the last layer."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float


def _strips(data: np.ndarray, net: Net, p: NetParams) -> np.ndarray:
    """Pooled responses of a chunk: one row a strip."""
    n = data.size - p.width + 1
    total = net.table[0].take(data[:n], axis=0)
    for k in range(1, p.width):
        total += net.table[k].take(data[k : n + k], axis=0)
    pooled = np.maximum.reduceat(total, np.arange(0, n, p.strip), axis=0)
    return np.maximum(pooled + net.bias, 0.0)


def _chunks(text: bytes, p: NetParams) -> Iterator[np.ndarray]:
    """Overlapping chunks to the end of the text; short texts are padded with zero bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    if data.size < p.width:
        data = np.concatenate((data, np.zeros(p.width - data.size, np.uint8)))
    step = p.chunk - p.width + 1
    for k in range(0, max(1, data.size - p.width + 1), step):
        yield data[k : k + p.chunk]


def probability(text: bytes, net: Net, p: NetParams) -> float:
    """Probability of label 1 for a whole text."""
    top, total, n = np.zeros(p.filters, np.float32), np.zeros(p.filters, np.float64), 0
    for chunk in _chunks(text, p):
        pooled = _strips(chunk, net, p)
        np.maximum(top, pooled.max(axis=0), out=top)
        total += pooled.sum(axis=0)
        n += pooled.shape[0]
    z = float(np.concatenate((top, total / n)) @ net.out + net.shift)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pieces(text: bytes, p: NetParams) -> list[bytes]:
    """What training sees of a text: the whole if it is short, else a piece for each epoch, spread over it.

    Starts are drawn from even parts of the text, by its checksum, so the pieces reach its end.
    """
    if len(text) <= p.piece:
        return [text]
    rng = np.random.default_rng(zlib.crc32(text))
    room = len(text) - p.piece + 1
    starts = ((np.arange(p.epochs) + rng.random(p.epochs)) * room / p.epochs).astype(int)
    return [text[s : s + p.piece] for s in rng.permutation(starts)]


def train(texts: list[bytes | list[bytes]], labels: list[int], odds: float = 1.0, p: NetParams = NetParams()) -> Net:
    """Adam on the logistic loss; deterministic for a given input.

    Classes count the same while learning; ``odds`` (label 1 to label 0, among all labels) then
    shift the last layer, so that a text that shows nothing gets the share of label 1. A text is
    given whole or as the pieces that the epochs take in turn.
    """
    texts = [pieces(t, p) if isinstance(t, bytes) else t for t in texts]
    rng = np.random.default_rng(p.seed)
    weights = {
        "table": rng.normal(0, 0.3, (p.width, 256, p.filters)).astype(np.float32),
        "bias": np.zeros(p.filters, np.float32),
        "out": rng.normal(0, 0.3, 2 * p.filters).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    y = np.array(labels, dtype=np.float32)
    if not y.size or y.min() == y.max():  # nothing to tell apart
        known = 0.5 if not y.size else float(y[0])
        return Net(weights["table"] * 0, weights["bias"], weights["out"] * 0, float(np.clip(known * 8 - 4, -4, 4)))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step, batch = 0, 32
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs) + p.rate / 20
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            grads = {k: np.zeros_like(v) for k, v in weights.items()}
            chosen = order[lo : lo + batch]
            for i in chosen:
                _learn(texts[i][epoch % len(texts[i])], y[i], balance[i] / len(chosen), weights, grads, p)
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Net(weights["table"], weights["bias"], weights["out"], float(weights["shift"][0]) + float(np.log(odds)))


def _learn(text: bytes, y: float, weight: float, w: dict, grads: dict, p: NetParams) -> None:
    """Add one document's gradient."""
    data = np.frombuffer(text, dtype=np.uint8)
    if data.size < p.width:
        data = np.concatenate((data, np.zeros(p.width - data.size, np.uint8)))
    n = data.size - p.width + 1
    total = sum(w["table"][k].take(data[k : n + k], axis=0) for k in range(p.width))
    edges = np.arange(0, n, p.strip)
    where = np.stack([total[a : a + p.strip].argmax(axis=0) + a for a in edges])
    cols = np.arange(p.filters)
    pooled = total[where, cols] + w["bias"]
    live = pooled > 0
    pooled = np.where(live, pooled, 0)
    best = pooled.argmax(axis=0)
    features = np.concatenate((pooled[best, cols], pooled.mean(axis=0)))
    z = float(np.clip(features @ w["out"] + w["shift"][0], -30, 30))
    error = weight * (1 / (1 + np.exp(-z)) - y)
    grads["out"] += error * features
    grads["shift"] += error
    back = np.repeat(error * w["out"][None, p.filters :] / len(edges), len(edges), axis=0)
    back[best, cols] += error * w["out"][: p.filters]
    back = np.where(live, back, 0)
    grads["bias"] += back.sum(axis=0)
    for k in range(p.width):
        np.add.at(grads["table"][k], (data[where + k], cols), back)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from; a null id has no number and is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams()) -> Net:
    """Train on at most ``p.sample`` documents of each class among those not held out.

    Ids are chosen by a hash from the labels alone; only then are their texts fetched, cut to
    ``p.epochs`` pieces of ``p.piece`` bytes before they leave the executors: 16 KB a document with
    the default parameters, however long it is. Of rows that repeat an id, the least text counts;
    a label that is given twice is 1 if either is. Without labels of both classes nothing is learned.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces((t.as_py() or "").encode(), p) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary())), batch.column(2)], names=["doc_id", "pieces", "y"])

    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [rows.where(F.col("y") == y).orderBy(*order).limit(p.sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * p.sample rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = sample.mapInArrow(cut, "doc_id long, pieces array<binary>, y int")
    found = sorted((r["doc_id"], [bytes(x) for x in r["pieces"]], r["y"]) for r in sample.collect())
    shares = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    odds = max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1)
    return train([t for _, t, _ in found], [y for _, _, y in found], odds, p)


def score(docs: DataFrame, net: Net, p: NetParams = NetParams(), into: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``into``, from ``text`` alone.

    Null and empty texts are scored as zero bytes; rows may repeat. All other columns stay; one that
    is named ``into`` already is an error, not replaced. An empty table gives an empty one.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into!r} already")
    base = docs
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{into}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [probability((t.as_py() or "").encode(), net, p) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, into])

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: NetParams = NetParams()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; other columns are ignored.

    Rows that repeat a ``doc_id`` are scored each by itself, and held out or not by their id; rows
    without one are held out. Empty and null texts are scored too; an empty table gives an empty one.
    """
    net = fit(docs, labels, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, net, p)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
