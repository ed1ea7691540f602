"""The text model against plain loops."""

import math
import random
from zlib import crc32

import numpy as np
import pytest

from tessella.operators import scoring, text_model

P = text_model.ModelParams(buckets=64, rounds=12)
WORDS = {"NEG": ["awful", "bad", "rain"], "NEU": ["table", "Tuesday", "rain"], "POS": ["good", "sunny", "fine"]}


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[y]) for _ in range(rng.randrange(1, 9))), y) for i in range(n) for y in [rng.choice(scoring.LABELS)]]


def by_loops(data, p):
    """Weights by plain gradient descent, one text after the other."""
    def vector(text):
        x = np.zeros(p.buckets + 1)
        for w in text.lower().split():
            x[crc32(w.encode()) % p.buckets] += 1
        x /= max(math.sqrt((x * x).sum()), 1e-300)
        x[-1] = 1
        return x

    xs, ys = [vector(t) for _, t, _ in data], [scoring.LABELS.index(y) for *_, y in data]
    w = speed = np.zeros((3, p.buckets + 1))
    for _ in range(p.rounds):
        ahead, g = w + p.momentum * speed, np.zeros_like(w)
        for x, y in zip(xs, ys, strict=True):
            e = np.exp(ahead @ x - (ahead @ x).max())
            off = e / e.sum()
            off[y] -= 1
            g += np.outer(off, x)
        speed = p.momentum * speed - p.rate * g / len(xs)
        w = w + speed
    return w, vector


def test_model_equals_loops(spark):
    data = rows(1, 120)
    df = spark.createDataFrame([*data, (900, "unlabelled", None), (901, "odd label", "X")], "doc_id long, text string, y string")
    weights = text_model.fit(df, "text", "y", P)
    want, vector = by_loops(data, P)
    assert np.abs(weights - want).max() < 1e-9
    fresh = [*rows(2, 50), (70, None, "NEU"), (71, "", "NEU"), (72, "good " * 20000, "POS")]
    got = {r["doc_id"]: r for r in text_model.predict(spark.createDataFrame(fresh, "doc_id long, text string, y string"), "text", weights, P).collect()}
    for i, text, _ in fresh:
        e = np.exp(want @ vector(text or ""))
        assert [got[i][f"prob_{x}"] for x in scoring.LABELS] == pytest.approx(list(e / e.sum()), abs=1e-6)
    assert sum(got[i]["predicted"] == y for i, t, y in fresh[:50]) > 40 and got[72]["predicted"] == "POS"


def test_metadata_is_complete(spark):
    df = spark.createDataFrame(rows(3, 70), "doc_id long, text string, y string")
    weights = text_model.fit(df, "text", "y", P)
    m = text_model.metadata(df, "text", weights, P).first()
    assert (m["n_classes"], m["n_parameters"], m["n_texts"], m["least_batches"], m["batch"]) == (3, 195, 70, 3, 32)
    assert all(v is not None for v in m) and m["seconds"] > 0 and m["texts_per_second"] > 0


def test_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, y string")
    weights = text_model.fit(none, "text", "y", P)
    assert not weights.any() and text_model.predict(none, "text", weights, P).count() == 0
    assert text_model.metadata(none, "text", weights, P).first()["n_texts"] == 0
