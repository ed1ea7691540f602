"""Three-class text scores behind one interface, with the columns derived from them.

No pretrained network is available offline. The default scorer is a documented lexicon in plain
expressions; any other model comes in as a batch function (:func:`score_batches`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.stats import cumulated

LABELS = ["NEG", "NEU", "POS"]
#: Words that count for the outer classes.
NEGATIVE = ("bad", "clown", "disgusting", "hate", "horrible", "idiot", "idiotic", "loser", "malo", "moron", "odio", "peor", "pathetic", "scum", "stupid", "terrible", "trash", "worthless")
POSITIVE = ("amo", "best", "bien", "bueno", "excelente", "excellent", "genial", "good", "gracias", "great", "happy", "like", "love", "mejor", "nice", "thanks", "wonderful")


def lexicon_scores(text: Column) -> tuple[Column, Column, Column]:
    """Probabilities of the classes: softmax of one and a half a hit, of which all count, and half for the middle."""
    # A hit is a part between white space that is a word of the lexicon once signs and digits at its ends are off.
    found = rf"(?U)(?<!\S)[^\p{{L}}\s]*({'|'.join(sorted({*NEGATIVE, *POSITIVE}))})[^\p{{L}}\s]*(?!\S)"
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(found), F.lit(1))
    hits = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    raw = (1.5 * hits(NEGATIVE), F.lit(0.5), 1.5 * hits(POSITIVE))
    top = F.greatest(*raw)  # no exponent is above 0, so none overflows
    total = F.exp(raw[0] - top) + F.exp(raw[1] - top) + F.exp(raw[2] - top)
    return tuple(F.round(F.exp(r - top) / total, 6) for r in raw)


def score_texts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with lexicon probabilities and the derived columns."""
    return enriched(df.withColumns({f"prob_{k}": p for k, p in zip(LABELS, lexicon_scores(F.col(text)), strict=True)}))


def score_batches(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]], batch: int = 32) -> DataFrame:
    """``df`` with the probabilities of a model that ``load`` brings up once a task, and the derived columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            found = [row for k in range(0, len(texts), batch) for row in model(texts[k : k + batch])]
            for i, label in enumerate(LABELS):
                pdf[f"prob_{label}"] = [round(float(row[i]), 6) for row in found]
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return enriched(df.mapInPandas(run, fields + "".join(f", prob_{x} double" for x in LABELS)))


def enriched(df: DataFrame) -> DataFrame:
    """Label (ties to the earlier class), confidence, margin, entropy and a mark below one half."""
    p = [F.col(f"prob_{x}") for x in LABELS]
    top = F.greatest(*p)
    second = F.element_at(F.sort_array(F.array(*p), asc=False), 2)
    label = F.when(p[0] == top, LABELS[0]).when(p[1] == top, LABELS[1]).otherwise(LABELS[2])
    entropy = -sum((F.when(x > 0, x * F.log(x)).otherwise(0.0) for x in p), F.lit(0.0))
    return df.withColumns({"predicted": label, "confidence": top, "margin": F.round(top - second, 6), "entropy": F.round(entropy, 6), "low_confidence": top < 0.5})


def label_distribution(df: DataFrame) -> DataFrame:
    """``label, n, pct, mean_confidence, median_confidence`` of every class, in the classes' order."""
    counts = df.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.median("confidence"), 4).alias("median_confidence"))
    known = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "place int, label string")
    out = known.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("place", "label", "n", F.round(100 * F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 2).alias("pct"), "mean_confidence", "median_confidence")


def representative_examples(df: DataFrame, key: str) -> DataFrame:
    """The most, middle and least confident text of each class, named by place; ties by key.

    Places are running counts over one order of all texts, which is cut into ranges where it is
    long, so a class is not one task.
    """
    rows = df.groupBy(F.struct("predicted", (-F.col("confidence")).alias("c"), F.col(key).alias("key")).alias("k")).agg(F.count("*").alias("m"))
    placed = cumulated(rows, "k", "m", "up").select("k.*", "m", "up")
    sizes = df.groupBy("predicted").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("predicted").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a class
    placed = placed.join(sizes.withColumn("base", before), "predicted").withColumn("r", F.col("up") - F.col("base"))
    holds = lambda place: (place <= F.col("r")) & (place > F.col("r") - F.col("m"))
    kind = F.when(holds(F.lit(1)), "highest").when(holds(F.col("n")), "lowest").when(holds(F.floor(F.col("n") / 2) + 1), "middle")
    return placed.withColumn("kind", kind).where("kind is not null").select(F.col("key").alias(key), "predicted", "kind", (-F.col("c")).alias("confidence"))
