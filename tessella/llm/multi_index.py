"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one and cut into two halves, each with its own codebook; the pair of
nearest codewords is a cell of the product grid. Codebooks grow with the square root of the number
of vectors, so a cell keeps its size. For a vector, cells come in order of a lower bound on the
distance of any vector inside (multi-sequence traversal of two sorted lists): the distance to the
plane between the nearest codeword and another one, squared and summed over the halves.

The traversal ends where the target recall is reached: sampled vectors are moved, in directions
drawn at random, just as far as the similarity allows, and the bound that the target share of them
needs, with a margin, is the limit. It never exceeds the distance itself, beyond which no link is
possible. Found pairs are verified by their exact cosine.

Every pair is met once, in the later of its two cells. Cells are cut into blocks of bounded size;
blocks of visiting and of resident vectors meet one by one, and give the number of links of each
vector and a spanning forest of the block's links. Equal vectors are one class throughout.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import connected_components, written


#: Numbers in an array of distances between rows and codewords.
CELLS = 1 << 20


@dataclass(frozen=True)
class IndexParams:
    """``cosine``: the least similarity of a link; ``block`` rows a block."""

    cosine: float = 0.98
    #: Vectors of one label in a cell on average, from which the codebooks' sizes follow; and their bound.
    per_cell: int = 64
    most_codewords: int = 4096
    #: Vectors that the codebooks are fitted on, at most, in order of a hash: eight a codeword.
    sample: int = 32_768
    rounds: int = 12
    #: Share of neighbours at the least similarity that the traversal must reach, and the factor on its limit.
    recall: float = 0.9999
    margin: float = 2.0
    block: int = 1024

    def codewords(self, rows: float) -> int:
        return max(min(int((rows / self.per_cell) ** 0.5), self.most_codewords, self.sample // 8), 4)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codebook(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; deterministic."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    words = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)
        n = np.bincount(near, minlength=len(words))[:, None]
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return np.unique(words, axis=0)


def _blocks(rows: int, words: int) -> Iterator[slice]:
    """Rows in blocks whose distances from all codewords are ``CELLS`` numbers at most."""
    step = max(CELLS // max(words, 1), 1)
    return (slice(k, k + step) for k in range(0, rows, step))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[k], words).argmin(axis=1) for k in _blocks(len(x), len(words))])


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None]


def _margins(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword, and the squared distance to its border with every other codeword."""
    d = _squares(x, words)
    near = d.argmin(axis=1)
    between = np.sqrt(np.maximum(_squares(words, words), 1e-18))[near]
    m = (d - d[np.arange(len(x)), near][:, None]) / (2 * between)
    m[np.arange(len(x)), near] = 0
    return near, np.maximum(m, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells in order of ``first[i] + second[j]`` while that is at most ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, seen = [(first[a[0]] + second[b[0]], 0, 0)], [], {(0, 0)}
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for ni, nj in ((i + 1, j), (i, j + 1)):
            if ni < len(a) and nj < len(b) and (ni, nj) not in seen:
                seen.add((ni, nj))
                heapq.heappush(heap, (first[a[ni]] + second[b[nj]], ni, nj))
    return out


def _limit(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], p: IndexParams, seed: int = 11) -> float:
    """The bound up to which the traversal reaches the target recall, measured on moved vectors."""
    reach = 2 - 2 * p.cosine + 1e-9
    rng = np.random.default_rng(seed)
    x = x[rng.integers(0, len(x), 20_000)]
    away = rng.normal(size=x.shape)
    away = away - (away * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    moved = p.cosine * x + (1 - p.cosine**2) ** 0.5 * away / np.where(size > 0, size, 1)
    half, total = x.shape[1] // 2, np.zeros(len(x))
    for part, words in zip((slice(None, half), slice(half, None)), books, strict=True):
        for k in _blocks(len(x), len(words)):
            cell = _squares(moved[k, part], words).argmin(axis=1)
            total[k] += _margins(x[k, part], words)[1][np.arange(len(cell)), cell]
    return float(min(np.quantile(total, p.recall) * p.margin, reach))


def link_vectors(rows: DataFrame, p: IndexParams = IndexParams()) -> DataFrame:
    """Links between vectors of equal label with a cosine of ``p.cosine`` or more.

    ``rows(vec_id, embedding, label)``; other columns are ignored. Returns one row per input row:
    ``vec_id, n_links, component_id, kept``. Vectors that are null, zero, hold null or non-finite
    components, or have no label link with nothing; so do vectors of different lengths with one
    another. Equal vectors link. Rows that repeat a ``vec_id`` count as vectors of their own; rows
    without ``vec_id`` can't be named and stand alone. An empty table gives an empty one.
    """
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    kept = "float" if kind == "float" else "double"  # single precision travels as such
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kept}>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    keyed = base.where(good).withColumn("h", F.xxhash64("label", "v"))
    classes = keyed.groupBy("label", "h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # A number of its own for each class, as vec_id may repeat; it stays in the written table.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    # The size of the label of an average row: labels share a grid, but no cell.
    sizes = classes.groupBy("label").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s"), F.sum("k").alias("n")).first()
    words = p.codewords(sizes["s"] / sizes["n"] if sizes["n"] else 0)
    picked = classes.orderBy(F.xxhash64("h", "least"), "least", "h").limit(8 * words).select("v").collect()
    books, limits = {}, {}
    for size in sorted({len(r["v"]) for r in picked}):
        x = _unit(np.array([r["v"] for r in picked if len(r["v"]) == size], dtype=np.float64))
        books[size] = tuple(_codebook(part, words, p.rounds) for part in (x[:, : size // 2], x[:, size // 2 :]))
        limits[size] = _limit(x, books[size], p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row where a vector lives and one for each cell it visits, its own and later ones."""
        for batch in batches:
            table = batch.to_pydict()
            out: list[list] = [[], [], [], []]
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(table["v"]):
                by_size.setdefault(len(v), []).append(k)
            for size, at in by_size.items():
                # A length that the sample lacks has a grid of one cell.
                one, two = books.get(size, (np.zeros((1, size // 2)), np.zeros((1, size - size // 2))))
                for block in _blocks(len(at), len(one) + len(two)):
                    here = at[block]
                    x = _unit(np.array([table["v"][k] for k in here], dtype=np.float64))
                    (near, first), (close, second) = _margins(x[:, : size // 2], one), _margins(x[:, size // 2 :], two)
                    for row, k in enumerate(here):
                        own = (int(near[row]), int(close[row]))
                        cells = [c for c in traverse(first[row], second[row], limits.get(size, 0.0)) if c >= own]
                        for (i, j), home in [(own, True), *((c, False) for c in cells)]:
                            for into, value in zip(out, (table["rep"][k], f"{size}:{i}:{j}:{table['label'][k]}", home, (i, j) == own), strict=True):
                                into.append(value)
            types = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["rep", "cell", "home", "same"])

    placed = written(classes.select("rep", "label", "v").mapInArrow(place, "rep long, cell string, home boolean, same boolean"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("visits"))
    # A cell with one vector and no visitor but itself has no pair.
    sizes = sizes.where("homes > 0 and visits > 1")
    blocks = lambda n: F.ceil(F.col(n) / p.block).cast("int")
    sizes = written(sizes.select("cell", blocks("homes").alias("nh"), blocks("visits").alias("nv")), "sizes")
    cut = placed.join(sizes, "cell")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("nv"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("home"), F.col("nv")).otherwise(F.col("nh")) - 1)
    cut = cut.withColumn("own", own).withColumn("other", F.explode(other))
    h, v = F.when(F.col("home"), F.col("own")).otherwise(F.col("other")), F.when(F.col("home"), F.col("other")).otherwise(F.col("own"))
    cut = cut.select("rep", "home", "same", F.xxhash64("cell", h, v).alias("block"))
    full = cut.join(classes.select("rep", "v", "n"), "rep")
    floor = p.cosine

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact cosines of a block's visitors with its residents; each pair of a cell once."""
        here, there = pdf[~pdf["home"]], pdf[pdf["home"]]
        empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if not len(here) or not len(there):
            return empty
        a, b = here["rep"].to_numpy(), there["rep"].to_numpy()
        if len({len(x) for x in pdf["v"]}) > 1:  # two cells whose keys collide
            return empty
        close = cosines(np.stack(here["v"].to_numpy()).astype(np.float64), np.stack(there["v"].to_numpy()).astype(np.float64)) >= floor
        close &= ~here["same"].to_numpy()[:, None] | (a[:, None] < b[None])
        found = [
            pd.DataFrame({"a": a, "b": a, "links": close @ there["n"].to_numpy()}),
            pd.DataFrame({"a": b, "b": b, "links": here["n"].to_numpy() @ close}),
        ]
        edges = forest(a, b, close)
        return pd.concat([*(x[x["links"] > 0] for x in found), pd.DataFrame(edges, columns=["a", "b"]).assign(links=0)]).astype("int64")

    met = written(full.groupBy("block").applyInPandas(meet, "a long, b long, links long"), "met")
    counts = met.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    labels = connected_components(met.where("a <> b").select("a", "b"))
    linked = labels.select(F.col("node").alias("rep"), "label").join(classes.select("rep", "least"), "rep")
    component = linked.join(linked.groupBy("label").agg(F.min("least").alias("component")), "label").select("rep", "component")
    known = classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(component, "rep", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    known = written(known.select("label", "h", "v", links, F.coalesce("component", "least").alias("component")), "classes")
    named = keyed.join(known, ["label", "h", "v"]).select("vec_id", "links", "component")
    alone = base.where(~good).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return named.unionByName(alone).select(
        "vec_id",
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    return (x @ y.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1))[None]


def forest(a: np.ndarray, b: np.ndarray, close: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join up what a block's links join up, at most one a row."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for i, j in zip(*np.nonzero(close), strict=True):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((int(a[i]), int(b[j])))
    return edges
