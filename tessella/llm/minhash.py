"""MinHash near-dedup with min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum,
so half as many hash evaluations fill a signature. Six permutations form a group; its six minima
are one band and its six maxima another, which keeps the values inside a band independent.

Plan: one Python pass turns texts into signatures (documents only ever move as a few bytes per
band). Documents with equal shingle sets collapse into one class first. Classes that share a band
are compared with the smallest of the bucket; members of a bucket that still stand in different
components after that are compared with one another. Each link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.hashing import mix, odd_numbers, shingle_hashes, word_hashes
from tessella.llm.shared import connected_components, written

#: Longs of a sketch: one bit of each signature value, 384 with the default parameters.
SKETCH = 6
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>, nibbles array<long>"


@dataclass(frozen=True)
class MinMaxParams:
    """Similarity ``num/den``; ``groups`` of ``rows`` permutations give 2 * groups bands."""

    width: int = 5
    num: int = 75
    den: int = 100
    rows: int = 6
    groups: int = 32
    #: Members of one bucket that meet others in one task; larger buckets are cut into blocks.
    block: int = 2048

    @property
    def most_bits(self) -> int:
        """Differing sketch bits that a pair at the threshold exceeds once in about ten million."""
        return self._most(64 * SKETCH, (1 - self.num / self.den) / 2, 5.2)

    @property
    def most_nibbles(self) -> int:
        """Differing nibbles that a pair at the threshold exceeds about three times in 100,000."""
        return self._most(2 * self.rows * self.groups, (1 - self.num / self.den) * 15 / 16, 4.0)

    @staticmethod
    def _most(n: int, rate: float, sigmas: float) -> int:
        return int(n * rate + sigmas * (n * rate * (1 - rate)) ** 0.5)


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's bytes."""
    return np.unique(shingle_hashes(word_hashes(data or b""), width))


def min_max(hashes: np.ndarray, perms: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the hashes under each permutation."""
    low = np.full(perms.size, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(perms.size, dtype=np.uint64)
    for k in range(0, hashes.size, block):
        seen = hashes[None, k : k + block] * perms[:, None]
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return low, high


def signature(hashes: np.ndarray, p: MinMaxParams, perms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys; a sketch, one bit of each of 384 values; and four bits of each value."""
    low, high = (mix(x) for x in min_max(hashes, perms))
    weights = odd_numbers(p.rows, 31)
    banded = [x.reshape(p.groups, p.rows) for x in (low, high)]
    bands = np.concatenate([(x * weights).sum(axis=1, dtype=np.uint64) for x in banded])
    bands = mix(bands + odd_numbers(2 * p.groups, 47))
    values = np.concatenate((low, high)).astype(np.uint8)
    sketch = np.packbits(np.resize(values & 1, 64 * SKETCH)).view(np.int64)
    fours = np.resize((values >> 4), -(-values.size // 16) * 16)
    return bands.view(np.int64), sketch, (fours[0::2] | fours[1::2] << 4).view(np.int64)


def _sign(p: MinMaxParams):
    perms = odd_numbers(p.groups * p.rows, 9)
    empty = np.empty(0, np.int64)
    whole = odd_numbers(2, 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, h, parts = [], [[], []], [[], [], []]
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                found = shingle_set(data, p.width)
                n.append(found.size)
                for k in (0, 1):
                    h[k].append(int(mix(mix(found + whole[k]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) if found.size else k)
                for into, part in zip(parts, signature(found, p, perms) if found.size else [empty] * 3, strict=True):
                    into.append(part)
            lists = lambda x: pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum([len(y) for y in x]))).astype(np.int32), pa.array(np.concatenate(x))
            )
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in h), *map(lists, parts)],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch", "nibbles"],
                )

    return run


def _short_sets(p: MinMaxParams):
    """The shingle sets of texts, each hash cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                short = np.unique(shingle_set(texts[i].as_py(), p.width).astype(np.uint32)).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, short.size], pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([ids.slice(i, 1), lists], names=["doc_id", "short"])

    return run


def _confirm(p: MinMaxParams):
    """Keep the pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}
        held = 0

        def of(i: int, data: bytes) -> np.ndarray:
            nonlocal held
            if i not in recent:
                if held > 1 << 23:  # 64 MB of hashes
                    recent.clear()
                    held = 0
                recent[i] = shingle_set(data, p.width)
                held += recent[i].size
            return recent[i]

        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = []
            for i in range(batch.num_rows):
                x, y = of(a[i].as_py(), ta[i].as_py()), of(b[i].as_py(), tb[i].as_py())
                small, large = (x, y) if x.size < y.size else (y, x)
                at = np.minimum(np.searchsorted(large, small), large.size - 1)
                both = int((large[at] == small).sum()) if large.size else 0
                keep.append(p.den * both >= p.num * (x.size + y.size - both) and both > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, p: MinMaxParams = MinMaxParams()) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``p.num / p.den`` or more.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Returns one row per
    input row: ``doc_id, n_shingles, component_id, kept``. Null or empty texts have no shingles
    and link with nothing. Texts of fewer than ``p.width`` words count as one shingle. Equal texts
    link whatever their number; rows that repeat a ``doc_id`` are one document. Rows without a
    ``doc_id`` can't be named: their component is null and they are kept. An empty table gives an
    empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sigs = written(texts.mapInArrow(_sign(p), SIGNATURE), "signatures")
    named = sigs.where("doc_id is not null and n_shingles > 0")
    classes = written(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = named.join(classes, ["h1", "h2"]).where("doc_id = rep").dropDuplicates(["h1", "h2"])
    reps = written(reps.select("doc_id", "n_shingles", "bands", "sketch", "nibbles"), "reps")
    labels = connected_components(_links(reps, texts, p))
    label = labels.select(F.col("node").alias("rep"), "label")
    of = written(classes.join(label, "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component")), "labels")
    # Texts without shingles have no class: their key holds their own id, so they don't meet in one task.
    key = F.when(F.col("n_shingles") > 0, F.col("h2")).otherwise(F.xxhash64("doc_id"))
    out = sigs.select("doc_id", "n_shingles", "h1", key.alias("h2")).join(of, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _may_link(p: MinMaxParams):
    """Whether set sizes, sketches, then nibbles of the sides a and b leave a link possible."""
    bits = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)), F.lit(0))
    ones = F.lit(0x1111111111111111)

    def differing(z):
        folded = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(folded.bitwiseOR(F.shiftrightunsigned(folded, 2)).bitwiseAND(ones))

    xors = F.zip_with("fa", "fb", lambda x, y: x.bitwiseXOR(y))
    nibbles = F.aggregate(xors, F.lit(0), lambda total, z: total + differing(z))
    sizes = F.least("na", "nb") * p.den >= F.greatest("na", "nb") * p.num
    return F.when(sizes & (bits <= p.most_bits), nibbles <= p.most_nibbles).otherwise(False)


def _can_link(p: MinMaxParams):
    """Whether the short sets of the sides a and b leave a link possible; no link is refused.

    A set may lose members where two hashes agree in 32 bits; so many at most are missing from what
    the two short sets share.
    """
    missing = F.least(F.col("na") - F.size("ea"), F.col("nb") - F.size("eb"))
    both = F.size(F.array_intersect("ea", "eb")) + missing
    return both * p.den >= (F.col("na") + F.col("nb") - both) * p.num


def _side(reps: DataFrame, x: str) -> DataFrame:
    return reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("nibbles").alias(f"f{x}"))


def _confirmed(likely: DataFrame, bodies: DataFrame, p: MinMaxParams) -> DataFrame:
    """Of likely pairs (a, b), those that are links on their full shingle sets."""
    body = lambda x: bodies.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    full = likely.join(body("a"), "a").join(body("b"), "b").select("a", "b", "ta", "tb")
    return written(full.mapInArrow(_confirm(p), "a long, b long"), "links")


def _links(reps: DataFrame, texts: DataFrame, p: MinMaxParams) -> DataFrame:
    """Links that join up all similar classes.

    First each member of a bucket meets the bucket's smallest. Then, in buckets whose members
    still stand in several components, the members outside the bucket's main component meet
    those of other components, in blocks where the bucket is large; sketches, then the sets are
    compared inside the join, and a pair comes out of its first shared band only, so what comes out
    are links and not the square of a group that is alike but not similar enough. No pair of one
    component is looked at, and none across is left out.
    """
    buckets = reps.select(F.posexplode("bands").alias("band", "key"), "doc_id")
    lead = buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    lead = written(lead, "leads")
    members = written(buckets.join(lead, "key"), "members")
    pairs = members.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    likely = pairs.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").where(_may_link(p)).select("a", "b")
    likely = written(likely, "likely")
    wide = members.where("n > 2")
    # Texts move once: those of likely pairs, and those that may be looked at again.
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(wide.select("doc_id")).distinct()
    bodies = written(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bodies")
    links = _confirmed(likely, bodies, p)
    if wide.isEmpty():
        return links
    label = connected_components(links).withColumnRenamed("node", "doc_id")
    placed = wide.join(label, "doc_id", "left").select("key", "band", "doc_id", "n", F.coalesce("label", "doc_id").alias("c"))
    placed = written(placed, "placed")
    shares = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("c", "n").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = written(mixed.select("key", "main"), "mixed")
    apart = written(placed.join(mixed, "key"), "apart")
    again = bodies.join(apart.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    full = reps.select("doc_id", "n_shingles", "sketch", "nibbles", "bands").join(again.mapInArrow(_short_sets(p), "doc_id long, short array<int>"), "doc_id")
    rest = written(apart.join(full, "doc_id"), "rest")
    cols = lambda x: [
        F.col(old).alias(new + x)
        for old, new in (("doc_id", ""), ("c", "c"), ("n_shingles", "n"), ("sketch", "s"), ("nibbles", "f"), ("bands", "w"), ("main", "m"), ("short", "e"))
    ]
    blocks = F.ceil(F.col("n") / p.block).cast("int")
    rest = rest.withColumn("blocks", blocks).drop("n")
    minor = rest.where("c <> main").select("key", "band", F.pmod(F.hash("doc_id"), "blocks").alias("part"), *cols("a"))
    other = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *cols("b"))
    first = F.array_position(F.zip_with("wa", "wb", lambda x, y: x == y), True) == F.col("band") + 1
    once = (F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b"))
    met = (minor["key"] == other["key"]) & (minor["part"] == other["part"])
    alike = F.when(_may_link(p), F.when(first, _can_link(p)).otherwise(False)).otherwise(False)
    cross = minor.join(other, met & (F.col("ca") != F.col("cb")) & once & alike)
    cross = written(cross.select("a", "b").distinct(), "likely")
    return links.unionByName(_confirmed(cross, bodies, p))
