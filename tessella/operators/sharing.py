"""Pairs of nodes that share neighbours, made and summed up inside tasks.

Nodes are dealt into blocks, and each pair of blocks is a piece of work that gets all neighbours of
both: every pair of nodes meets in one piece, with all that it shares. So pairs, whose number grows
with the square of a neighbour's degree, are never shuffled; what is shuffled are the edges, once a
block. A piece holds about twice ``MEMBERS`` edges and makes ``CHUNK`` meetings at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a block, meetings that one piece should make, and blocks that are made for the latter's sake, at most.
MEMBERS, MEETINGS, SPREAD = 1_500_000, 20_000_000, 16
#: Meetings that a task holds at a time; those of one node are never parted.
CHUNK = 2_000_000
#: Marks, a byte each, that a lookup of shared neighbours holds at a time.
MARKS = 50_000_000


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of the values among the distinct ones, and those in ascending order."""
    d = values.dictionary_encode()
    order = pc.sort_indices(d.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[d.indices.to_numpy()], d.dictionary.take(order)


class Piece:
    """The nodes of two blocks, or of one: ``names`` in ascending order, ``degree`` of each, ``through`` the neighbours' names."""

    def __init__(self, rows: pa.Table, blocks: int) -> None:
        first, second = divmod(rows["g"][0].as_py(), blocks)
        lists = rows["ns"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        per = lists.value_lengths().to_numpy(zero_copy_only=False)
        t, self.through = encoded(pa.concat_arrays(rows["t"].chunks))
        node, self.names = encoded(lists.flatten())
        t, k = np.repeat(t, per), np.repeat(rows["k"].to_numpy(), per)
        self.degree = np.bincount(node, minlength=len(self.names))
        self._same = first == second
        self._first = np.zeros(len(self.names), bool)
        self._first[node[k == first]] = True
        self._left, self._right = ((node[k == b], t[k == b]) for b in (first, second))

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of some nodes at a time, all their meetings: ``key`` (the smaller node times the count of names, plus the larger) and the neighbour."""
        n = len(self.names)
        node, t = self._right
        order = np.argsort(t, kind="stable")
        other, many = node[order], np.bincount(t, minlength=len(self.through))
        start = np.cumsum(many) - many
        node, t = self._left
        order = np.argsort(node, kind="stable")
        node, t = node[order], t[order]
        per = many[t]
        ends = np.cumsum(per)
        a = 0
        while a < len(node):
            base = ends[a] - per[a]
            b = int(np.searchsorted(ends, base + CHUNK, "right"))
            if b < len(node):
                b = int(np.searchsorted(node, node[b]))
                if b <= a:
                    b = int(np.searchsorted(node, node[a], "right"))
            p = per[a:b]
            at = np.arange(ends[b - 1] - base) + np.repeat(start[t[a:b]] - (ends[a:b] - p - base), p)
            u, v, by = np.repeat(node[a:b], p), other[at], np.repeat(t[a:b], p)
            if self._same:
                keep = u < v
                u, v, by = u[keep], v[keep], by[keep]
            if len(u):
                yield np.minimum(u, v) * n + np.maximum(u, v), by
            a = b

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of some nodes at a time, all their pairs ``u < v``, each once, and how many neighbours they share."""
        n = len(self.names)
        for key, _ in self.meetings():
            key.sort()
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            w = np.diff(new, append=len(key))
            key = key[new]
            u = key // n
            yield u, key - u * n, w


    def shared(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many neighbours of ``v`` are among those of ``u``, looked up one by one; equal values of ``u`` stand together."""
        wide = len(self.through)
        at, start = self._right[1][np.argsort(self._right[0], kind="stable")], np.cumsum(np.bincount(self._right[0], minlength=len(self.names)))
        mine, mine_end = self._left[1][np.argsort(self._left[0], kind="stable")], np.cumsum(np.bincount(self._left[0], minlength=len(self.names)))
        # The smaller name may lie in either block: look up that of the first block among the other's.
        if not self._same:
            first = self._first[u]
            u, v = np.where(first, u, v), np.where(first, v, u)
        order = np.argsort(u, kind="stable")
        out = np.empty(len(u), np.int64)
        new = np.flatnonzero(np.concatenate(([True], u[order][1:] != u[order][:-1], [True])))
        step = max(MARKS // max(wide, 1), 1)
        for i in range(0, len(new) - 1, step):
            some = new[i : i + step + 1]
            rows = order[some[0] : some[-1]]
            local = np.repeat(np.arange(len(some) - 1), np.diff(some))
            marks = np.zeros((len(some) - 1) * wide, bool)
            heads = u[order[some[:-1]]]
            has = self.degree[heads]
            marks[np.repeat(np.arange(len(heads)) * wide, has) + mine[_ranges(mine_end[heads] - has, has)]] = True
            few = self.degree[v[rows]]
            hit = marks[np.repeat(local * wide, few) + at[_ranges(start[v[rows]] - few, few)]]
            out[rows] = np.add.reduceat(hit.astype(np.int64), np.cumsum(few) - few)
        return out


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    ends = np.cumsum(many)
    return np.arange(ends[-1]) + np.repeat(start - (ends - many), many)


def over_pieces(edges: DataFrame, node: str, through: str, summed: Callable[[Piece], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``summed`` gives of each piece, as rows of ``schema``; every pair of ``node`` values lies in one piece."""
    known = edges.select(F.col(node).alias("n"), F.col(through).alias("t")).where("n is not null and t is not null")
    per = known.groupBy("t").agg(F.count("*").alias("d"))
    size = per.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("e"), F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("p")).first()
    blocks = max(ceil(size["e"] / MEMBERS), min(ceil(sqrt(2 * size["p"] / MEETINGS)), SPREAD), 1)
    packed = known.groupBy("t", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("k")).agg(F.collect_set("n").alias("ns"))
    copies = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    piece = (F.least("k", "o") * blocks + F.greatest("k", "o")).alias("g")
    # Few bytes can make many pairs: pieces are dealt out by number and not by size.
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, blocks * (blocks + 1) // 2)
    dealt = copies.select(piece, "k", "t", "ns").repartition(parts, "g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and g[a] != last:
                    whole, held = pa.Table.from_batches(held), []
                    yield from summed(Piece(whole, blocks))
                last = g[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from summed(Piece(pa.Table.from_batches(held), blocks))

    return dealt.mapInArrow(run, schema)
