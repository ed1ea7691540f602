"""Embedding whitening with an exact scatter matrix in residue numbers.

Components become integers, x = floor(256 c). Over the list of distinct vectors, n of them with sums
S, the integers y = n x - S are centred exactly. Each task takes y modulo several primes below 2^20
and multiplies the residues in floating point: residues lie within half a prime, and no more than
2^14 rows are multiplied at a time, so every product and partial sum is a whole number below 2^53.
The reduced products of all tasks are added, and Chinese remaindering gives the scatter of y itself,
free of rounding, however many rows, tasks and orders of addition there are. Only its quotient by
n^3, the covariance of x, is a double; it goes through one symmetric eigendecomposition.

Nothing that grows with the rows reaches the driver: it gets one row for each residue matrix's row,
as many as dimensions times primes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written

#: Integer steps a unit of a component (part of the operator's definition).
SCALE = 256
#: Primes lie below 2^20; products of 2^14 centred residues add up to less than 2^53.
PRIME_BITS, BLOCK = 20, 1 << 14
#: Groups that partial matrices are added in before they meet.
SALT = 32
LONG = 1 << 63


@dataclass
class Space:
    """What is known of the vectors of one length: n of them, sums, principal axes."""

    n: int
    top: int  # the largest absolute x
    sums: list[int]
    axes: np.ndarray  # a column a component
    values: np.ndarray  # eigenvalues by falling size
    trace: float
    live: np.ndarray  # whether a component varies at all
    error: float = 0.0


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^20, so many that their product exceeds twice ``bound``."""
    found, product, p = [], 1, 1 << PRIME_BITS
    while product <= 2 * bound + 1 or len(found) < 2:
        p -= 1
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def from_residues(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers of least size that have these residues (Chinese remaindering), as Python integers."""
    total, modulus = np.zeros(residues[0].shape, dtype=object), 1
    for r, p in zip(residues, primes, strict=True):
        step = (r.astype(object) - total) * pow(modulus, -1, p) % p
        total, modulus = total + modulus * step, modulus * p
    return np.where(total > modulus // 2, total - modulus, total)


def centred(r: np.ndarray, p: int) -> np.ndarray:
    """Residues between plus and minus half the prime, as doubles."""
    r = r % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch by their length: places in the batch, and a matrix with a row each."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat.reshape(-1, d) if len(at) == len(sizes) else flat[starts[at][:, None] + np.arange(d)]


def _added(fit: DataFrame, kernel: Callable[[np.ndarray], list[np.ndarray]], kind: str) -> dict[int, list[np.ndarray]]:
    """Sums over all rows of the matrices that ``kernel`` gives for blocks of vectors, by length.

    Each task adds up its own; their rows meet by (length, matrix, row), first in groups of tasks.
    Sums of reduced residues stay below 2^63 for 2^43 blocks.
    """
    schema = f"d long, k long, i long, salt long, v array<{kind}>"
    dtype, arrow = (np.int64, pa.int64()) if kind == "long" else (np.float64, pa.float64())

    def rows(held: dict[tuple[int, int, int], np.ndarray], salt: int) -> pa.RecordBatch:
        keys = sorted(held)
        lists = pa.array([held[k] for k in keys], pa.list_(arrow))
        cols = [pa.array([k[j] for k in keys], pa.int64()) for j in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([salt] * len(keys), pa.int64()), lists], names=["d", "k", "i", "salt", "v"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                for k in range(0, len(x), BLOCK):
                    got = kernel(x[k : k + BLOCK])
                    if x.shape[1] not in held:
                        held[x.shape[1]] = got
                    else:
                        for into, m in zip(held[x.shape[1]], got, strict=True):
                            into += m
        flat = {(d, k, i): row for d, many in held.items() for k, m in enumerate(many) for i, row in enumerate(m)}
        yield rows(flat, TaskContext.get().partitionId() % SALT)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)
            edges = batch.column(4).offsets.to_numpy()
            flat = batch.column(4).values.to_numpy(zero_copy_only=False)
            for n, key in enumerate(keys):
                row = flat[edges[n] : edges[n + 1]].astype(dtype)
                held[key] = held[key] + row if key in held else row
        yield rows(held, 0)

    parts = fit.select("x").mapInArrow(multiply, schema).repartition("d", "k", "i", "salt").mapInArrow(add, schema)
    met = parts.repartition("d", "k", "i").mapInArrow(add, schema).collect()  # a row for each row of a matrix
    out: dict[int, dict[int, dict[int, np.ndarray]]] = {}
    for r in met:
        out.setdefault(r["d"], {}).setdefault(r["k"], {})[r["i"]] = np.array(r["v"], dtype=dtype)
    return {d: [np.array([m[i] for i in range(len(m))]) for _, m in sorted(many.items())] for d, many in out.items()}


def integers(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows whose vector can be taken; x has 256 steps a unit.

    Null and empty vectors are left out, as are those that hold a null, a non-finite entry, or one
    whose x is beyond a long.
    """
    v = F.col("embedding").cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(LONG)))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fits, F.lit(False)) & (F.size("v") > 0))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def fitted(fit: DataFrame, components: int) -> dict[int, Space]:
    """The space of each length of the distinct vectors ``fit(x)``, a written table."""
    largest = F.max(F.greatest(F.array_max("x"), -F.array_min("x")))
    sizes = {r["d"]: (r["n"], r["top"]) for r in fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), largest.alias("top")).collect()}
    primes = {d: (primes_for(n * top), primes_for(n * (2 * n * top) ** 2)) for d, (n, top) in sizes.items()}

    def sums(x: np.ndarray) -> list[np.ndarray]:
        return [(x % p).sum(axis=0, keepdims=True) % p for p in primes[x.shape[1]][0]]

    totals = {d: [int(s) for s in from_residues([m % p for m, p in zip(many, primes[d][0], strict=True)], primes[d][0])[0]] for d, many in _added(fit, sums, "long").items()}

    def scatter(x: np.ndarray) -> list[np.ndarray]:
        out, (n, _), own = [], sizes[x.shape[1]], totals[x.shape[1]]
        for p in primes[x.shape[1]][1]:
            y = centred((n % p) * (x % p) - np.array([s % p for s in own]), p)
            out.append((y.T @ y).astype(np.int64) % p)
        return out

    spaces = {}
    for d, many in _added(fit, scatter, "long").items():
        n, top = sizes[d]
        exact = from_residues([m % p for m, p in zip(many, primes[d][1], strict=True)], primes[d][1])
        covariance = (exact / n**3).astype(np.float64)  # whole numbers divided: rounded once
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        live = values > max(float(values[0]), 0.0) * d * np.finfo(np.float64).eps
        trace = sum(int(exact[i, i]) for i in range(d)) / n**3
        spaces[d] = Space(n, top, totals[d], axes, values, trace, live)

    def covariance_of_whitened(x: np.ndarray) -> list[np.ndarray]:
        z = _project(spaces[x.shape[1]], x)
        return [np.vstack([z.sum(axis=0), z.T @ z])]

    for d, (m,) in _added(fit, covariance_of_whitened, "double").items():
        own = spaces[d]
        mean = m[0] / own.n
        off = np.abs(m[1:] / own.n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(own.live, own.live)]
        own.error = float(off.max(initial=0.0))
    return spaces


def _deviations(space: Space, x: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where they suffice, else in Python's integers."""
    if 2 * space.n * space.top < LONG:
        return space.n * x - np.array(space.sums, dtype=np.int64)
    return space.n * x.astype(object) - np.array(space.sums, dtype=object)


def _project(space: Space, x: np.ndarray) -> np.ndarray:
    """Components of unit variance; zero where a component does not vary."""
    away = (_deviations(space, x) / space.n).astype(np.float64)
    return (away @ space.axes) * np.where(space.live, 1 / np.sqrt(np.where(space.live, space.values, 1.0)), 0.0)


def _distances(space: Space, x: np.ndarray) -> pa.Array:
    """Sums of squares of n x - S, exact; null beyond 38 digits."""
    y = _deviations(space, x)
    if x.shape[1] * (2 * space.n * space.top) ** 2 < LONG:
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0), safe=False)
    y = y.astype(object)
    return pa.array([Decimal(int(s)) if s < 10**38 else None for s in (y * y).sum(axis=1)], pa.decimal128(38, 0))



WHITE = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """Whitened components of every vector of ``rows(vec_id, embedding)``; other columns are ignored.

    Returns ``vec_id, n, deviation, whitened, explained, identity_error``: n distinct vectors were
    fitted; ``deviation`` is the exact sum of squares of n x - S; ``whitened`` has up to
    ``components`` entries by falling variance, ``explained`` their shares of the trace, and
    ``identity_error`` is the largest entry of the whitened covariance less the identity.

    Vectors that are null, empty, or hold null, non-finite or unrepresentable entries have no row.
    Rows that repeat a ``vec_id``, or have none, get a row each; equal vectors are fitted once. Vectors
    of another length are a space of their own. A component that does not vary (one vector alone,
    constant entries) is null and explains its rounding at most; with no trace, 0. ``deviation`` is null
    beyond 38 digits. An empty table gives an empty one.

    A task holds one matrix a prime, of squared dimension, whatever the rows. The distinct vectors are
    shuffled once and written; a vector that fills a third of the table is merged before it travels.
    """
    own = integers(rows)
    fit = written(own.select("x").distinct(), "fit")
    spaces = fitted(fit, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                space = spaces[x.shape[1]]
                for k in range(0, len(x), BLOCK):
                    part = x[k : k + BLOCK]
                    z, many = _project(space, part), len(part)
                    k_ = z.shape[1]
                    edges = np.arange(0, many * k_ + 1, k_, dtype=np.int32)
                    dead = np.tile(~space.live, many)
                    share = np.tile(space.values / space.trace if space.trace else np.zeros(k_), many)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at[k : k + BLOCK])), pa.array(np.full(many, space.n)), _distances(space, part),
                            pa.ListArray.from_arrays(edges, pa.array(z.ravel(), mask=dead)), pa.ListArray.from_arrays(edges, pa.array(share)), pa.array(np.full(many, space.error)),
                        ],
                        names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return own.mapInArrow(project, WHITE)
