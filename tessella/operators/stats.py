"""Distributions, rank tests, correlations, contingency measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import written


def _java(cls: str, method: str, *args: Column) -> Column:
    """A static method of a class on Spark's class path; it returns text."""
    return F.call_function("java_method", F.lit(cls), F.lit(method), *args).cast("double")


#: Rows that one ordered pass takes; more are cut into ranges, each with its own pass.
ONE_PASS = 2_000_000


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null where a side does not vary (Spark's own ``corr`` divides by zero there)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def t_test_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r over n pairs."""
    x, a = F.greatest(1 - r * r, F.lit(0.0)), F.greatest((n - 2) / 2.0, F.lit(0.5))
    beta = _java("org.apache.commons.math3.special.Beta", "regularizedBeta", x.cast("double"), a.cast("double"), F.lit(0.5))
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), beta)


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal deviate."""
    return F.when(z.isNotNull(), F.least(_java("org.apache.commons.math3.special.Erf", "erfc", (F.abs(z) / 2**0.5).cast("double")), F.lit(1.0)))


def chi2_p(x: Column, dof: Column) -> Column:
    """Upper tail of chi-square."""
    return F.when(x.isNotNull() & (dof > 0), _java("org.apache.commons.math3.special.Gamma", "regularizedGammaQ", (dof / 2.0).cast("double"), (x / 2.0).cast("double")))


def adjusted_skew(g: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population's; null for n < 3."""
    return F.when((n > 2) & ~F.isnan(g), g * F.sqrt(n * (n - 1.0)) / (n - 2))


def adjusted_kurtosis(g: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population's; null for n < 4."""
    return F.when((n > 3) & ~F.isnan(g), (n - 1) / ((n - 2) * (n - 3.0)) * ((n + 1) * g + 6))


def value_counts(df: DataFrame, value: str, by: str) -> DataFrame:
    """``g, x, m``: how often each value, as a double, comes in each group; nulls go. Written, so the source is read once."""
    x = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("x"))
    return written(x.groupBy("g", "x").agg(F.count("*").alias("m")), "values")


def _moments(counts: DataFrame) -> DataFrame:
    """``g, n, total, min, max, mean, std, skew, kurtosis`` of :func:`value_counts`, uncorrected but for the sample's std.

    Powers of the distances from the mean are summed in a second pass. Values that are all alike have
    a std of zero, or null for one value, and no skewness.
    """
    x, m, n = F.col("x"), F.col("m"), F.col("n")
    base = counts.groupBy("g").agg(F.sum("m").alias("n"), F.sum(x * m).alias("total"), F.min("x").alias("min"), F.max("x").alias("max")).withColumn("mean", F.col("total") / n)
    off = x - F.col("mean")
    powers = counts.join(base.select("g", "mean"), "g").groupBy("g").agg(*(F.sum(F.pow(off, F.lit(k)) * m).alias(f"s{k}") for k in (2, 3, 4)))
    alike = F.col("min") == F.col("max")
    s2 = F.when(~alike, F.nullif("s2", F.lit(0.0)))
    return base.join(powers, "g").select(
        *base.columns, F.when(n > 1, F.when(alike, 0.0).otherwise(F.sqrt(F.col("s2") / (n - 1)))).alias("std"),
        (F.col("s3") / n / F.pow(s2 / n, F.lit(1.5))).alias("skew"), (n * F.col("s4") / (s2 * s2) - 3).alias("kurtosis"),
    )


def distribution(df: DataFrame, value: str, by: str | None = None, most: int = ONE_PASS) -> DataFrame:
    """Twelve descriptive measures, per group if asked for; all from counted values."""
    counts = value_counts(df if by else df.withColumn("_all", F.lit(0)), value, by or "_all")
    n = F.col("n")
    moments = _moments(counts).select(
        "g", "n", F.round("total", 4).alias("total"), "min", F.round("mean", 2).alias("mean"), "max", F.round(F.coalesce("std", F.lit(0.0)), 2).alias("std"),
        (F.round(F.coalesce(adjusted_skew(F.col("skew"), n), F.lit(0.0)), 3) + 0.0).alias("skew"),
    )
    at = counted_quantiles(counts, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}, most)
    out = moments.join(at, "g")
    if not by and out.isEmpty():  # no rows: one row of zeros and nulls, as an aggregate without groups gives
        out = df.sparkSession.createDataFrame([(0, 0.0, 0.0)], "n long, std double, skew double").withColumns({c: F.lit(None).cast("double") for c in ("total", "min", "mean", "max", "p25", "median", "p75", "p90", "p99")})
    return out.select(*([F.col("g").alias(by)] if by else []), "n", "total", "min", "p25", "median", "mean", "p75", "p90", "p99", "max", "std", "skew")


def outliers(df: DataFrame, values: list[str], most: int = ONE_PASS) -> DataFrame:
    """One row a variable: quartile fences, moments, and robust z above 3.5.

    The source is read once, for all variables, and all else comes from counted values; a spread of
    zero gives no robust outliers.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values))).alias("s")).select("s.*")
    counts = value_counts(long, "x", "variable")
    x, m, n = F.col("x"), F.col("m"), F.col("n")
    first = _moments(counts).join(counted_quantiles(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}, most), "g")
    first = first.withColumn("low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    first = written(first, "fences")  # as many rows as variables
    fenced = counts.join(F.broadcast(first.select("g", "median", "low", "high")), "g").withColumn("off", F.abs(x - F.col("median")))
    beyond = fenced.groupBy("g").agg(F.coalesce(F.sum(F.when((x < F.col("low")) | (x > F.col("high")), m)), F.lit(0)).alias("n_iqr"))
    spread = counted_quantiles(fenced.groupBy("g", F.col("off").alias("x")).agg(F.sum("m").alias("m")), {"mad": 0.5}, most)
    second = written(beyond.join(spread, "g"), "spreads")
    robust = fenced.join(F.broadcast(second), "g").where("mad > 0").groupBy("g").agg(F.sum(F.when(0.6745 * F.col("off") / F.col("mad") > 3.5, m)).alias("n_robust"))
    out = first.join(second, "g").join(robust, "g", "left")
    return out.select(
        F.col("g").alias("variable"), "n", "min", "max", F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"), F.round(adjusted_skew(F.col("skew"), n), 3).alias("skew"),
        F.round(adjusted_kurtosis(F.col("kurtosis"), n), 3).alias("kurtosis"), "q1", "q3", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"),
        "n_iqr", F.round(100 * F.col("n_iqr") / n, 2).alias("pct_iqr"), F.round("mad", 6).alias("mad"), F.coalesce("n_robust", F.lit(0)).alias("n_robust"),
        F.round(F.col("max") / F.nullif("median", F.lit(0.0)), 3).alias("max_to_median"),
    )


def cumulated(df: DataFrame, order: str, mass: str, name: str, descending: bool = False, most: int = ONE_PASS) -> DataFrame:
    """``df``, one row a value of ``order``, with the running sum of ``mass`` up to and with each row.

    Up to ``most`` rows are summed in one ordered pass. More are cut into ranges of ``order``, which
    are written, summed side by side, and moved by the sums of the ranges before: a row a range.
    """
    by = F.col(order).desc() if descending else F.col(order)
    if df.count() <= most:
        return df.withColumn(name, F.sum(mass).over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    cut = written(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = cut.groupBy("_range").agg(F.sum(mass).alias("_s")).select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum(mass).over(Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base", "_range")


def quantiles(df: DataFrame, value: str, by: str, probs: dict[str, float], most: int = ONE_PASS) -> DataFrame:
    """``by`` and the exact quantiles named in ``probs`` of each group, interpolated between neighbours."""
    return counted_quantiles(value_counts(df, value, by), probs, most).withColumnRenamed("g", by)


def counted_quantiles(counts: DataFrame, probs: dict[str, float], most: int = ONE_PASS) -> DataFrame:
    """``g`` and the quantiles of ``counts(g, x, m)``, a row a value and group.

    Up to ``most`` values a group's values meet in one task. Beyond, counts are summed in order
    (:func:`cumulated`), and each quantile is read off the two values whose places enclose it; no
    task holds a group.
    """
    if counts.count() <= most:
        return counts.groupBy("g").agg(*(F.percentile("x", F.lit(p), F.col("m")).alias(name) for name, p in probs.items()))
    counts = counts.withColumn("k", F.struct("g", "x"))
    run = cumulated(counts, "k", "m", "up", most=most)
    sizes = counts.groupBy("g").agg(F.sum("m").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group
    run = run.join(sizes.withColumn("base", before), "g")
    last = F.col("up") - F.col("base") - 1
    holds = lambda place: F.max(F.when((place <= last) & (place > last - F.col("m")), F.col("x")))
    parts, place = [], lambda p: F.lit(p) * (F.col("n") - 1)
    for name, p in probs.items():
        parts += [holds(F.floor(place(p))).alias(f"{name}_a"), holds(F.ceil(place(p))).alias(f"{name}_b")]
    found = run.groupBy("g", "n").agg(*parts)
    between = lambda name, p: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (place(p) - F.floor(place(p)))
    return found.select("g", *(between(name, p).alias(name) for name, p in probs.items()))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with average ranks of a column; ties share the mean of their places.

    Places are counted over distinct values, which need the one ordered pass.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    ranks = cumulated(counts, "_v", "_m", "_up").select("_v", (F.col("_up") - (F.col("_m") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, rho, p`` over rows where both are known."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    x = average_ranks(average_ranks(x, "a", "ra"), "b", "rb")
    return x.agg(F.count("*").alias("n"), correlation(F.col("ra"), F.col("rb")).alias("rho")).select("n", F.round("rho", 4).alias("rho"), F.round(t_test_p(F.col("rho"), F.col("n")), 5).alias("p"))


def pearson_log1p(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, r, p`` of the logarithms of one plus the values."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.agg(F.count("*").alias("n"), correlation(F.log1p(a), F.log1p(b)).alias("r"))
    return x.select("n", F.round("r", 4).alias("r"), F.round(t_test_p(F.col("r"), F.col("n")), 5).alias("p"))


def signed_pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """Sum over pairs of the signs of their differences in a and in b, times both multiplicities.

    Ranks of a are parted bit by bit, from the highest: two different ranks part at one bit, where
    one is left and the other right. Sorted by b inside its group, a right point is worth the left
    mass below it less the left mass above it.
    """
    rank = np.unique(a, return_inverse=True)[1]
    b = np.unique(b, return_inverse=True)[1]
    m, total = m.astype(np.float64), 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group, right = rank >> (bit + 1), (rank >> bit) & 1 == 1
        order = np.lexsort((b, group))
        g, v, left = group[order], b[order], np.where(right, 0.0, m)[order]
        up = np.concatenate(([0.0], np.cumsum(left)))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_value = new_group | np.concatenate(([True], v[1:] != v[:-1]))
        at = np.arange(len(g))
        group_from, value_from = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_value, at, 0))
        ends = lambda new: np.concatenate((np.flatnonzero(new)[1:], [len(g)]))[np.cumsum(new) - 1]
        below, above = up[value_from] - up[group_from], up[ends(new_group)] - up[ends(new_value)]
        total += float(((below - above) * np.where(right, m, 0.0)[order]).sum())
    return total


def concordance(points: DataFrame, most: int = ONE_PASS) -> float:
    """Concordant less discordant pairs of ``points(a, b, m)``, each (a, b) once, without joining points with points.

    Both variables are cut into ranges of up to about ``most`` points, or a 500th of them; a value
    with more is a range of its own, whose points tie. Pairs in one range of a are counted there; pairs
    in one range of b and different ranges of a, there; all others by the counts of the cells between.
    """
    size = max(most, points.count() // 500, 1)

    def ranges(c: str) -> DataFrame:
        counts = points.groupBy(c).agg(F.count("*").alias("_n"))
        up = cumulated(counts, c, "_n", "_up", most=most)
        hot = F.col("_n") > size
        return up.select(c, (2 * F.floor((F.col("_up") - F.col("_n")) / size) + hot.cast("int")).cast("long").alias(f"r{c}"), hot.alias(f"hot{c}"))

    cut = written(points.join(ranges("a"), "a").join(ranges("b"), "b"), "cut")

    def inside(first: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: pd.DataFrame({"s": [signed_pairs(pdf[first].to_numpy(), pdf["b"].to_numpy(), pdf["m"].to_numpy())]})

    cells = cut.groupBy("ra", "rb").agg(F.sum("m").alias("m"))  # 500 ranges each way, a value more in each at most

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [signed_pairs(pdf["ra"].to_numpy(), pdf["rb"].to_numpy(), pdf["m"].to_numpy())]})

    parts = [
        cut.where("not hota").groupBy("ra").applyInPandas(inside("a"), "s double"),
        cut.where("not hotb").groupBy("rb").applyInPandas(inside("ra"), "s double"),
        cells.groupBy(F.lit(0).alias("one")).applyInPandas(between, "s double"),
    ]
    return float(reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0])


def kendall(df: DataFrame, a: str, b: str, most: int = 100_000) -> DataFrame:
    """One row ``n, tau, p`` (tau-b, normal approximation).

    Pairs are counted over distinct (a, b) with multiplicities, in ranges of up to ``most`` of them
    (:func:`concordance`), so there is no join of pairs.
    """
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("m"))
    x = written(x, "pairs")
    pairs = x.sparkSession.createDataFrame([(concordance(x, most),)], "s double")
    ties = lambda c, t: x.groupBy(c).agg(F.sum("m").alias("t")).agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(t), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias(f"{t}v"),
        F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2.0)).alias(f"{t}3"),
    )
    one = x.agg(F.sum("m").alias("n")).crossJoin(pairs).crossJoin(ties("a", "ta")).crossJoin(ties("b", "tb"))  # four single rows
    n, n0 = F.col("n"), F.col("n") * (F.col("n") - 1) / 2.0
    tau = F.col("s") / F.sqrt((n0 - F.col("ta")) * (n0 - F.col("tb")))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - F.col("tav") - F.col("tbv")) / 18 + 2 * F.col("ta") * F.col("tb") / m + F.col("ta3") * F.col("tb3") / (9 * m * (n - 2))
    return one.select("n", F.round(tau, 4).alias("tau"), F.round(normal_p(F.col("s") / F.sqrt(var)), 5).alias("p"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """One row ``n1, n2, u, p``, two-sided, corrected for ties and continuity; u is of the first group."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), first.alias("g")).where("g is not null")
    counts = x.groupBy("x").agg(F.count("*").alias("t"), F.count(F.when(F.col("g"), 1)).alias("f"))
    ranked = cumulated(counts, "x", "t", "up").select("t", "f", (F.col("up") - (F.col("t") - 1) / 2.0).alias("r"))
    s = ranked.agg(F.sum("f").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("f") * F.col("r")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t").cast("double")).alias("tie"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd
    return s.select("n1", n2.alias("n2"), F.round(u, 2).alias("u"), F.round(normal_p(F.greatest(z, F.lit(0.0))), 5).alias("p"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row ``n, k, h, p`` over the groups of a column, corrected for ties."""
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("x"), F.col(group).alias("g")).agg(F.count("*").alias("m"))
    t = x.groupBy("x").agg(F.sum("m").alias("t"))
    ranks = cumulated(t, "x", "t", "up").select("x", "t", (F.col("up") - (F.col("t") - 1) / 2.0).alias("r"))
    sums = x.join(ranks.select("x", "r"), "x").groupBy("g").agg(F.sum("m").alias("ng"), F.sum(F.col("m") * F.col("r")).alias("rg"))
    whole = sums.agg(F.count("*").alias("k"), F.sum("ng").alias("n"), F.sum(F.col("rg") * F.col("rg") / F.col("ng")).alias("s"))
    tie = ranks.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t").cast("double")).alias("tie"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("tie") / (n * n * n - n), F.lit(0.0))
    return whole.crossJoin(tie).select("n", "k", F.round(h, 4).alias("h"), F.round(chi2_p(h, F.col("k") - 1), 5).alias("p"))


def chi_square(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """One row ``n, rows, cols, chi2, dof, p, v, n_low``: independence of two labels, groups of ``least`` or more.

    With one degree of freedom the continuity correction applies.
    """
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    x = x.withColumn("ra", F.sum("o").over(Window.partitionBy("a"))).where(F.col("ra") >= least)
    rows, cols = x.groupBy("a").agg(F.sum("o").alias("ra")), x.groupBy("b").agg(F.sum("o").alias("cb"))
    # As many cells as labels times groups: a contingency table.
    cells = rows.crossJoin(F.broadcast(cols)).join(x.select("a", "b", "o"), ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    size = rows.agg(F.count("*").alias("rows"), F.sum("ra").alias("n")).crossJoin(cols.agg(F.count("*").alias("cols")))
    cells = cells.crossJoin(F.broadcast(size)).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    off = F.abs(F.col("o") - F.col("e"))
    off = F.when((F.col("rows") - 1) * (F.col("cols") - 1) == 1, F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))).otherwise(off)
    s = cells.groupBy("n", "rows", "cols").agg(F.sum(off * off / F.col("e")).alias("x"), F.count(F.when(F.col("e") < 5, 1)).alias("n_low"))
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    v = F.sqrt(F.col("x") / F.nullif(F.col("n") * (F.least("rows", "cols") - 1), F.lit(0.0)))
    return s.select(
        F.col("n").cast("long").alias("n"), "rows", "cols", F.round("x", 4).alias("chi2"), dof.alias("dof"), F.round(chi2_p(F.col("x"), dof), 6).alias("p"), F.round(v, 4).alias("v"), "n_low"
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, nmi, ari`` of two partitions of the same rows; NMI with the arithmetic mean."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("c"))
    ent = lambda c: -F.sum(c * F.log(c))
    pick = lambda c: F.sum(c * (c - 1) / 2)
    part = lambda k, s: x.groupBy(k).agg(F.sum("c").alias("c")).agg(ent(F.col("c")).alias(f"h{s}"), pick(F.col("c")).alias(f"p{s}"))
    whole = x.agg(F.sum("c").alias("n"), ent(F.col("c")).alias("hab"), pick(F.col("c")).alias("pab"))
    one = reduce(DataFrame.crossJoin, [whole, part("a", "a"), part("b", "b")])  # three single rows
    n = F.col("n")
    entropy = lambda h: F.log(n) + F.col(h) / n
    ha, hb, hab = entropy("ha"), entropy("hb"), entropy("hab")
    mean = (ha + hb) / 2
    nmi = F.when(F.abs(mean) < 1e-12, 1.0).otherwise((ha + hb - hab) / mean)
    expected = F.col("pa") * F.col("pb") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("pab") - expected) / top)
    return one.select(n.cast("long").alias("n"), F.round(nmi, 4).alias("nmi"), F.round(ari, 4).alias("ari"))
