"""Concentration of counts over units: Gini, top-k shares, thresholds, Lorenz points.

Inputs are aggregated to one row a unit first; a second aggregation to distinct values with their
multiplicity makes the ordered part as small as the number of different counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.stats import ONE_PASS, cumulated
from tessella.scratch import written


def _histogram(units: DataFrame, value: str, most: int = ONE_PASS) -> DataFrame:
    """Distinct values with multiplicities, and units and mass up to each, from the smallest.

    More than ``most`` distinct values are summed up in ranges.
    """
    h = units.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    h = written(h.withColumn("vm", F.col("v") * F.col("m")), "histogram")
    return cumulated(cumulated(h, "v", "m", "cm", most=most), "v", "vm", "cv", most=most).select("v", "m", "cm", "cv")


def gini(units: DataFrame, value: str) -> DataFrame:
    """One row ``n, total, gini``: the sum of (2i - n - 1) x_i over n times the total; null for no mass."""
    h = _histogram(units, value)
    # The i of a value with multiplicity m run from cm - m + 1 to cm.
    ranks = F.sum(F.col("v") * (F.col("m") * (2 * F.col("cm") - F.col("m") + 1)))
    sums = h.agg(ranks.alias("r"), F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("total"))
    g = (F.col("r") - (F.col("n") + 1) * F.col("total")) / F.nullif(F.col("n") * F.col("total"), F.lit(0.0))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.round(g, 4).alias("gini"))


def concentration(units: DataFrame, value: str, tops: tuple[int, ...] = (1, 3, 5, 10), shares: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """One row: units, total, Gini, variation, largest, median, top-k mass and units for a share."""
    h = _histogram(units, value)
    whole = h.agg(
        F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("total"), F.max("v").alias("max"),
        F.sum(F.col("v") * (F.col("m") * (2 * F.col("cm") - F.col("m") + 1))).alias("r"),
        F.sum(F.col("v") * F.col("v") * F.col("m")).alias("sq"), F.expr("percentile(v, 0.5D, m)").alias("median"),
    )
    # One row against as many rows as there are different counts.
    x = h.crossJoin(F.broadcast(whole.select("n", "total")))
    over = F.col("n") - F.col("cm")  # units with a larger value
    top = lambda k: F.sum(F.col("v") * F.greatest(F.least(F.col("m"), k - over), F.lit(0)))
    mass_over = F.col("total") - F.col("cv")
    # Units whose running share from the largest stays below s: all above, and some of this value.
    below = lambda s: F.sum(
        F.when(F.col("v") > 0, F.greatest(F.least(F.ceil((s * F.col("total") - mass_over) / F.col("v") - 1e-9) - 1, F.col("m")), F.lit(0))).otherwise(0)
    )
    parts = x.agg(*(top(k).alias(f"top{k}_n") for k in tops), *(below(s).alias(f"b{int(100 * s)}") for s in shares))
    out = whole.crossJoin(F.broadcast(parts))
    mean = F.col("total") / F.col("n")
    sd = F.sqrt((F.col("sq") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0)))
    units_for = lambda s: F.least(F.coalesce(F.col(f"b{int(100 * s)}"), F.lit(0)) + 1, F.col("n")).cast("long")
    return out.select(
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"),
        F.round((F.col("r") - (F.col("n") + 1) * F.col("total")) / F.nullif(F.col("n") * F.col("total"), F.lit(0.0)), 4).alias("gini"),
        F.round(sd / F.nullif(mean, F.lit(0.0)), 3).alias("cv"), "max", "median",
        *(F.col(f"top{k}_n") for k in tops), *(F.round(100 * F.col(f"top{k}_n") / F.nullif("total", F.lit(0.0)), 2).alias(f"top{k}_pct") for k in tops),
        *(units_for(s).alias(f"units_for_{int(100 * s)}pct") for s in shares),
        *(F.round(100 * units_for(s) / F.greatest(F.col("n"), F.lit(1)), 2).alias(f"pct_units_for_{int(100 * s)}pct") for s in shares),
    )


def lorenz(units: DataFrame, value: str) -> DataFrame:
    """Lorenz points after each distinct value: share of units against share of mass."""
    h = _histogram(units, value)
    x = h.crossJoin(F.broadcast(h.agg(F.max("cm").alias("n"), F.max("cv").alias("total"))))  # one row
    return x.select(F.col("v").alias("value"), F.col("cm").alias("units"), F.round(F.col("cm") / F.col("n"), 6).alias("unit_share"), F.round(F.col("cv") / F.col("total"), 6).alias("mass_share"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    h = _histogram(df, value)
    x = h.crossJoin(F.broadcast(h.agg(F.max("cm").alias("n"))))  # one row
    return x.select(F.col("v").alias("value"), F.round(F.col("cm") / F.col("n"), 6).alias("share"))


def log_histogram(df: DataFrame, value: str) -> DataFrame:
    """Rows by the power of ten of value + 1."""
    return df.where(F.col(value) >= 0).groupBy(F.floor(F.log10(F.col(value) + 1)).cast("int").alias("power")).agg(F.count("*").alias("n"))
