"""Summaries, joins with coverage, and stacked group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.stats import ONE_PASS, cumulated
from tessella.scratch import written


def with_shares(df: DataFrame, value: str, *ties: str, most: int = ONE_PASS) -> DataFrame:
    """``df``, written, with ``pct`` of the column's total and ``cum_pct``, running from the largest value; ties by ``ties``."""
    df = written(df, "shares")
    total = df.agg(F.sum(value).alias("_total"))  # one row
    out = df.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100 * F.col(value) / F.col("_total"), 2)).drop("_total")
    out = out.withColumn("_k", F.struct((-F.col(value)).alias("v"), *ties))
    return cumulated(out, "_k", "pct", "cum_pct", most=most).withColumn("cum_pct", F.round("cum_pct", 2)).drop("_k")


def by_item(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observed items with counts, shares and catalogue columns."""
    out = facts.where("item_id is not null").groupBy("item_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("author_id").alias("n_authors"), F.sum("likes").alias("likes"),
    )
    out = with_shares(out.join(catalog, "item_id"), "n_rows", "item_id")
    return out.select(
        "item_id", "title", "channel_id", "category", "views", "n_rows", "n_authors", "likes", "pct",
        "cum_pct",
        F.round(F.col("n_authors") / F.col("n_rows"), 3).alias("authors_per_row"),
        F.round(1000 * F.col("n_rows") / F.col("views"), 3).alias("rows_per_1k_views"),
    )


def by_channel(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Channels with observed counts beside the catalogue's item counts."""
    whole = catalog.groupBy("channel_id").agg(F.count("*").alias("n_catalog_items"))
    seen = facts.join(catalog.select("item_id", "channel_id"), "item_id").groupBy("channel_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("author_id").alias("n_authors"), F.sum("likes").alias("likes"),
    )
    return with_shares(seen.join(whole, "channel_id"), "n_rows", "channel_id")


def by_author(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Authors with items, channels, likes and their first and last fact."""
    named = facts.where("author_id is not null").join(catalog.select("item_id", "channel_id"), "item_id", "left")
    return named.groupBy("author_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("channel_id").alias("n_channels"),
        F.sum("likes").alias("likes"), F.min_by("source", "fact_id").alias("first_source"), F.round(F.avg("value"), 4).alias("mean_value"),
    )


def catalog_summary(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """All catalogue items; unobserved ones have zero counts and a flag that says so."""
    seen = facts.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("author_id").alias("a"), F.sum("likes").alias("l"))
    out = catalog.join(seen, "item_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "item_id", "title", "channel_id", "category", "views", zero("n").alias("n_rows"), zero("a").alias("n_authors"), zero("l").alias("likes"), F.col("n").isNotNull().alias("observed"),
    )


def integrate(facts: DataFrame, catalog: DataFrame, key: str = "item_id") -> DataFrame:
    """Left join with ``_f`` and ``_c`` suffixes on shared names and a match indicator."""
    shared = (set(facts.columns) & set(catalog.columns)) - {key}
    left = facts.select(*(F.col(c).alias(f"{c}_f" if c in shared else c) for c in facts.columns))
    right = catalog.select(*(F.col(c).alias(f"{c}_c" if c in shared else c) for c in catalog.columns), F.lit(True).alias("matched"))
    return left.join(right, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def join_coverage(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: matched and unmatched rows and keys on either side."""
    keys = facts.groupBy("item_id").agg(F.count("*").alias("n"))
    both = keys.join(catalog.select("item_id", F.lit(1).alias("c")).distinct(), "item_id", "full")
    hit = F.col("n").isNotNull() & F.col("c").isNotNull()
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fact_rows"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("matched_rows"),
        F.count(F.when(F.col("n").isNotNull(), 1)).alias("fact_keys"),
        F.count(F.when(F.col("c").isNotNull(), 1)).alias("catalog_keys"),
        F.count(F.when(hit, 1)).alias("shared_keys"),
        F.count(F.when(F.col("c").isNull(), 1)).alias("fact_only_keys"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("catalog_only_keys"),
        F.round(100 * F.count(F.when(hit, 1)) / F.count("c"), 2).alias("pct_observed"),
    )


def group_comparison(df: DataFrame, groupings: dict[str, str], label: str, labels: list[str], confidence: str, least: int = 10) -> DataFrame:
    """Label distributions of several groupings in one pass.

    ``groupings`` maps the name of a grouping to its column. Small groups are marked as not
    comparable and never left out; rows whose group is null form a group of their own. The net
    polarity is the share of the last label less that of the first; ties of the majority label
    go to the smallest label.
    """
    names = list(groupings)
    cols = [F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(groupings.values())]
    base = df.select(*cols, F.col(label).alias("_label"), F.col(confidence).alias("_conf"))
    keys = [F.col(f"g{i}") for i in range(len(names))]
    out = base.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        *(F.count(F.when(F.col("_label") == x, 1)).alias(f"n_{x}") for x in labels),
        F.round(F.avg("_conf"), 4).alias("mean_confidence"),
        F.round(F.median("_conf"), 4).alias("median_confidence"),
    )
    # In a grouping set exactly one key is not aggregated away: its bit in the grouping id is 0.
    full = (1 << len(names)) - 1
    which = lambda i: full ^ (1 << (len(names) - 1 - i))
    grouping, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(names):
        grouping = F.when(F.col("gid") == which(i), F.lit(name)).otherwise(grouping)
        group = F.when(F.col("gid") == which(i), F.col(f"g{i}")).otherwise(group)
    pct = {x: F.round(100 * F.col(f"n_{x}") / F.col("n"), 2) for x in labels}
    most = F.greatest(*(F.col(f"n_{x}") for x in labels))
    major = F.lit(None).cast("string")
    for x in sorted(labels, reverse=True):
        major = F.when(F.col(f"n_{x}") == most, F.lit(x)).otherwise(major)
    return out.select(
        grouping.alias("grouping"), group.alias("grp"), "n", (F.col("n") >= least).alias("comparable"),
        *(F.col(f"n_{x}") for x in labels), *(p.alias(f"pct_{x}") for x, p in pct.items()),
        "mean_confidence", "median_confidence", F.round(pct[labels[-1]] - pct[labels[0]], 2).alias("net_polarity"), major.alias("majority"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` of one column by another, zero-filled; explicit values need no extra pass."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def counts_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_each")).groupBy("rows_each").agg(F.count("*").alias("n_keys"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
