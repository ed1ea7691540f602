"""URL filters by a temporal list join, in DataFrame operations.

Dated list entries (added, removed) become validity intervals; an as-of join evaluates every
capture against the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; empty if there is none."""
    found = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\\\s]+)", 1)
    return F.lower(F.regexp_replace(found, r"\.$", ""))


def first_segment(url: Column) -> Column:
    """First path segment without query, fragment and extension; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#.]+)", 1)


def keys_of(host: Column, segment: Column) -> Column:
    """Entries that could cover a URL: host and segment, host, and its parent domains to two labels."""
    parts = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    own = F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(own, parents))).otherwise(F.array().cast("array<string>"))


def path_prefixes(url: Column, deepest: Column | None = None) -> Column:
    """The path up to each of its segments, case and file names kept, without query and fragment.

    ``deepest`` segments at most, if given: longer prefixes of a long path are never made.
    """
    path = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.split(path, "/")
    if deepest is not None:
        parts = F.slice(parts, F.lit(1), F.greatest(deepest, F.lit(1)))
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.filter(upto, lambda p: (p != "") & ~p.endswith("/"))


def covering(host: Column, url: Column, deepest: Column | None = None) -> Column:
    """All entries that could cover a URL: those of :func:`keys_of`, and the host with every path prefix."""
    keys = keys_of(host, first_segment(url))
    return F.when(host != "", F.array_union(keys, F.transform(path_prefixes(url, deepest), lambda p: F.concat_ws("/", host, p)))).otherwise(keys)


def validity(entries: DataFrame) -> DataFrame:
    """``(entry, list, since, until)`` from dated events ``(entry, list, day, action)``.

    An ``add`` holds from its day until the next event of the same entry and list (exclusive; null:
    for good). Hosts are lowered, paths keep their case. On one day a ``remove`` comes after an
    ``add``, so it wins. Events that lack an entry, a day or a known action are ignored; repeated
    events change nothing.
    """
    host = F.substring_index("entry", "/", 1)
    known = entries.where("entry is not null and day is not null and action in ('add', 'remove')").select(
        F.concat(F.lower(host), F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")).alias("entry"), F.coalesce("list", F.lit("")).alias("list"), F.col("day").cast("date").alias("day"), "action"
    )
    daily = known.groupBy("entry", "list", "day").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    after = F.lead("day").over(Window.partitionBy("entry", "list").orderBy("day"))
    spans = daily.select("entry", "list", F.col("day").alias("since"), after.alias("until"), "action")
    return spans.where("action = 'add'").drop("action")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with the list entries active on the day it was fetched.

    ``captures(page_id, url, day)``, other columns are ignored; ``entries`` as in :func:`validity`.
    Returns per capture ``page_id, day, host, n_active`` (active entries that cover the URL),
    ``entry, list`` (the longest of them, of ties the smallest), ``since`` and ``listed``. URLs that
    are null or not absolute, and captures without a day, are covered by nothing. Captures may
    repeat; without captures there are no rows, without entries none is listed. A host with many captures is a skewed join side, which is split at run time: the
    other side has a few rows for each entry.
    """
    rows = captures.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("day").cast("date").alias("day"),
        host_of(F.col("url")).alias("host"),
        F.col("url").cast("string").alias("url"),
    )
    spans = validity(entries)
    # No entry is covered by a longer path than the deepest entry's.
    depth = spans.agg(F.coalesce(F.max(F.size(F.split("entry", "/")) - 1), F.lit(0)).alias("deepest"))  # one row
    keys = rows.crossJoin(F.broadcast(depth)).select("uid", "page_id", "day", "host", F.explode_outer(covering(F.col("host"), F.col("url"), F.col("deepest"))).alias("key"))
    active = (F.col("key") == F.col("entry")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    met = keys.join(spans, active, "left").select("uid", "page_id", "day", "host", "entry", "list", "since")
    best = F.min(F.when(F.col("entry").isNotNull(), F.struct((-F.length("entry")).alias("k"), "entry", "list", "since"))).alias("best")
    out = met.groupBy("uid", "page_id", "day", "host").agg(F.count("entry").alias("n_active"), best)
    return out.select("page_id", "day", "host", "n_active", "best.entry", "best.list", "best.since", (F.col("n_active") > 0).alias("listed"))
