"""Frequencies of words, n-grams, tags; TF-IDF by group; effect of cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.stats import ONE_PASS
from tessella.scratch import written


def term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """``term, frequency``, of a list column."""
    return df.select(F.explode(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("frequency"))


def top_terms(df: DataFrame, terms: Column, k: int) -> DataFrame:
    """The k most frequent terms; ties by term."""
    return term_counts(df, terms).orderBy(F.desc("frequency"), "term").limit(k)


def top_ngrams(df: DataFrame, key: str, words: Column, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams with their share of all n-grams and of documents that have words.

    N-grams don't cross documents; rows that repeat a key are documents of their own. Each n-gram
    comes once for every place and once for its document, so one shuffle by term, after partial
    sums, gives both counts.
    """
    docs = df.select(words.alias("w")).where("size(w) > 0")
    grams = docs.select(T.ngrams(F.col("w"), n).alias("g"))
    one = lambda f, d: lambda x: F.struct(x.alias("term"), F.lit(f).alias("f"), F.lit(d).alias("d"))
    both = grams.select(F.explode(F.concat(F.transform("g", one(1, 0)), F.transform(F.array_distinct("g"), one(0, 1)))).alias("x")).select("x.*")
    counted = both.groupBy("term").agg(F.sum("f").alias("frequency"), F.sum("d").alias("documents"))
    sums = docs.agg(F.count("*").alias("nd"), F.sum(F.greatest(F.size("w") - n + 1, F.lit(0))).alias("ng"))
    best = counted.orderBy(F.desc("frequency"), "term").limit(k).crossJoin(F.broadcast(sums))  # one row
    return best.select(
        "term", "frequency", F.round(100 * F.col("frequency") / F.col("ng"), 3).alias("pct_total"), "documents", F.round(100 * F.col("documents") / F.col("nd"), 2).alias("pct_documents")
    )


def _followed(ends: DataFrame, most: int) -> DataFrame:
    """``ends(g, o, f, l)`` with the ``f`` of the next row of its group, if there is one, as ``after``.

    Up to ``most`` rows are ordered group by group. More are cut into ranges of group and order,
    whatever the groups' sizes; the last row of a range is followed by the first of the next.
    """
    if ends.count() <= most:
        return ends.withColumn("after", F.lead("f").over(Window.partitionBy("g").orderBy("o"))).where("after is not null")
    cut = written(ends.repartitionByRange("g", "o").withColumn("_range", F.spark_partition_id()), "ends")
    own = Window.partitionBy("_range").orderBy("g", "o")
    placed = cut.withColumn("_next", F.lead(F.struct("g", "f")).over(own))
    firsts = cut.groupBy("_range").agg(F.min(F.struct("g", "o", "f")).alias("x"))  # one row a range
    firsts = firsts.select("_range", F.lead("x").over(Window.orderBy("_range")).alias("x")).select("_range", F.struct("x.g", "x.f").alias("_first"))
    placed = placed.join(F.broadcast(firsts), "_range").withColumn("_next", F.coalesce("_next", "_first"))
    return placed.where("_next.g = g").withColumn("after", F.col("_next.f")).drop("_next", "_first", "_range")


def group_terms(df: DataFrame, group: str, order: str, words: Column, most: int = ONE_PASS) -> DataFrame:
    """``g, term, as_word, as_pair, raw`` of the words and word pairs of each group, counted once and written.

    ``as_word`` and ``as_pair`` count places inside documents. ``raw`` is the weight before the norm:
    the group is one document, term frequency is 1 + ln(count), the inverse frequency
    ln((1 + N) / (1 + df)) + 1; it is null where there are fewer than two groups. Pairs that cross
    the border of two documents of a group that follow one another in ``order`` count for ``raw`` alone.

    A group's texts are never gathered: pairs inside a document are made in place, and the border
    pairs from the last and first word of neighbours.
    """
    docs = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), words.alias("w")).where("size(w) > 0")
    ends = docs.select("g", "o", F.element_at("w", 1).alias("f"), F.element_at("w", -1).alias("l"))
    border = _followed(ends, most).select("g", F.concat_ws(" ", "l", "after").alias("term"), F.lit(0).alias("kind"))
    inside = docs.select("g", F.size("w").alias("n"), F.posexplode(F.concat("w", T.ngrams(F.col("w"), 2))).alias("at", "term"))
    inside = inside.select("g", "term", F.when(F.col("at") < F.col("n"), 1).otherwise(2).alias("kind"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    counts = inside.unionByName(border).groupBy("g", "term").agg(F.count("*").alias("c"), of(1).alias("as_word"), of(2).alias("as_pair"))
    n = docs.select("g").distinct().agg(F.count("*").alias("n"))  # one row
    # A term has as many rows as groups that hold it.
    counts = counts.withColumn("df", F.count("*").over(Window.partitionBy("term"))).crossJoin(F.broadcast(n))
    raw = (1 + F.log("c")) * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)
    return written(counts.select("g", "term", "as_word", "as_pair", F.when(F.col("n") > 1, raw).alias("raw")), "terms")


def weightiest(terms: DataFrame, k: int) -> DataFrame:
    """``grp, place, term, weight``: the k weightiest of :func:`group_terms`, divided by the group's Euclidean norm; ties by term."""
    raw = terms.where("raw is not null").select("g", "term", "raw")
    norms = raw.groupBy("g").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weighted = raw.join(F.broadcast(norms), "g").select("g", "term", F.round(F.col("raw") / F.col("norm"), 5).alias("weight"))  # one row a group
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "term"))
    return weighted.withColumn("place", place).where(F.col("place") <= k).select(F.col("g").alias("grp"), "place", "term", "weight")


def tfidf_by_group(df: DataFrame, group: str, order: str, words: Column, k: int, most: int = ONE_PASS) -> DataFrame:
    """The k weightiest words and word pairs of each group, taken as one document; fewer than two groups give no rows."""
    return weightiest(group_terms(df, group, order, words, most), k)


def cleaning_effect(df: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """One row: what cleaning does to a corpus, before and after, in one pass."""
    x = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), T.content_tokens(F.col(text), stop).alias("w"))
    x = x.select(
        F.length("t").alias("lo"), F.size(T.tokens(F.col("t"))).alias("to"), F.length(F.array_join("w", " ")).alias("lc"), F.size("w").alias("tc"),
        F.size(T.extract_hashtags(F.col("t"))).alias("h"), F.size(T.extract_mentions(F.col("t"))).alias("m"), F.size(T.extract_urls(F.col("t"))).alias("u"), F.size(T.extract_emojis(F.col("t"))).alias("e"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    has = lambda c: F.count(F.when(F.col(c) > 0, 1))
    return x.agg(
        F.count("*").alias("n_texts"), total("lo").alias("chars_before"), total("lc").alias("chars_after"), total("to").alias("tokens_before"), total("tc").alias("tokens_after"),
        F.round(F.avg("lo"), 3).alias("mean_chars_before"), F.round(F.avg("lc"), 3).alias("mean_chars_after"), F.round(F.avg("to"), 3).alias("mean_tokens_before"), F.round(F.avg("tc"), 3).alias("mean_tokens_after"),
        F.median("to").alias("median_tokens_before"), F.median("tc").alias("median_tokens_after"), F.count(F.when(F.col("to") == 0, 1)).alias("empty_before"), F.count(F.when(F.col("tc") == 0, 1)).alias("empty_after"),
        total("h").alias("hashtags"), total("m").alias("mentions"), total("u").alias("urls"), total("e").alias("emojis"), has("h").alias("with_hashtags"), has("m").alias("with_mentions"), has("u").alias("with_urls"), has("e").alias("with_emojis"),
        F.round(100 * (1 - F.sum("tc") / F.nullif(F.sum("to"), F.lit(0))), 2).alias("pct_tokens_removed"),
    )
