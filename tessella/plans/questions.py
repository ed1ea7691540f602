"""The eleven standing questions about participation, each one row or a short table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import tokens
from tessella.operators import distances, graph, relational, stats
from tessella.operators.concentration import concentration
from tessella.operators.scoring import score_texts
from tessella.scratch import written
from tessella.sources import tables


def _beside(*rows: DataFrame) -> DataFrame:
    """Single rows side by side."""
    return reduce(DataFrame.crossJoin, rows)


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.participation(spark, sf_dir), tables.catalog(spark, sf_dir)


def m1_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channels concentrate participation: the first five with their shares and the Gini."""
    channels = relational.by_channel(*_facts(spark, sf_dir))
    whole = concentration(channels, "n_rows").select(F.col("gini").alias("gini_channels"))
    return relational.top_k(channels, 5, F.desc("n_rows"), F.col("channel_id")).select("channel_id", "n_rows", "n_items", "n_authors", "pct").crossJoin(F.broadcast(whole))


def m2_shared_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much audience items share: authors of several items and channels, and projected density."""
    facts, catalog = tables.participation(spark, sf_dir), tables.catalog(spark, sf_dir)
    authors = relational.by_author(facts, catalog).agg(
        F.count("*").alias("n_authors"), F.count(F.when(F.col("n_items") > 1, 1)).alias("multi_item"), F.count(F.when(F.col("n_channels") > 1, 1)).alias("multi_channel")
    )
    edges = graph.bipartite_edges(facts)
    items = edges.agg(F.count_distinct("item_id").alias("n_items"))
    pairs = graph.projection(edges, "item_id", "author_id").agg(F.count("*").alias("shared_pairs"), F.coalesce(F.max("weight"), F.lit(0)).alias("most_shared"))
    density = F.round(2 * F.col("shared_pairs") / F.nullif(F.col("n_items") * (F.col("n_items") - 1.0), F.lit(0.0)), 6)
    return _beside(authors, items, pairs).withColumn("density", density)


def m3_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors without whom the item network falls apart further."""
    edges = graph.bipartite_edges(tables.participation(spark, sf_dir))
    found = graph.bridge_authors(edges, tables.catalog(spark, sf_dir)).where("is_bridge")
    return found.select("author", "n_items", "n_channels", "delta_components", "lost_edges")


def m4_tone_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of the corpus by group."""
    scored = score_texts(tables.documents(spark, sf_dir), "text")
    return relational.group_comparison(scored, {"lang": "lang"}, "predicted", ["NEG", "NEU", "POS"], "confidence")


def m5_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does visibility go with participation: rank correlation and the most seen and most active item."""
    items = relational.by_item(*_facts(spark, sf_dir))
    most = items.agg(
        F.max_by("item_id", F.struct("views", -F.col("item_id"))).alias("most_viewed"), F.max_by("item_id", F.struct("n_rows", -F.col("item_id"))).alias("most_active"),
        F.max_by("item_id", F.struct("rows_per_1k_views", -F.col("item_id"))).alias("most_engaging"),
    )
    seen = relational.catalog_summary(*_facts(spark, sf_dir))
    test = stats.mann_whitney(seen, "views", ~F.col("observed")).select("u", F.col("p").alias("u_p"))
    return _beside(stats.spearman(items, "views", "n_rows"), test, most)


def m6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the observed part covers, and the dominant source."""
    facts, catalog = _facts(spark, sf_dir)
    cover = relational.join_coverage(facts, catalog)
    source = facts.groupBy("source").agg(F.count("*").alias("n"))
    top = source.agg(F.max_by("source", F.struct("n", "source")).alias("dominant_source"), F.round(100 * F.max("n") / F.sum("n"), 2).alias("dominant_pct"))
    return _beside(cover, top)


def a1_recurrent_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do authors who come back cross channels."""
    facts, catalog = tables.participation(spark, sf_dir), tables.catalog(spark, sf_dir)
    back = relational.by_author(facts, catalog).where("n_rows > 1")
    return back.agg(
        F.count("*").alias("recurrent"), F.count(F.when(F.col("n_items") > 1, 1)).alias("several_items"), F.count(F.when(F.col("n_channels") > 1, 1)).alias("several_channels"),
        F.round(100 * F.avg((F.col("n_channels") > 1).cast("double")), 2).alias("pct_crossing"),
    )


def a2_likes_and_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes against author diversity over items: three rank correlations."""
    items = relational.by_item(*_facts(spark, sf_dir))
    named = [("likes", "n_authors"), ("likes", "n_rows"), ("n_authors", "views")]
    return reduce(DataFrame.unionByName, (stats.spearman(items, a, b).select(F.lit(f"{a} ~ {b}").alias("pair"), "n", "rho", "p") for a, b in named))


def a3_source_and_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the source determine the channel: agreement of the two partitions."""
    facts, catalog = _facts(spark, sf_dir)
    return stats.agreement(facts.join(catalog.select("item_id", "channel_id"), "item_id"), "source", "channel_id")


def a4_tone_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone against length: Kruskal-Wallis over the classes, of words and of characters, and length against confidence."""
    scored = score_texts(tables.documents(spark, sf_dir), "text").withColumn("len", F.size(tokens(F.col("text"))))
    medians = scored.groupBy().pivot("predicted", ["NEG", "NEU", "POS"]).agg(F.median("len"))
    alike = stats.spearman(scored, "len", "confidence").select("rho", F.col("p").alias("rho_p"))
    chars = stats.kruskal(scored.withColumn("chars", F.length("text")), "chars", "predicted").select(F.col("h").alias("h_chars"), F.col("p").alias("h_chars_p"))
    return _beside(stats.kruskal(scored, "len", "predicted"), alike, chars, medians.select(*(F.col(x).alias(f"median_{x}") for x in ("NEG", "NEU", "POS"))))


def a5_visibility_and_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does visibility predict an item's place in the network: three rank correlations."""
    facts, catalog = tables.participation(spark, sf_dir), tables.catalog(spark, sf_dir)
    edges = graph.bipartite_edges(facts)
    nodes = edges.select(F.col("dst").alias("node_id"), "item_id").distinct()
    pairs = written(graph.projection(edges, "dst", "src"), "projection")
    n = nodes.agg(F.count("*").alias("n"))  # one row
    through = distances.path_sums(nodes, pairs, True).crossJoin(F.broadcast(n))
    through = through.select("node_id", F.round(F.coalesce(F.col("through") / F.nullif((F.col("n") - 1) * (F.col("n") - 2), F.lit(0)), F.lit(0.0)), 6).alias("weighted_betweenness"))
    pos = graph.degrees(nodes, pairs).join(nodes, "node_id").join(through, "node_id").join(catalog.select("item_id", "views"), "item_id")
    pos = written(pos, "places")
    return reduce(DataFrame.unionByName, (stats.spearman(pos, "views", c).select(F.lit(c).alias("measure"), "n", "rho", "p") for c in ("degree", "strength", "weighted_betweenness")))


#: The questions in words.
TEXTS = {
    "q_m1": "Which channels concentrate participation?", "q_m2": "How much audience do items share?", "q_m3": "Who holds the item network together?", "q_m4": "What is the tone of each group?",
    "q_m5": "Does visibility go with participation?", "q_m6": "What does the observed part cover?", "q_a1": "Do authors who come back cross channels?", "q_a2": "Do likes go with the diversity of authors?",
    "q_a3": "Does the source determine the channel?", "q_a4": "Does tone go with length?", "q_a5": "Does visibility predict an item's place in the network?",
}


def questions_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question, text, answer``: a row for each row of each question's answer, as JSON."""
    parts = []
    for name, ask in QUESTIONS.items():
        rows = ask(spark, sf_dir).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("answer"))
        parts.append(rows.select(F.lit(name).alias("question"), F.lit(TEXTS[name]).alias("text"), "answer"))
    return reduce(DataFrame.unionByName, parts)


QUESTIONS = {
    "q_m1": m1_concentration, "q_m2": m2_shared_audience, "q_m3": m3_bridges, "q_m4": m4_tone_by_language, "q_m5": m5_visibility, "q_m6": m6_coverage,
    "q_a1": a1_recurrent_authors, "q_a2": a2_likes_and_diversity, "q_a3": a3_source_and_channel, "q_a4": a4_tone_and_length, "q_a5": a5_visibility_and_position,
}
