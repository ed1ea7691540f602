"""Whole-table relations: descriptives, coverage, network measures, checks, communities, figure data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import blocks, centrality, distances, graph, quality, stats, walks
from tessella.operators.concentration import gini

#: p-values below this are marked as significant.
ALPHA = 0.05


def unpivoted(one: DataFrame, prefix: str = "") -> DataFrame:
    """A single row as ``metric, value``, to six decimals."""
    cells = F.array(*(F.struct(F.lit(prefix + c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in one.columns))
    return one.select(F.explode(cells).alias("r")).select("r.metric", "r.value")


def described(df: DataFrame, value: str, name: str) -> DataFrame:
    """The twelve descriptive measures of a column as ``name.measure`` metrics."""
    return unpivoted(stats.distribution(df, value), f"{name}.")


def eda_descriptives(facts: DataFrame, catalog: DataFrame, texts: DataFrame) -> DataFrame:
    """``metric, value``: universes, coverage, distributions of items, authors, views and likes, text marks.

    Measures that have parts are written out as ``name.part``. Every table is aggregated once for
    each of its grains; nothing but sums leaves the executors.
    """
    by_channel = catalog.groupBy("channel_id").agg(F.count("*").alias("k"))
    by_item = facts.where("item_id is not null").groupBy("item_id").agg(F.count("*").alias("k"), F.count_distinct("author_id").alias("a"))
    seen = catalog.join(by_item, "item_id", "left")
    named = facts.where("author_id is not null").join(catalog.select("item_id", "channel_id"), "item_id", "left")
    authors = named.groupBy("author_id").agg(F.count("*").alias("k"), F.count_distinct("item_id").alias("i"), F.count_distinct("channel_id").alias("c"))
    count = lambda c: F.count(F.when(c, 1))
    pct = lambda c: F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double")), 2)
    known = F.col("k").isNotNull()
    universe = seen.agg(
        F.count("*").alias("catalog_items"), F.count_distinct("channel_id").alias("catalog_channels"), F.count_distinct("category").alias("categories"),
        count(known).alias("observed_items"), count(~known).alias("unobserved_items"), pct(known).alias("pct_observed_items"),
        F.count_distinct(F.when(known, F.col("channel_id"))).alias("observed_channels"),
        F.round(100 * F.count_distinct(F.when(known, F.col("channel_id"))) / F.count_distinct("channel_id"), 2).alias("pct_observed_channels"),
        F.round(F.sum("views"), 2).alias("sum_views"),
    )
    rows = facts.agg(
        F.count("*").alias("facts"), F.count_distinct("author_id").alias("authors"), F.count_distinct("source").alias("sources"),
        F.round(F.count("*") / F.count_distinct("author_id"), 3).alias("rows_per_author"), F.sum("likes").alias("sum_likes"),
        count(F.col("likes") == 0).alias("zero_likes"), pct(F.col("likes") == 0).alias("pct_zero_likes"), F.round(F.sum("value"), 2).alias("sum_value"),
        count(F.col("value") > 100).alias("value_above_100"), pct(F.col("value") > 100).alias("pct_value_above_100"), F.count_distinct("likes").alias("distinct_likes"),
    )
    people = authors.agg(
        count(F.col("k") == 1).alias("authors_with_one_row"), pct(F.col("k") == 1).alias("pct_authors_with_one_row"), count(F.col("i") > 1).alias("authors_in_several_items"),
        pct(F.col("i") > 1).alias("pct_authors_in_several_items"), count(F.col("c") > 1).alias("authors_in_several_channels"), F.max("k").alias("most_rows_of_an_author"), F.max("i").alias("most_items_of_an_author"),
    )
    marks = texts.select(F.size(T.extract_mentions(F.col("text"))).alias("m"), F.size(T.extract_emojis(F.col("text"))).alias("e"), F.size(T.extract_hashtags(F.col("text"))).alias("h"), F.size(T.extract_urls(F.col("text"))).alias("u"))
    marked = marks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("h", "hashtags"), ("e", "emojis"), ("m", "mentions"), ("u", "urls"))))
    tags = texts.select(F.explode(T.extract_hashtags(F.col("text"))).alias("t")).agg(F.count_distinct("t").alias("distinct_hashtags"))
    best = by_channel.orderBy(F.desc("k"), "channel_id").limit(10).select(F.concat(F.lit("items_of_top_channel."), "channel_id").alias("metric"), F.col("k").cast("double").alias("value"))
    spread = authors.groupBy("k").agg(F.count("*").alias("n")).select(F.concat(F.lit("authors_by_rows."), F.col("k").cast("string")).alias("metric"), F.col("n").cast("double").alias("value"))
    parts = [unpivoted(x) for x in (universe, rows, people, marked, tags, by_channel.agg(count(F.col("k") == 1).alias("channels_with_one_item")))]
    parts += [
        described(by_channel, "k", "items_per_channel"), described(by_item, "k", "rows_per_item"), described(by_item, "a", "authors_per_item"),
        described(catalog, "views", "views"), described(seen.where(known), "views", "views_observed"), described(facts, "likes", "likes"), described(facts, "value", "value"),
    ]
    return reduce(DataFrame.unionByName, [*parts, best, spread])


def min_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with descending ranks of a column in which ties share the smallest; null values have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    ranks = stats.cumulated(counts, "_v", "_m", "_before", descending=True).select("_v", (F.col("_before") - F.col("_m") + 1).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def coverage_bias(items: DataFrame) -> DataFrame:
    """One row: are observed items the most viewed ones; ``items`` has ``views`` and ``observed``."""
    ranked = min_ranks(items.select("views", "observed"), "views", "rank").where("views is not null")
    on, of = F.col("observed"), lambda c, f: f(F.when(F.col("observed"), F.col(c)))
    off = lambda f: f(F.when(~on, F.col("views")))
    sides = ranked.agg(
        F.count(F.when(on, 1)).alias("n_observed"), F.count(F.when(~on, 1)).alias("n_unobserved"),
        F.round(of("views", F.avg), 1).alias("mean_observed"), F.round(off(F.avg), 1).alias("mean_unobserved"), of("rank", F.min).alias("min_rank"), of("rank", F.max).alias("max_rank"),
    )
    middle = lambda df, c: stats.quantiles(df, c, "observed", {"m": 0.5})
    side = lambda flag, name: F.round(F.max(F.when(F.col("observed") == flag, F.col("m"))), 4).alias(name)
    views = middle(ranked, "views").agg(side(True, "median_observed"), side(False, "median_unobserved"))
    ranks = middle(ranked.where(on), "rank").agg(F.max("m").alias("median_rank"))
    test = stats.mann_whitney(items, "views", ~on).select("u", "p")
    return sides.crossJoin(views).crossJoin(ranks).crossJoin(test).withColumn("significant", F.coalesce(F.col("p") < ALPHA, F.lit(False)))  # four single rows


def degree_spread(d: DataFrame) -> DataFrame:
    """One row of the distribution of ``degree`` beyond its mean: quantiles, spread, Gini, share of two or less."""
    at = lambda p: F.percentile("degree", F.lit(p))
    one = d.agg(
        F.min("degree").alias("min_degree"), at(0.25).alias("p25_degree"), at(0.75).alias("p75_degree"), at(0.99).alias("p99_degree"), F.round(F.stddev_samp("degree"), 4).alias("std_degree"),
        F.round(100 * F.avg((F.col("degree") <= 2).cast("double")), 2).alias("pct_degree_2_or_less"),
    )
    return one.crossJoin(gini(d, "degree").select(F.col("gini").alias("degree_gini")))  # two single rows


def network_metrics(networks: dict[str, tuple[DataFrame, DataFrame]], bipartite: DataFrame, projected: dict[str, tuple[str, str]]) -> DataFrame:
    """``network, metric, value`` of each network's topology and degree distribution.

    ``networks`` are nodes and edges; ``projected`` are projections of ``bipartite``, from a column of
    nodes through another, whose pairs are not written.
    """
    parts = []
    for name, (nodes, edges) in networks.items():
        parts += [(name, graph.topology(nodes, edges)), (name, degree_spread(graph.degrees(nodes, edges)))]
    for name, (node, through) in projected.items():
        d = graph.degrees_projected(bipartite, node, through)
        parts += [(name, graph.topology_projected(bipartite, node, through, d)), (name, degree_spread(d))]
    return reduce(DataFrame.unionByName, (unpivoted(one).select(F.lit(name).alias("network"), "metric", "value") for name, one in parts))


CENTRALITIES = ["degree", "strength", "weighted_betweenness", "closeness", "harmonic", "pagerank", "eigenvector"]


def node_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a node: all centralities, its component, whether it is a cut point, and three ranks."""
    more = distances.path_measures(nodes, edges), centrality.pagerank(nodes, edges), centrality.eigenvector(nodes, edges), centrality.k_core(nodes, edges), graph.clustering(nodes, edges)
    return _node_centrality(graph.degrees(nodes, edges), graph.components(nodes, edges), blocks.cut_points(nodes, edges), *more)


def node_centrality_projected(edges: DataFrame, node: str, through: str) -> DataFrame:
    """:func:`node_centrality` of a projection, by way of the bipartite ``edges``."""
    nodes = edges.select(F.col(node).alias("node_id")).where("node_id is not null").distinct()
    d = graph.degrees_projected(edges, node, through)
    label = graph.components_projected(edges, node, through)
    more = (
        walks.path_measures_projected(edges, node, through, label), centrality.pagerank_projected(edges, node, through), centrality.eigenvector_projected(edges, node, through, label),
        centrality.k_core_projected(edges, node, through, d, label), graph.clustering_projected(edges, node, through, d, label),
    )
    return _node_centrality(d.drop("top"), label, blocks.cut_points(nodes, graph.skeleton(edges, node, through)), *more)


def _node_centrality(d: DataFrame, label: DataFrame, cuts: DataFrame, paths: DataFrame, pagerank: DataFrame, eigenvector: DataFrame, k_core: DataFrame, clustering: DataFrame) -> DataFrame:
    n = d.agg(F.count("*").alias("n"))  # one row
    size = label.groupBy("component").agg(F.count("*").alias("component_size"))
    walked = paths.select("node_id", "closeness", "harmonic", "betweenness", "weighted_betweenness")
    cuts = cuts.withColumn("is_cut_point", F.lit(True))
    out = d.crossJoin(F.broadcast(n)).withColumn("degree_centrality", F.round(F.coalesce(F.col("degree") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)), 6)).drop("n")
    clustered = clustering.select("node_id", "clustering", "weighted_clustering")
    for more in (walked, pagerank, eigenvector, k_core, clustered, label, cuts):
        out = out.join(more, "node_id", "left")
    out = out.join(size, "component", "left").withColumn("is_cut_point", F.coalesce("is_cut_point", F.lit(False)))
    for c in ("strength", "weighted_betweenness", "pagerank"):
        out = min_ranks(out, c, f"rank_{c}")
    return out


def centrality_correlations(centralities: DataFrame, network: str) -> DataFrame:
    """``network, a, b, n, rho, p, significant``: Spearman's matrix of seven centralities, upper half."""
    x = centralities.select(*(F.col(c).cast("double").alias(c) for c in CENTRALITIES))
    parts = []
    for i, a in enumerate(CENTRALITIES):
        for b in CENTRALITIES[i + 1 :]:
            one = stats.spearman(x, a, b)
            parts.append(one.select(F.lit(network).alias("network"), F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho", "p", F.coalesce(F.col("p") < ALPHA, F.lit(False)).alias("significant")))
    return reduce(DataFrame.unionByName, parts)


def problematic_variables(profile: DataFrame) -> DataFrame:
    """``dataset, column, problem, evidence, treatment``: columns of a profile that need care, by rule.

    Rules in order: nothing known; one value; half or more unknown; lists, counts or relative times
    as text; blanks; a distinct text in every row. Columns that meet none are left out.
    """
    text = F.col("type") == "string"
    rules: list[tuple[Column, str, Column, str]] = [
        (F.col("empty"), "unusable", F.concat(F.col("n_null").cast("string"), F.lit(" nulls")), "leave out"),
        (F.col("constant"), "constant", F.concat(F.lit("one value: "), "example"), "leave out"),
        (F.col("pct_null") >= 50, "mostly missing", F.concat(F.col("pct_null").cast("string"), F.lit(" % null")), "report the known rows"),
        (text & (F.col("kind") == "lista_serializada"), "serialised list", F.lit("lists as text"), "parse before counting"),
        (text & (F.col("kind") == "conteo_como_texto"), "count as text", F.lit("counts as text"), "parse, blanks as zero with a flag"),
        (text & (F.col("kind") == "tiempo_relativo"), "relative time", F.lit("times relative to the reading"), "order only, no dates"),
        (F.col("n_blank") > 0, "blank values", F.concat(F.col("n_blank").cast("string"), F.lit(" blanks")), "null or zero with a flag"),
        (text & F.col("unique_values") & ~F.col("primary_key"), "label", F.concat(F.col("n_unique").cast("string"), F.lit(" distinct texts")), "label only, join on the key"),
    ]
    problem, evidence, treatment = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, name, shown, done in reversed(rules):
        problem, evidence, treatment = F.when(when, name).otherwise(problem), F.when(when, shown).otherwise(evidence), F.when(when, done).otherwise(treatment)
    return profile.select("dataset", "column", problem.alias("problem"), evidence.alias("evidence"), treatment.alias("treatment")).where("problem is not null")


def item_communities(edges: DataFrame, items: DataFrame, partition: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row an item of a partition: its catalogue columns, rows, authors and place in the projection."""
    size = partition.groupBy("community").agg(F.count("*").alias("size"))
    seen = edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("n_rows"), F.count("*").alias("n_authors"))
    out = partition.join(size, "community").join(graph.degrees(partition.select("node_id"), items), "node_id").join(seen, "node_id", "left")
    named = catalog.select(graph.item_node("item_id").alias("node_id"), "item_id", "title", "channel_id", "views")
    return out.join(named, "node_id", "left").withColumn("is_singleton", F.col("size") == 1)


def boxplot_groups(df: DataFrame, value: str, by: str) -> DataFrame:
    """One row a group: quartiles, whiskers at 1.5 interquartile ranges, and how many values lie beyond."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("grp"), F.col(value).cast("double").alias("x"))
    box = rows.groupBy("grp").agg(F.count("*").alias("n")).join(stats.quantiles(rows, "x", "grp", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "grp")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    more = rows.join(box, "grp").groupBy("grp").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count(F.when(~inside, 1)).alias("n_beyond"))
    edges = {c: F.round(c, 6) for c in ("q1", "median", "q3", "low", "high")}
    return box.join(more, "grp").withColumns(edges)


def completeness(df: DataFrame, name: str) -> DataFrame:
    """``dataset, column, n_rows, n_known, pct_known``: values that are neither null nor blank."""
    total = df.agg(F.count("*").alias("n"), *(F.count(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_known")) for i, c in enumerate(df.columns)))
    out = total.select("n", F.explode(cells).alias("r"))
    return out.select(F.lit(name).alias("dataset"), "r.column", F.col("n").alias("n_rows"), "r.n_known", F.round(100 * F.col("r.n_known") / F.nullif("n", F.lit(0)), 2).alias("pct_known"))


def score_summary(scored: DataFrame) -> DataFrame:
    """One row over all scored texts: counts and shares of classes, quantiles of confidence, net polarity."""
    at = lambda p: F.round(F.percentile("confidence", F.lit(p)), 6)
    n = F.count("*")
    classes = [c for x in ("NEG", "NEU", "POS") for c in (F.count(F.when(F.col("predicted") == x, 1)).alias(f"n_{x}"), F.round(100 * F.count(F.when(F.col("predicted") == x, 1)) / n, 2).alias(f"pct_{x}"))]
    signed = F.count(F.when(F.col("predicted") == "POS", 1)) - F.count(F.when(F.col("predicted") == "NEG", 1))
    return scored.agg(
        n.alias("n"), *classes, at(0.05).alias("p05"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.95).alias("p95"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.round(F.avg("margin"), 4).alias("mean_margin"), F.round(F.avg("entropy"), 4).alias("mean_entropy"), F.count(F.when(F.col("low_confidence"), 1)).alias("n_low_confidence"), F.round(100 * signed / n, 2).alias("net_polarity"),
    )


def one_to_one_checks(pairs: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``check, violations, ok`` of functional dependencies both ways."""
    parts = (quality.one_to_one(df, a, b).select("check", (F.col("violations_a") + F.col("violations_b")).alias("violations"), "ok") for df, a, b in pairs)
    return reduce(DataFrame.unionByName, parts)


def community_order(partition: DataFrame) -> DataFrame:
    """Communities numbered by size, ties by their smallest node: ``community, size, number``."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("size"), F.min("node_id").alias("first"))
    order = Window.orderBy(F.desc("size"), "first")  # one row a community
    return sizes.select("community", "size", (F.row_number().over(order) - 1).alias("number"))


def _leaders(df: DataFrame, network: str, column: str, k: int) -> DataFrame:
    """The first ``k`` nodes by a column, ties by node, with their places."""
    best = df.where(F.col(column).isNotNull()).orderBy(F.desc(column), "node_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc(column), "node_id"))  # k rows
    return best.select(F.lit(f"top_{column}").alias("measure"), F.lit(network).alias("network"), place.alias("place"), "node_id", F.col(column).cast("double").alias("value"))


def centrality_summary(networks: dict[str, DataFrame], removal: DataFrame, bridges: DataFrame, k: int = 10) -> DataFrame:
    """``measure, network, place, node_id, value``: who matters, as counts and lists.

    ``networks`` holds each network's ``node_id, degree, strength, weighted_betweenness``; of each come
    how many nodes there are, how many and what share lie on shortest paths, and the first ``k`` by two
    measures. ``removal`` (articulation points, with their network) and ``bridges`` (bridge authors)
    give counts and whole lists: every verified point with the parts that removing it adds, every
    bridge with the components it holds together, every author of several items with how many. Counts
    have no place and no node; without any node the share is null.
    """
    one = lambda df, network, **values: unpivoted(df.agg(*(v.alias(m) for m, v in values.items()))).select(
        F.col("metric").alias("measure"), F.lit(network).alias("network"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("node_id"), "value"
    )
    count = lambda c: F.count(F.when(c, 1))
    parts = []
    for name, df in networks.items():
        between = F.col("weighted_betweenness") > 0
        parts.append(one(df, name, n_nodes=F.count("*"), n_between=count(between), pct_between=F.round(100 * F.avg(F.coalesce(between, F.lit(False)).cast("double")), 2)))
        parts += [_leaders(df, name, c, k) for c in ("weighted_betweenness", "strength")]
    points = removal.where("verified")
    parts.append(points.groupBy("network").agg(F.count("*").cast("double").alias("value")).select(F.lit("n_cut_points").alias("measure"), "network", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("node_id"), "value"))
    listed = lambda df, measure, network, node, value: df.select(F.lit(measure).alias("measure"), network.alias("network"), F.lit(None).cast("int").alias("place"), F.col(node).alias("node_id"), F.col(value).cast("double").alias("value"))
    parts.append(listed(points, "cut_point", F.col("network"), "node_id", "delta_components"))
    several = F.col("n_items") > 1
    authors = F.lit("authors")
    parts.append(one(bridges, "authors", n_bridges=count(F.col("is_bridge")), n_several_items=count(several), n_several_channels=count(F.col("is_multichannel")), n_several_communities=count(F.col("n_communities") > 1), n_recurrent=count(F.col("is_recurrent"))))
    parts += [listed(bridges.where("is_bridge"), "bridge", authors, "author", "delta_components"), listed(bridges.where(several), "several_items", authors, "author", "n_items")]
    return reduce(DataFrame.unionByName, parts)
