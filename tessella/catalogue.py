"""All registered queries by name, with their DuckDB equivalents from :mod:`tessella.oracles`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import emoji, ids, reltime
from tessella.functions import text as T
from tessella.operators import blocks, centrality, cohesion as connectivity, community, concentration, distances, graph, quality, relational, scoring, stats, text_model, text_stats, walks
from tessella.oracles import ORACLE
from tessella.plans import communities, relations
from tessella.plans.questions import QUESTIONS, questions_answers
from tessella.scratch import written
from tessella.sources import tables

__all__ = ["ORACLE", "QUERIES"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _fc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.participation(spark, d), tables.catalog(spark, d)


def _ge(spark: SparkSession, d: str) -> DataFrame:
    return graph.bipartite_edges(tables.participation(spark, d))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Item projection of the graph: nodes and edges."""
    e = _ge(spark, d)
    return e.select(F.col("dst").alias("node_id")).distinct(), graph.projection(e, "dst", "src")


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The bipartite graph as one graph."""
    e = _ge(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes, e.select("src", "dst", "weight")


# Relational summaries, joins, coverage.


@query
def participation_by_item(spark: SparkSession, d: str) -> DataFrame:
    return relational.by_item(*_fc(spark, d))


@query
def participation_by_channel(spark: SparkSession, d: str) -> DataFrame:
    return relational.by_channel(*_fc(spark, d))


@query
def author_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.by_author(*_fc(spark, d))


@query
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.catalog_summary(*_fc(spark, d))


@query
def integrated_rows(spark: SparkSession, d: str) -> DataFrame:
    out = relational.integrate(*_fc(spark, d))
    return out.select("fact_id", "item_id", "author_id", "likes", "title", "channel_id", "matched")


@query
def join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return relational.join_coverage(*_fc(spark, d))


@query
def observed_items(spark: SparkSession, d: str) -> DataFrame:
    f, c = _fc(spark, d)
    return c.join(f.select("item_id").where("item_id is not null"), "item_id", "left_semi").select("item_id", "title")


@query
def unobserved_items(spark: SparkSession, d: str) -> DataFrame:
    f, c = _fc(spark, d)
    return c.join(f.select("item_id"), "item_id", "left_anti").select("item_id", "title")


@query
def counts_of_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts_of_counts(_fc(spark, d)[0], "author_id")


@query
def top_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(participation_by_item(spark, d).select("item_id", "n_rows", "n_authors"), 10, F.desc("n_rows"), F.col("item_id"))


@query
def top_items_per_channel(spark: SparkSession, d: str) -> DataFrame:
    items = participation_by_item(spark, d).select("channel_id", "item_id", "n_rows")
    return relational.top_k_per_group(items, "channel_id", 3, F.desc("n_rows"), F.col("item_id"))


@query
def source_by_channel(spark: SparkSession, d: str) -> DataFrame:
    f, c = _fc(spark, d)
    joined = f.join(c.select("item_id", "channel_id"), "item_id")
    return relational.crosstab(joined, "channel_id", "source", ["click", "error", "purchase", "signup", "view"])


@query
def id_set_difference(spark: SparkSession, d: str) -> DataFrame:
    f, c = _fc(spark, d)
    a, b = f.select("item_id").where("item_id is not null").distinct(), c.select("item_id").distinct()
    name = lambda df, x: df.agg(F.count("*").alias("n")).select(F.lit(x).alias("part"), "n")
    return name(a.intersect(b), "both").unionByName(name(a.subtract(b), "facts_only")).unionByName(name(b.subtract(a), "catalog_only"))


@query
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    one = join_coverage(spark, d)
    return one.select(*(F.col(c).cast("double").alias(c) for c in one.columns)).unpivot([], one.columns, "metric", "value")


# Concentration and distributions.


def _units(spark: SparkSession, d: str, key: str) -> DataFrame:
    f, c = _fc(spark, d)
    if key == "channel_id":
        f = f.join(c.select("item_id", "channel_id"), "item_id")
    return f.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))


@query
def concentration_items(spark: SparkSession, d: str) -> DataFrame:
    return concentration.concentration(_units(spark, d, "item_id"), "n_rows")


@query
def concentration_channels(spark: SparkSession, d: str) -> DataFrame:
    return concentration.concentration(_units(spark, d, "channel_id"), "n_rows")


@query
def concentration_authors(spark: SparkSession, d: str) -> DataFrame:
    return concentration.concentration(_units(spark, d, "author_id"), "n_rows")


@query
def gini_items(spark: SparkSession, d: str) -> DataFrame:
    return concentration.gini(_units(spark, d, "item_id"), "n_rows")


@query
def lorenz_points(spark: SparkSession, d: str) -> DataFrame:
    return concentration.lorenz(_units(spark, d, "item_id"), "n_rows")


@query
def degree_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return concentration.ecdf(graph.degrees(*_whole(spark, d)), "degree")


@query
def value_log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return concentration.log_histogram(_fc(spark, d)[0], "value")


@query
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(_fc(spark, d)[0], "value", "source")


@query
def eda_descriptives(spark: SparkSession, d: str) -> DataFrame:
    return relations.eda_descriptives(*_fc(spark, d), tables.documents(spark, d))


@query
def coverage_bias(spark: SparkSession, d: str) -> DataFrame:
    return relations.coverage_bias(catalog_summary(spark, d))


@query
def boxplot_groups(spark: SparkSession, d: str) -> DataFrame:
    return relations.boxplot_groups(_fc(spark, d)[0], "value", "source")


@query
def concentration_series(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of rows, likes and authors over items, channels and authors: seven series."""
    f, c = _fc(spark, d)
    g = f.join(c.select("item_id", "channel_id"), "item_id")
    rows, likes, people = F.count("*"), F.sum("likes"), F.count_distinct("author_id")
    series = {
        "rows of items": (f, "item_id", rows), "rows of channels": (g, "channel_id", rows), "rows of authors": (f, "author_id", rows), "likes of items": (f, "item_id", likes),
        "likes of channels": (g, "channel_id", likes), "likes of authors": (f, "author_id", likes), "authors of items": (f, "item_id", people),
    }
    parts = (concentration.concentration(df.where(F.col(k).isNotNull()).groupBy(k).agg(x.alias("v")), "v").withColumn("series", F.lit(name)) for name, (df, k, x) in series.items())
    return reduce(DataFrame.unionByName, parts)


@query
def outlier_report_items(spark: SparkSession, d: str) -> DataFrame:
    """Outliers of eight variables of items and authors, beside the two of facts."""
    items = participation_by_item(spark, d).select("n_rows", "n_authors", "likes", "views", "authors_per_row")
    people = author_summary(spark, d).select(F.col("n_rows").alias("author_rows"), F.col("n_items").alias("author_items"), F.col("likes").alias("author_likes"))
    return stats.outliers(items, items.columns).unionByName(stats.outliers(people, people.columns))


@query
def outlier_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.outliers(_fc(spark, d)[0], ["value", "likes"])


# Data quality.


@query
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return quality.profile(part, "part", ("p_partkey",))


@query
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.documents(spark, d)
    return quality.duplicates(docs, "documents", ["doc_id", "text"])


@query
def functional_dependencies(spark: SparkSession, d: str) -> DataFrame:
    n = tables.table(spark, d, "nation")
    c = tables.table(spark, d, "customer")
    return quality.one_to_one(n, "n_nationkey", "n_name").unionByName(quality.one_to_one(c, "c_nationkey", "c_mktsegment"))


@query
def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    """Seventeen checks of ids, labels and repeated columns; some fail by nature of the tables."""
    f, c = _fc(spark, d)
    x = f.join(c.select("item_id", "title", "channel_id"), "item_id", "left").withColumn("loud", F.upper("title"))
    checks = {
        "item known": F.col("title").isNull(), "likes agree with value": F.col("likes") != F.floor("value"), "author is not item": F.col("author_id") == F.col("item_id"),
        "source known": ~F.col("source").isin("click", "error", "purchase", "signup", "view"), "source equals channel": quality.differs("source", "channel_id"),
        "title encoded": quality.encoded("title"), "title agrees by key": quality.differs_by_key("title", "loud"),
    }
    table = lambda name: tables.table(spark, d, name)
    pages = {"url holds page id": quality.lacks("url", "page_id"), "url encoded": quality.encoded("url")}
    # Every third handle is that of the next customer, in another spelling.
    k = F.col("c_custkey") + (F.col("c_custkey") % 3 == 0).cast("int")
    named = table("customer").withColumn("handle", F.concat(F.lit("/@Customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit("/about")))
    texts = table("documents").withColumn("length", F.length("text"))
    orders = table("orders").join(table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    parts = [
        quality.violations(x, checks), quality.violations(table("pages"), pages), quality.violations(named, {"handle equals name": quality.handles_differ("c_name", "handle")}),
        quality.violations(texts, {"n_chars equals length": quality.differs("n_chars", "length"), "text known": F.col("text").isNull()}), quality.violations(orders, {"customer known": F.col("c_name").isNull()}),
        relations.one_to_one_checks([(table("nation"), "n_nationkey", "n_name"), (table("customer"), "c_custkey", "c_name"), (table("part"), "p_partkey", "p_name"), (table("customer"), "c_nationkey", "c_mktsegment")]),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def problematic_variables(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    odd = part.select(
        "p_partkey", "p_name", F.lit("x").alias("constant"), F.lit(None).cast("string").alias("empty"), F.when(F.col("p_size") > 30, F.col("p_brand")).alias("partly"),
        F.concat(F.lit("["), "p_type", F.lit("]")).alias("listed"), F.concat("p_size", F.lit(" vistas")).alias("counted"), F.concat(F.lit("hace "), "p_size", F.lit(" dias")).alias("ago"),
        F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("blanked"), F.concat("p_name", F.lit(" #"), "p_partkey").alias("label"),
    )
    return relations.problematic_variables(quality.profile(odd, "part", ("p_partkey",)))


@query
def completeness(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents")
    return relations.completeness(docs, "documents").unionByName(relations.completeness(tables.table(spark, d, "events"), "events"))


@query
def imputed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Blank counts as zero with a flag; sizes with every fifth blank."""
    text = F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.col("p_size").cast("string"))
    return tables.table(spark, d, "part").select("p_partkey", ids.imputed_count(text).alias("n"), ids.is_blank(text).alias("blank"))


@query
def edited_times(spark: SparkSession, d: str) -> DataFrame:
    """The mark of an edited text told from its relative time."""
    e = tables.table(spark, d, "events")
    text = F.concat(F.lit("hace "), F.col("event_id") % 40, F.when(F.col("event_id") % 3 == 0, F.lit(" dias (editado)")).otherwise(F.lit(" dias")))
    return e.select("event_id", reltime.is_edited(text).alias("edited"), reltime.without_edited(text).alias("text"))


@query
def coerced_times(spark: SparkSession, d: str) -> DataFrame:
    """Dates as text, of which some can't be read: those are null."""
    o = tables.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("soon")).when(F.col("o_orderkey") % 4 == 1, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", F.date_format(reltime.coerced_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


# Scalar functions, on texts made of table columns.


@query
def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Prices and sizes written as counts, read back; names are no counts."""
    part = tables.table(spark, d, "part")
    grouped = F.format_number(F.floor(F.col("p_retailprice") * 1000), 0)
    dotted = F.replace(grouped, F.lit(","), F.lit("."))
    texts = {"grouped": F.concat(grouped, F.lit(" views")), "dotted": dotted, "thousands": F.concat("p_size", F.lit("K")), "halves": F.concat("p_size", F.lit(",5 mil")), "millions": F.concat(F.lit("  "), "p_size", F.lit(".25M vistas")), "name": F.col("p_name")}
    return part.select("p_partkey", *(ids.parse_count(t.cast("string")).alias(k) for k, t in texts.items()))


@query
def normalized_keys(spark: SparkSession, d: str) -> DataFrame:
    """Comparison keys of names with accents, sharp s, tabs and capitals put in."""
    c = tables.table(spark, d, "customer")
    text = F.concat(F.lit("  Ñandú\t"), F.upper("c_name"), F.lit("   straße "), F.initcap("c_mktsegment"), F.lit("\n"))
    return c.select("c_custkey", ids.normalize_key(text).alias("key"), ids.normalize_display(text).alias("display"))


@query
def normalized_handles(spark: SparkSession, d: str) -> DataFrame:
    """Handles of customers in the forms that they are written in."""
    c = tables.table(spark, d, "customer")
    name, k = F.replace("c_name", F.lit("#"), F.lit("-")), F.col("c_custkey") % 5
    escaped = F.replace("c_name", F.lit("#"), F.lit("%C3%B1"))
    text = F.when(k == 0, F.concat(F.lit("/@"), name)).when(k == 1, F.concat(F.lit("@"), name, F.lit("/about"))).when(k == 2, name).when(k == 3, F.concat(F.lit("/"), escaped, F.lit("/x")))
    return c.select("c_custkey", ids.normalize_handle(text).alias("handle"), ids.is_percent_encoded(text).alias("encoded"))


TIME_UNITS = ["segundos", "minuto", "horas", "dias", "semanas", "meses", "años", "lustros"]


@query
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    """Relative times of all events as days and age classes; the last unit is none."""
    e = tables.table(spark, d, "events")
    unit = F.element_at(F.array(*(F.lit(u) for u in TIME_UNITS)), (F.col("event_id") % len(TIME_UNITS) + 1).cast("int"))
    text = F.concat(F.lit("Hace "), F.col("event_id") % 40, F.lit(" "), unit, F.lit(" (editado)"))
    return e.select("event_id", reltime.relative_days(text).alias("days"), reltime.relative_bucket(text).alias("bucket"))


# Text.


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """Content words of all documents, cleaned once and written: every query reads them more than once."""
    words = T.content_tokens(F.col("text"), list(T.DOMAIN_STOPWORDS)).alias("w")
    return written(tables.documents(spark, d).select("doc_id", "lang", words), "words")


@query
def hashtag_counts(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.term_counts(tables.documents(spark, d), T.extract_hashtags(F.col("text")))


@query
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.term_counts(tables.documents(spark, d), T.extract_mentions(F.col("text")))


@query
def url_counts(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.term_counts(tables.table(spark, d, "pages"), T.extract_urls(F.col("url")))


@query
def emoji_counts(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.term_counts(tables.documents(spark, d), T.extract_emojis(F.col("text")))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tags and pictures put after their text, as the tables' own texts hold none."""
    docs = tables.documents(spark, d)
    tags = F.concat_ws(" ", *(F.concat(F.lit("#"), F.col(c)) for c in ("source", "lang")), F.lit("#Tessella"))
    picture = F.when(F.col("lang") == "en", "👍🏽").when(F.col("lang") == "de", "👩‍👧").otherwise("🇫🇷")
    cup = F.when(F.col("doc_id") % 3 == 0, F.lit(" x☕")).otherwise(F.lit(""))
    return docs.withColumn("text", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "#", " "), F.lit(" "), tags, F.lit(" "), picture, cup))


@query
def tagged_hashtags(spark: SparkSession, d: str) -> DataFrame:
    """Hashtags with the source of their document."""
    each = _tagged(spark, d).select("source", F.explode(T.extract_hashtags(F.col("text"))).alias("term"))
    return each.groupBy("term", "source").agg(F.count("*").alias("frequency"))


@query
def tagged_emojis(spark: SparkSession, d: str) -> DataFrame:
    """Pictures, of which some are sequences: a skin tone, a joined pair, a flag."""
    return text_stats.term_counts(_tagged(spark, d), T.extract_emojis(F.col("text")))


#: Pictures put after texts by turns: a tone, a joined pair, a region's tags, a keycap, neighbours without a space, a selector.
_PICTURES = ("👍🏽", emoji.joined("👩", "👧"), emoji.region_flag("gbsct"), "3\ufe0f\u20e3", "🇫🇷🇩🇪", "❤\ufe0f☕", "no 3 picture")


def _pictures() -> emoji.Table:
    return emoji.table(emoji.characters() | {_PICTURES[1]: "mother and daughter", _PICTURES[2]: "flag of scotland"})


def _pictured(spark: SparkSession, d: str) -> DataFrame:
    """Documents with pictures put after their text, as the tables' own texts hold none."""
    which = F.element_at(F.array(*map(F.lit, _PICTURES)), (F.pmod("doc_id", F.lit(len(_PICTURES))) + 1).cast("int"))
    return tables.documents(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), which))


@query
def picture_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by longest match over a table, with their names and code points."""
    t = _pictures()
    counts = text_stats.term_counts(_pictured(spark, d), emoji.found(F.col("text"), t))
    return counts.select("term", F.element_at(emoji.names_of(F.array("term"), t), 1).alias("name"), T.code_points(F.col("term")).alias("points"), "frequency")


@query
def pictured_model_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the classifier expects them, with the names of pictures."""
    return _pictured(spark, d).select("doc_id", F.md5(T.model_text(F.col("text"), _pictures())).alias("md5"))


@query
def page_link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links in the text of pages and documents."""
    pages = tables.table(spark, d, "pages").select(F.col("html").alias("text"))
    return text_stats.term_counts(pages.unionByName(tables.documents(spark, d).select("text")), T.extract_urls(F.col("text")))


@query
def mention_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the source of their document."""
    docs = tables.documents(spark, d).select("source", F.explode(T.extract_mentions(F.col("text"))).alias("term")).where("term <> ''")
    return docs.groupBy("source", "term").agg(F.count("*").alias("frequency"))


@query
def title_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of catalogue titles."""
    return text_stats.top_terms(tables.catalog(spark, d), F.split(F.lower("title"), " "), 120)


@query
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.top_ngrams(_clean(spark, d), "doc_id", F.col("w"), 1, 60)


#: Languages of the documents, as Spark names its stop-word lists.
LANGUAGES = {"en": "english", "es": "spanish", "fr": "french", "de": "german"}


@query
def top_words_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of each language, without its own stop words."""
    lists = {k: T.stopwords(spark, v) for k, v in LANGUAGES.items()}
    words = _clean(spark, d).select("lang", F.explode(T.without_stopwords(F.col("w"), F.col("lang"), lists)).alias("term"))
    counts = words.groupBy("lang", "term").agg(F.count("*").alias("frequency"))
    return relational.top_k_per_group(counts, "lang", 20, F.desc("frequency"), F.col("term"))


@query
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.top_ngrams(_clean(spark, d), "doc_id", F.col("w"), 2, 60)


@query
def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.top_ngrams(_clean(spark, d), "doc_id", F.col("w"), 3, 30)


@query
def tfidf_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.tfidf_by_group(_clean(spark, d), "lang", "doc_id", F.col("w"), 12)


@query
def cleaning_effect(spark: SparkSession, d: str) -> DataFrame:
    return text_stats.cleaning_effect(tables.documents(spark, d), "doc_id", "text", list(T.DOMAIN_STOPWORDS))


@query
def model_texts(spark: SparkSession, d: str) -> DataFrame:
    return tables.documents(spark, d).select("doc_id", F.md5(T.model_text(F.col("text"))).alias("md5"))


# Statistics.


@query
def spearman_popularity(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(participation_by_item(spark, d), "views", "n_rows")


@query
def pearson_log1p(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson_log1p(participation_by_item(spark, d), "views", "n_rows")


@query
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return stats.kendall(participation_by_item(spark, d), "views", "n_rows")


@query
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(catalog_summary(spark, d), "views", ~F.col("observed"))


@query
def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal(_fc(spark, d)[0], "value", "source")


@query
def chi2_cramers_v(spark: SparkSession, d: str) -> DataFrame:
    f, c = _fc(spark, d)
    return stats.chi_square(f.join(c.select("item_id", "channel_id"), "item_id"), "channel_id", "source")


@query
def nmi_ari(spark: SparkSession, d: str) -> DataFrame:
    return stats.agreement(tables.documents(spark, d), "lang", "source")


# Graph.


@query
def bipartite_edges(spark: SparkSession, d: str) -> DataFrame:
    return _ge(spark, d)


@query
def bipartite_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.bipartite_nodes(_ge(spark, d), tables.catalog(spark, d)).select("node_id", "node_type", "degree", "strength", "likes", "channel_id", "views")


@query
def bipartite_invariants(spark: SparkSession, d: str) -> DataFrame:
    f, e = tables.participation(spark, d), _ge(spark, d)
    return graph.invariants(f, e, graph.bipartite_nodes(e, tables.catalog(spark, d)))


@query
def author_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection(_ge(spark, d), "src", "dst")


@query
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection(_ge(spark, d), "dst", "src")


@query
def projection_verification(spark: SparkSession, d: str) -> DataFrame:
    e = _ge(spark, d)
    return graph.verify_projection(e, graph.projection(e, "dst", "src"), "dst", "src")


@query
def item_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*_items(spark, d))


@query
def item_topology(spark: SparkSession, d: str) -> DataFrame:
    return graph.topology(*_items(spark, d))


@query
def item_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(*_items(spark, d))


@query
def latapy_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.latapy(_ge(spark, d), "dst", "src")


@query
def bipartite_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.bipartite_density(_ge(spark, d))


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(*_whole(spark, d))


@query
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(*_whole(spark, d))


@query
def peripheral_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.peripheral(*_whole(spark, d))


@query
def core_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.core_subgraph(_ge(spark, d)).select("src", "dst", "weight")


@query
def modularity_of_channels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _items(spark, d)
    c = tables.catalog(spark, d).select(graph.item_node("item_id").alias("node_id"), F.col("channel_id").alias("community"))
    return graph.modularity(edges, nodes.join(c, "node_id"))


@query
def bridge_authors(spark: SparkSession, d: str) -> DataFrame:
    return graph.bridge_authors(_ge(spark, d), tables.catalog(spark, d), _by_category(spark, d))


# The graph of meetings, which falls into parts: the same measures where they are not trivial.


def _me(spark: SparkSession, d: str) -> DataFrame:
    return written(graph.bipartite_edges(tables.meetings(spark, d)), "meetings")


def _customers(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.select(F.col("dst").alias("node_id")).distinct(), written(graph.projection(e, "dst", "src"), "projection")


def _skeletons(e: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The bipartite graph, and of both projections the nodes and a skeleton."""
    whole = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), e.select("src", "dst", "weight")
    side = lambda n, t: (e.select(F.col(n).alias("node_id")).distinct(), written(graph.skeleton(e, n, t), "skeleton"))
    return {"bipartite": whole, "authors": side("src", "dst"), "items": side("dst", "src")}


@query
def meeting_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph.projection(_me(spark, d), "dst", "src")


@query
def meeting_verification(spark: SparkSession, d: str) -> DataFrame:
    return graph.verify_made(_me(spark, d), "dst", "src")


@query
def meeting_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _me(spark, d)
    whole = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), e.select("src", "dst", "weight")
    return relations.network_metrics({"bipartite": whole}, e, {"authors": ("src", "dst"), "items": ("dst", "src")})


@query
def meeting_clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering_projected(_me(spark, d), "dst", "src")


@query
def meeting_latapy(spark: SparkSession, d: str) -> DataFrame:
    return graph.latapy(_me(spark, d), "dst", "src")


@query
def meeting_components(spark: SparkSession, d: str) -> DataFrame:
    e = _me(spark, d)
    return graph.components(e.select(F.col("dst").alias("node_id")).distinct(), graph.skeleton(e, "dst", "src"))


@query
def meeting_peripheral(spark: SparkSession, d: str) -> DataFrame:
    return graph.peripheral_projected(_me(spark, d), "dst", "src")


@query
def meeting_core_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.core_subgraph(_me(spark, d)).select("src", "dst", "weight")


@query
def meeting_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the partition by nation."""
    e = _me(spark, d)
    c = tables.members(spark, d).select(graph.item_node("item_id").alias("node_id"), F.col("channel_id").alias("community"))
    return graph.modularity_projected(e, "dst", "src", e.select(F.col("dst").alias("node_id")).distinct().join(c, "node_id"))


@query
def meeting_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return centrality.pagerank_projected(_me(spark, d), "dst", "src", tolerance=1e-10)  # to the printed digits


@query
def meeting_k_core(spark: SparkSession, d: str) -> DataFrame:
    return centrality.k_core_peeled(_me(spark, d), "dst", "src")


@query
def meeting_bridge_authors(spark: SparkSession, d: str) -> DataFrame:
    """Days without which customers would be parted."""
    c = tables.members(spark, d)
    e = _me(spark, d)
    segment = c.select(graph.item_node("item_id").alias("node_id"), F.col("category").alias("community"))
    return graph.bridge_authors(e, c, e.select(F.col("dst").alias("node_id")).distinct().join(segment, "node_id"))


@query
def meeting_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Bridges of the three networks; those of the projections are found on their skeletons."""
    parts = (blocks.bridges(*g).withColumn("network", F.lit(name)) for name, g in _skeletons(_me(spark, d)).items())
    return reduce(DataFrame.unionByName, parts)


@query
def meeting_articulation(spark: SparkSession, d: str) -> DataFrame:
    """Articulation points of the three networks, and what removing each does.

    Points and parts are found on the skeletons; of the projections only the edges of points are made.
    """
    e, sides = _me(spark, d), {"authors": ("src", "dst"), "items": ("dst", "src")}
    parts = []
    for name, (nodes, edges) in _skeletons(e).items():
        found = blocks.blocks(nodes, edges)
        if name in sides:
            points = written(blocks.cut_points(nodes, edges, found), "points")
            edges = written(graph.projection_near(e, *sides[name], points), "projection")
        parts.append(blocks.articulation_removal(nodes, edges, found).withColumn("network", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query
def meeting_paths(spark: SparkSession, d: str) -> DataFrame:
    return walks.path_measures_projected(_me(spark, d), "dst", "src")


@query
def meeting_giant_paths(spark: SparkSession, d: str) -> DataFrame:
    return distances.giant_paths_projected(_me(spark, d), "dst", "src")


@query
def meeting_cohesion(spark: SparkSession, d: str) -> DataFrame:
    e = _me(spark, d)
    whole = e.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), e.select("src", "dst", "weight")
    parts = {"bipartite": connectivity.cohesion(*whole), "authors": connectivity.cohesion_projected(e, "src", "dst"), "items": connectivity.cohesion_projected(e, "dst", "src")}
    return reduce(DataFrame.unionByName, (df.withColumn("network", F.lit(name)) for name, df in parts.items()))


@query
def meeting_communities(spark: SparkSession, d: str) -> DataFrame:
    return community.detect(*_customers(_me(spark, d)))


@query
def meeting_centrality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Who matters among customers and days: lies on shortest paths, parts a network, joins customers."""
    e = _me(spark, d)
    between = walks.path_measures_projected(e, "dst", "src").select("node_id", "weighted_betweenness")
    placed = written(graph.degrees_projected(e, "dst", "src").drop("top").join(between, "node_id"), "places")
    return relations.centrality_summary({"items": placed}, written(meeting_articulation(spark, d), "removal"), written(meeting_bridge_authors(spark, d), "bridges"))


@query
def articulation_removal(spark: SparkSession, d: str) -> DataFrame:
    return blocks.articulation_removal(*_whole(spark, d))


@query
def graph_bridges(spark: SparkSession, d: str) -> DataFrame:
    return blocks.bridges(*_whole(spark, d))


@query
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.cohesion(*_items(spark, d))


@query
def path_centralities(spark: SparkSession, d: str) -> DataFrame:
    out = distances.path_measures(*_items(spark, d))
    return distances.ranked(out, ["betweenness", "closeness"])


@query
def giant_paths(spark: SparkSession, d: str) -> DataFrame:
    return distances.giant_paths(*_items(spark, d))


@query
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return centrality.pagerank(*_items(spark, d), tolerance=1e-10)  # to the printed digits


@query
def k_core(spark: SparkSession, d: str) -> DataFrame:
    return centrality.k_core(*_items(spark, d))


@query
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return centrality.eigenvector(*_items(spark, d), tolerance=1e-9, most=300)  # to the printed digits


@query
def louvain_communities(spark: SparkSession, d: str) -> DataFrame:
    return community.detect(*_items(spark, d))


@query
def community_controls(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _items(spark, d)
    out = None
    for method in ("louvain", "greedy", "propagation"):
        one = graph.modularity(edges, community.detect(nodes, edges, method)).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


@query
def community_profile(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _items(spark, d)
    c = tables.catalog(spark, d)
    by_category = nodes.join(c.select(graph.item_node("item_id").alias("node_id"), F.col("category").alias("community")), "node_id")
    return graph.community_profile(_ge(spark, d), edges, by_category, c)


def _authors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Author projection of the graph: nodes and edges."""
    e = _ge(spark, d)
    return e.select(F.col("src").alias("node_id")).distinct(), graph.projection(e, "src", "dst")


@query
def network_metrics(spark: SparkSession, d: str) -> DataFrame:
    return relations.network_metrics({"bipartite": _whole(spark, d)}, written(_ge(spark, d), "edges"), {"authors": ("src", "dst"), "items": ("dst", "src")})


@query
def item_centrality(spark: SparkSession, d: str) -> DataFrame:
    return relations.node_centrality_projected(written(_ge(spark, d), "edges"), "dst", "src")


@query
def author_centrality(spark: SparkSession, d: str) -> DataFrame:
    return relations.node_centrality_projected(written(_ge(spark, d), "edges"), "src", "dst")


@query
def centrality_correlations(spark: SparkSession, d: str) -> DataFrame:
    e = written(_ge(spark, d), "edges")
    both = ((relations.node_centrality_projected(e, "dst", "src"), "items"), (relations.node_centrality_projected(e, "src", "dst"), "authors"))
    return reduce(DataFrame.unionByName, (relations.centrality_correlations(written(df, "centralities"), name) for df, name in both))


def _by_category(spark: SparkSession, d: str) -> DataFrame:
    """A partition of observed items with a known answer: their categories."""
    c = tables.catalog(spark, d).select(graph.item_node("item_id").alias("node_id"), F.col("category").alias("community"))
    return _items(spark, d)[0].join(c, "node_id")


@query
def item_communities(spark: SparkSession, d: str) -> DataFrame:
    return relations.item_communities(_ge(spark, d), _items(spark, d)[1], _by_category(spark, d), tables.catalog(spark, d))


@query
def community_order(spark: SparkSession, d: str) -> DataFrame:
    """Categories of items numbered by size, as detected communities are."""
    return relations.community_order(_by_category(spark, d))


@query
def community_terms(spark: SparkSession, d: str) -> DataFrame:
    """The weightiest words of the titles of each community, taken as one document."""
    c = tables.catalog(spark, d).select("item_id", "category", F.split(F.lower("title"), " ").alias("w"))
    return text_stats.tfidf_by_group(c, "category", "item_id", F.col("w"), 12)


@query
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Detected communities of items against the partition by category and by channel."""
    nodes, edges = _items(spark, d)
    found = written(community.detect(nodes, edges), "communities")
    c = tables.catalog(spark, d).select(graph.item_node("item_id").alias("node_id"), "category", "channel_id")
    both = found.join(c, "node_id")
    return reduce(DataFrame.unionByName, (stats.agreement(both, "community", k).withColumn("against", F.lit(k)) for k in ("category", "channel_id")))


# Communities and what is said in them.


def _spoken(spark: SparkSession, d: str, partition: DataFrame) -> DataFrame:
    return communities.said(tables.comments(spark, d), partition, list(T.DOMAIN_STOPWORDS))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return written(community.detect(*_items(spark, d)), "communities")


def _portrait(spark: SparkSession, d: str, partition: DataFrame) -> DataFrame:
    f, c = _fc(spark, d)
    return communities.portrait(_ge(spark, d), _items(spark, d)[1], partition, c, f, _spoken(spark, d, partition))


@query
def community_portrait(spark: SparkSession, d: str) -> DataFrame:
    """Size, place, terms, words, tags and tone of each category of items."""
    return _portrait(spark, d, _by_category(spark, d))


@query
def community_portrait_found(spark: SparkSession, d: str) -> DataFrame:
    """The same of detected communities."""
    return _portrait(spark, d, _found(spark, d))


@query
def community_text_terms(spark: SparkSession, d: str) -> DataFrame:
    """The weightiest words and pairs of what is said in each category."""
    return communities.community_terms(_spoken(spark, d, _by_category(spark, d)))


@query
def community_overview(spark: SparkSession, d: str) -> DataFrame:
    """How many categories, their modularity, and whether tone depends on them."""
    p = _by_category(spark, d)
    return communities.overview(_items(spark, d)[1], p, _spoken(spark, d, p))


@query
def community_overview_found(spark: SparkSession, d: str) -> DataFrame:
    """The same of detected communities."""
    p = _found(spark, d)
    return communities.overview(_items(spark, d)[1], p, _spoken(spark, d, p))


@query
def source_and_community(spark: SparkSession, d: str) -> DataFrame:
    """Does the source of a participation go with the category of its item."""
    return communities.source_agreement(_fc(spark, d)[0], _by_category(spark, d))


@query
def source_and_community_found(spark: SparkSession, d: str) -> DataFrame:
    """Does the source of a participation go with the detected community of its item."""
    return communities.source_agreement(_fc(spark, d)[0], _found(spark, d))


@query
def tone_and_likes(spark: SparkSession, d: str) -> DataFrame:
    """Does tone go with likes: Kruskal-Wallis over the classes, likes against confidence, median likes by class."""
    scored = scoring.score_texts(tables.comments(spark, d), "text").select("likes", "predicted", "confidence")
    return communities.tone_and_likes(written(scored, "scored"))


# Scores.


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_texts(tables.documents(spark, d), "text")


@query
def score_texts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "prob_NEG", "prob_NEU", "prob_POS", "predicted", "confidence", "margin", "entropy", "low_confidence")


def _fitted(spark: SparkSession, d: str):
    """The text model, fitted on all labelled documents: toxic ones are NEG, other good ones POS, the rest NEU."""
    label = F.when(F.col("toxic") == 1, "NEG").when(F.col("quality") == 1, "POS").otherwise("NEU")
    known = tables.table(spark, d, "labels").select("doc_id", label.alias("tone"))
    return text_model.fit(tables.documents(spark, d).join(known, "doc_id"), "text", "tone")


@query
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """All documents by the fitted text model, in batches."""
    scored = text_model.predict(tables.documents(spark, d).select("doc_id", "text"), "text", _fitted(spark, d))
    return scored.select("doc_id", "prob_NEG", "prob_NEU", "prob_POS", "predicted", "confidence", "margin", "entropy", "low_confidence")


@query
def model_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The fitted text model and a run of it over all documents."""
    return text_model.metadata(tables.documents(spark, d), "text", _fitted(spark, d))


@query
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return scoring.label_distribution(_scored(spark, d))


@query
def group_comparison_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return relational.group_comparison(_scored(spark, d), {"lang": "lang", "source": "source"}, "predicted", scoring.LABELS, "confidence")


@query
def representative_examples(spark: SparkSession, d: str) -> DataFrame:
    return scoring.representative_examples(_scored(spark, d), "doc_id")


@query
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return relations.score_summary(_scored(spark, d))


@query
def group_comparison_five(spark: SparkSession, d: str) -> DataFrame:
    """Tone by five groupings: language, source, length class, mentions and digits."""
    size = F.when(F.length("text") < 500, "short").when(F.length("text") < 5000, "middle").otherwise("long")
    has = lambda p, yes: F.when(F.coalesce(F.col("text").rlike(p), F.lit(False)), yes).otherwise(f"no {yes}")
    scored = _scored(spark, d).withColumns({"size": size, "mentions": has("@", "mention"), "digits": has("[0-9]", "digit")})
    return relational.group_comparison(scored, {k: k for k in ("lang", "source", "size", "mentions", "digits")}, "predicted", scoring.LABELS, "confidence")


QUERIES |= QUESTIONS | {"questions_answers": questions_answers}
