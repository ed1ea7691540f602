"""The driver's tables in the roles of fact, catalogue and corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table, one row a participation: who took part in which item, when and how."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"),
        F.col("user_id").alias("author_id"),
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        F.floor("value").cast("long").alias("likes"),
        F.col("event_type").alias("source"),
        "value",
        "ts",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue, one row an item; it holds more items than the facts mention."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("channel_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("views"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus of texts; a table in fewer pieces than there are cores is dealt out, a large one stays as it is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participations that left a text: the documents whose id is that of a fact."""
    facts = participation(spark, sf_dir).select(F.col("fact_id").alias("doc_id"), "item_id", "author_id", "likes", "source")
    return documents(spark, sf_dir).drop("source").join(facts, "doc_id")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fact table, of a graph that falls into parts: customers of one nation who order on one day meet.

    One row an order. Customers are items, the days of their nation are authors; parts, leaves,
    bridges and isolates all occur.
    """
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "orders").join(nations, "o_custkey").select(
        F.col("o_orderkey").alias("fact_id"),
        (F.col("c_nationkey").cast("long") * 100_000 + day).alias("author_id"),
        F.col("o_custkey").cast("int").alias("item_id"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("likes"),
        F.col("o_orderpriority").alias("source"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of :func:`meetings`: one row a customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("item_id"),
        F.col("c_name").alias("title"),
        F.col("c_nationkey").cast("string").alias("channel_id"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").alias("views"),
    )
