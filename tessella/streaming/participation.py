"""Streams of facts: an extension, as the batch pipeline has none.

Both outputs are the streaming forms of batch tables: tumbling counts and graph edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The Parquet events in a folder as a stream; ``glob`` picks files by name."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Facts, likes and distinct-free author sketches by window and source; late rows within the watermark count."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("source"))
    return counted.agg(F.count("*").alias("n_rows"), F.sum(F.floor("value")).alias("likes"), F.approx_count_distinct("user_id").alias("authors")).select(
        F.col("w.start").alias("since"), F.col("w.end").alias("until"), "source", "n_rows", "likes", "authors"
    )


def edge_weights(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Author-item weights over each fact once, in update mode."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    item = F.get_json_object("props", "$.k").cast("int").alias("item_id")
    return once.groupBy(F.col("user_id").alias("author_id"), item).agg(F.count("*").alias("weight"), F.sum(F.floor("value")).alias("likes"))
