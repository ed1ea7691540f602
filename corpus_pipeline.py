"""The corpus pipeline: quality, near-duplicates, contamination, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, contamination, minhash, quality
from tessella.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier gives 0.7 or more, with all their columns.

    Null and empty texts are scored as zero bytes, rows that share an id each by itself.
    """
    net, into = quality.fit(docs, _table(spark, sf_dir, "labels")), "own_score"
    while into.lower() in (c.lower() for c in docs.columns):
        into += "_"
    return quality.score(docs, net, into=into).where(F.col(into) >= 0.7).drop(into)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of the smallest id.

    Texts without words have no duplicates and stay, as do rows without an id. Rows that repeat a
    kept id stay with it.
    """
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without any benchmark window; null texts hold none, null ids are no shelter."""
    return contamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left; null and empty texts have no ids."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", clean_of_benchmarks), ("bpe", tokens)]

#: SQL can express neither the network nor the tokenizer; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
