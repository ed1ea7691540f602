"""Readers and writers: all-string CSV, metric JSON, JSONL, GraphML, checksums."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.scratch import new_path
from pyspark.sql import types as T

#: Texts that the first load takes as missing (fixed values).
NA_TOKENS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], na_tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """CSV with a header, every column a string: leading zeros and id-like numbers survive.

    Quoted line breaks and doubled quotes are understood, a byte order mark is dropped, and
    ``na_tokens`` become null (pass ``("",)`` for intermediate files).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    missing = lambda c: F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c)
    return raw.select(*map(missing, columns))


def check_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Positions whose name differs from the expected columns; empty if the schema is as it should be."""
    found = df.columns
    rows = [
        (i, expected[i] if i < len(expected) else None, found[i] if i < len(found) else None)
        for i in range(max(len(expected), len(found)))
        if i >= len(expected) or i >= len(found) or expected[i] != found[i]
    ]
    return df.sparkSession.createDataFrame(rows, "position int, expected string, found string")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; list, map and struct columns become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def list_column(text: Column) -> Column:
    """A list from JSON text, from a Python-style literal, or from text split at ``|``."""
    strict = F.from_json(text, "array<string>")
    loose = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    split = F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    bracketed = F.coalesce(text.rlike(r"^\s*\["), F.lit(False))
    found = F.when(bracketed, F.coalesce(strict, loose, split)).otherwise(split)
    return F.coalesce(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric block (a small result) as one JSON document a row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric block written by :func:`write_metrics`, or any JSON lines."""
    return spark.read.json(path)


def append_jsonl(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append records to a JSON-lines folder."""
    spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a line that is no JSON is a row of nulls, never an error."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``community, node_id`` from one JSON map a file, of communities to lists of nodes or of nodes to communities."""
    text = spark.read.text(path, wholetext=True).select("value")
    lists = F.from_json("value", "map<string,array<string>>")
    whole = text.select(F.explode(lists).alias("community", "nodes")).where("nodes is not null").select("community", F.explode("nodes").alias("node_id"))
    single = text.where(~F.col("value").rlike(r":\s*\[")).select(F.explode(F.from_json("value", "map<string,string>")).alias("node_id", "community"))
    return whole.unionByName(single.select("community", "node_id"))


def as_list(text: Column) -> Column:
    """A list from JSON or a Python-style literal; any other text is a list of itself, blank and null are empty."""
    bracketed = F.coalesce(text.rlike(r"^\s*\[.*\]\s*$"), F.lit(False))
    alone = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.when(bracketed, list_column(text)).otherwise(alone)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, md5`` of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def missing_outputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that don't exist or are empty, in any store that Spark reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    bad = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        store = where.getFileSystem(conf)
        if not store.exists(where) or store.getContentSummary(where).getLength() == 0:
            bad.append(p)
    return bad


_GRAPHML_TYPES = {"bigint": "long", "int": "long", "double": "double", "boolean": "boolean"}


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as ordered lines ``(section, id, line)``: nulls as empty text, lists as JSON.

    ``nodes(node_id, ...)`` and ``edges(src, dst, ...)``; columns that start with ``_`` are private
    and left out. Lines are made in Spark, so a graph of any size can be written as text.
    """
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    kinds = {}
    for kind, df, skip in (("node", nodes, {"node_id"}), ("edge", edges, {"src", "dst"})):
        kinds[kind] = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in skip and f.name[0] != "_"]
        head += [f'<key id="{kind}_{n}" for="{kind}" attr.name={quoteattr(n)} attr.type="{_GRAPHML_TYPES.get(t, "string")}"/>' for n, t in kinds[kind]]
    head.append('<graph edgedefault="undirected">')

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def data(kind: str) -> list[Column]:
        text = lambda n, t: F.to_json(n) if t.startswith(("array", "map", "struct")) else F.col(n).cast("string")
        return [F.concat(F.lit(f'<data key="{kind}_{escape(n)}">'), safe(F.coalesce(text(n, t), F.lit(""))), F.lit("</data>")) for n, t in kinds[kind]]

    node = F.concat(F.lit('<node id="'), safe(F.col("node_id").cast("string")), F.lit('">'), *data("node"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), safe(F.col("src").cast("string")), F.lit('" target="'), safe(F.col("dst").cast("string")), F.lit('">'), *data("edge"), F.lit("</edge>"))
    fixed = [(0, f"{i:04d}", x) for i, x in enumerate(head)] + [(3, "", "</graph></graphml>")]
    return (
        spark.createDataFrame(fixed, "section int, id string, line string")
        .unionByName(nodes.select(F.lit(1).alias("section"), F.col("node_id").cast("string").alias("id"), node.alias("line")))
        .unionByName(edges.select(F.lit(2).alias("section"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id"), edge.alias("line")))
    )


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write GraphML as text parts in order: ranges of lines, sorted side by side; no task gets all lines."""
    lines = graphml_lines(nodes, edges).repartitionByRange("section", "id").sortWithinPartitions("section", "id")
    lines.select("line").write.mode("overwrite").text(path)


def write_graphml_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write GraphML as a single document: ordered parts (:func:`write_graphml`), joined by the file system."""
    spark = nodes.sparkSession
    parts = new_path(spark, "graphml")
    write_graphml(nodes, edges, parts)
    join_parts(spark, parts, path)


def join_parts(spark: SparkSession, folder: str, path: str) -> int:
    """Join a folder's part files, in their order, to one file; returns how many there were.

    Bytes go from stream to stream through a small buffer in the JVM, whatever the size. The file
    appears under its name when it is whole.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target, draft = (hadoop.fs.Path(p) for p in (folder, path, f"{path}._joining"))
    store, into = source.getFileSystem(conf), target.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in store.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = into.create(draft, True)
    try:
        for name in names:
            part = store.open(hadoop.fs.Path(name))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    into.delete(target, True)
    if not into.rename(draft, target):
        raise OSError(f"{path} could not be put in place")
    return len(names)
