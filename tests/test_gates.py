"""Invariants that stop a stage, and single documents written side by side."""

import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.plans import runner
from tessella.sources import files, tables

SF = "/root/testdata/sf0.001"


def test_network_stage_publishes_whole_tables(spark, tmp_path):
    stage = runner.network_stage(tables.participation, tables.catalog)
    runner.run(spark, [stage], SF, str(tmp_path))
    edges = spark.read.parquet(f"{tmp_path}/network/edges")
    assert edges.count() == graph.bipartite_edges(tables.participation(spark, SF)).count() > 0
    assert set(os.listdir(f"{tmp_path}/network")) == set(stage.tables) and not os.listdir(f"{tmp_path}/_staging")


@pytest.mark.parametrize(
    ("table", "spoil", "name"),
    [
        ("edges", lambda df: df.where("weight < 3"), "weights_sum_to_rows"),
        ("edges", lambda df: df.withColumn("src", F.col("dst")), "edges_cross_sides"),
        ("nodes", lambda df: df.withColumn("degree", F.lit(0)), "no_isolates"),
        ("nodes", lambda df: df.withColumn("strength", F.col("strength") + 1), "strength_is_twice_weight"),
        ("item_projection", lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "canonical_order"),
    ],
)
def test_broken_graph_stops_the_stage(spark, tmp_path, table, spoil, name):
    stage = runner.network_stage(tables.participation, tables.catalog)
    good = stage.tables[table]
    broken = runner.Stage(stage.name, stage.tables | {table: lambda s, d: spoil(good(s, d))}, stage.observed, stage.gates)
    with pytest.raises(runner.StageError, match=f"network breaks .*{name}"):
        runner.run(spark, [broken], SF, str(tmp_path))
    assert not os.path.exists(f"{tmp_path}/network")


def test_graphml_document_of_many_parts(spark, tmp_path):
    """A million edges come back whole and in order from one document that no task has sorted."""
    nodes = spark.range(20_000).select(F.format_string("n%05d", "id").alias("node_id"), (F.col("id") * 2).alias("degree"))
    edges = spark.range(1_000_000).select(F.format_string("n%05d", F.col("id") % 20_000).alias("src"), F.format_string("n%05d", (F.col("id") * 7 + F.floor(F.col("id") / 20_000)) % 20_000).alias("dst"), F.col("id").alias("weight"))
    path = str(tmp_path / "graph.graphml")
    files.write_graphml_file(nodes, edges, path)
    seen = {"node": 0, "edge": 0}
    total, last = 0, ("", "")
    for _, x in ElementTree.iterparse(path):
        tag = x.tag.rpartition("}")[2]
        if tag in seen:
            seen[tag] += 1
            at = (tag, x.get("id") or f"{x.get('source')} {x.get('target')}")
            assert tag != last[0] or at >= last
            last = at
            total += int(x[0].text) if tag == "edge" else 0
            x.clear()
    assert seen == {"node": 20_000, "edge": 1_000_000} and total == 999_999 * 500_000
    files.write_graphml_file(nodes.limit(0), edges.limit(0), path)
    assert len(ElementTree.parse(path).getroot()) == 3
