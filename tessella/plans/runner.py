"""Named stages in order: each writes its tables aside, and publishes them only if its invariants hold."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.plans import report
from tessella.scratch import remove
from tessella.sources.files import missing_outputs

Query = Callable[[SparkSession, str], DataFrame]
#: Observed measures by table and name.
Measures = dict[str, dict[str, float]]


@dataclass(frozen=True)
class Stage:
    """A stage's name, its queries by table name, and the invariants that its tables must keep.

    ``observed`` names aggregates of a table that are measured by the very pass that writes it;
    ``gates`` names conditions on them: a function of all measures, by table and name, that gives the
    number of violations.
    """

    name: str
    tables: dict[str, Query]
    observed: dict[str, dict[str, Column]] = field(default_factory=dict)
    gates: dict[str, Callable[[Measures], float]] = field(default_factory=dict)


class StageError(RuntimeError):
    """A stage failed, left a table out, or broke an invariant."""


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path(target), True)
    store.mkdirs(path(target).getParent())
    if not store.rename(path(source), path(target)):
        raise StageError(f"{target} could not be put in place")


def run(spark: SparkSession, stages: list[Stage], sf_dir: str, out: str) -> dict[str, float]:
    """Run all stages and publish every table as Parquet below ``out``; seconds by stage.

    A stage writes its tables to a folder aside. Only if all are there and all its gates hold are
    they moved in place; the first stage that fails, lacks an output or breaks an invariant ends the
    run with its name and publishes nothing. What earlier stages published stays.
    """
    took = {}
    for stage in stages:
        start = time.perf_counter()
        aside = f"{out}/_staging/{stage.name}"
        measures: Measures = {}
        try:
            for name, query in stage.tables.items():
                try:
                    df, seen = query(spark, sf_dir), None
                    if wanted := stage.observed.get(name):
                        seen = Observation(f"{stage.name}/{name}")
                        df = df.observe(seen, *(c.alias(k) for k, c in wanted.items()))
                    df.write.mode("overwrite").parquet(f"{aside}/{name}")
                    measures[name] = seen.get if seen else {}
                except Exception as error:
                    raise StageError(f"stage {stage.name}, table {name}: {error}") from error
            if lost := missing_outputs(spark, [f"{aside}/{name}" for name in stage.tables]):
                raise StageError(f"stage {stage.name} left out {', '.join(lost)}")
            broken = {k: n for k, gate in stage.gates.items() if (n := gate(measures))}
            if broken:
                raise StageError(f"stage {stage.name} breaks " + ", ".join(f"{k} ({n} violations)" for k, n in broken.items()))
            for name in stage.tables:
                _move(spark, f"{aside}/{name}", f"{out}/{stage.name}/{name}")
        finally:
            remove(spark, aside)
        took[stage.name] = round(time.perf_counter() - start, 3)
    return took


def network_stage(facts: Query, catalog: Query) -> Stage:
    """The bipartite network of facts, with its invariants as gates.

    Participations with both sides known, edges, nodes and the projection of items; weights must sum
    to rows, nodes to both sides' degrees, edges must cross sides and weigh something, no node may be
    alone, and the projection's pairs must be in order.
    """
    known = lambda s, d: facts(s, d).where("author_id is not null and item_id is not null")
    edges = lambda s, d: graph.bipartite_edges(facts(s, d))
    count = lambda c: F.count(F.when(c, 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Stage(
        "network",
        {
            "participations": known,
            "edges": edges,
            "nodes": lambda s, d: graph.bipartite_nodes(edges(s, d), catalog(s, d)),
            "item_projection": lambda s, d: graph.projection(edges(s, d), "dst", "src"),
        },
        {
            "participations": {"rows": F.count("*")},
            "edges": {"edges": F.count("*"), "mass": zero(F.sum("weight")), "light": count(F.col("weight") < 1), "crossed": count(~F.col("src").startswith("A:") | ~F.col("dst").startswith("V:"))},
            "nodes": {"degree": zero(F.sum("degree")), "strength": zero(F.sum("strength")), "alone": count(F.col("degree") < 1)},
            "item_projection": {"disorder": count(F.col("src") >= F.col("dst")), "light": count(F.col("weight") < 1)},
        },
        {
            "weights_sum_to_rows": lambda m: abs(m["edges"]["mass"] - m["participations"]["rows"]),
            "edges_cross_sides": lambda m: m["edges"]["crossed"],
            "weights_positive": lambda m: m["edges"]["light"] + m["item_projection"]["light"],
            "degree_is_twice_edges": lambda m: abs(m["nodes"]["degree"] - 2 * m["edges"]["edges"]),
            "strength_is_twice_weight": lambda m: abs(m["nodes"]["strength"] - 2 * m["edges"]["mass"]),
            "no_isolates": lambda m: m["nodes"]["alone"],
            "canonical_order": lambda m: m["item_projection"]["disorder"],
        },
    )


def document(spark: SparkSession, stages: list[Stage], out: str, title: str, rows: int = 10) -> str:
    """A Markdown report of what :func:`run` wrote: a section a stage, a table a query, and an inventory."""
    elements: list[report.Element] = [("h1", title)]
    frames = {}
    for stage in stages:
        elements.append(("h2", stage.name.replace("_", " ")))
        for name in stage.tables:
            frames[f"{stage.name}/{name}"] = spark.read.parquet(f"{out}/{stage.name}/{name}")
            elements.append(report.table_of(frames[f"{stage.name}/{name}"], name.replace("_", " "), rows))
    listed = report.inventory(frames).orderBy("name")
    return report.render([*elements, ("h2", "inventory"), report.table_of(listed, "tables", len(frames))])
