"""Report sections as data: texts and tables bound to cells of published tables.

A section holds no number. Each figure names a table, a column and the one row that it comes from; all
figures of a table are looked up in one pass over it, and a figure whose row is lacking, or not the
only one, stops the report.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import report


class FigureError(RuntimeError):
    """A figure has no row, or more than one."""


@dataclass(frozen=True)
class Figure:
    """A cell of a published table: its column in the only row in which ``where`` holds (nulls equal nulls)."""

    table: str
    column: str
    where: dict[str, object] = field(default_factory=dict)
    show: Callable[[object], str] = report.number

    def picks(self) -> Column:
        """Whether a row is the figure's."""
        return reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in self.where.items()), F.lit(True))


@dataclass(frozen=True)
class Paragraph:
    """A text with figures in braces; ``unless`` is said instead where ``holds`` is not true of their values."""

    text: str
    figures: dict[str, Figure] = field(default_factory=dict)
    holds: Callable[[dict[str, object]], bool] | None = None
    unless: str = ""

    def said(self, values: dict[str, object]) -> str:
        """The text with its figures filled in; a figure that is null is shown as a dash, and nothing holds of it."""
        known = all(v is not None for v in values.values())
        text = self.text if self.holds is None or (known and self.holds(values)) else self.unless
        return text.format(**{k: f.show(values[k]) for k, f in self.figures.items()})


@dataclass(frozen=True)
class Excerpt:
    """The first rows of a published table in an order; ``order`` has names of columns, with a minus for descending."""

    title: str
    table: str
    columns: list[str]
    order: list[str]
    rows: int = 10

    def frame(self, df: DataFrame) -> DataFrame:
        """The rows themselves."""
        by = [F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]
        return df.orderBy(*by).limit(self.rows).select(*self.columns)


@dataclass(frozen=True)
class Section:
    """A heading and what stands below it."""

    title: str
    parts: list[Paragraph | Excerpt]


def _tables(sections: list[Section]) -> dict[str, list[Figure]]:
    """The different figures of each table, in order."""
    out: dict[str, list[Figure]] = {}
    for s in sections:
        for p in s.parts:
            for f in p.figures.values() if isinstance(p, Paragraph) else ():
                if f not in out.setdefault(f.table, []):
                    out[f.table].append(f)
    return out


def look_up(spark: SparkSession, sections: list[Section], out: str) -> dict[Figure, object]:
    """The value of every figure, by one aggregation over each table below ``out``."""
    values = []
    for table, wanted in _tables(sections).items():
        cells = [x for i, f in enumerate(wanted) for x in (F.count(F.when(f.picks(), 1)).alias(f"n{i}"), F.max(F.when(f.picks(), F.col(f"`{f.column}`"))).alias(f"v{i}"))]
        row = spark.read.parquet(f"{out}/{table}").agg(*cells).first()  # two cells a figure
        for i, f in enumerate(wanted):
            if row[f"n{i}"] != 1:
                raise FigureError(f"{f.column} of {table} where {f.where}: {row[f'n{i}']} rows")
            values.append((f, row[f"v{i}"]))
    return _Looked(values)


class _Looked(dict):
    """Values by figure; figures hold dictionaries, so they are known by what they say."""

    def __init__(self, pairs):
        super().__init__((self.key(f), v) for f, v in pairs)

    @staticmethod
    def key(f: Figure) -> str:
        return json.dumps([f.table, f.column, f.where], sort_keys=True)

    def __getitem__(self, f: Figure):
        return super().__getitem__(self.key(f))


def figures(spark: SparkSession, sections: list[Section], out: str) -> DataFrame:
    """``section, name, table, column, where, value, shown``: a row for each use of a figure."""
    found, rows = look_up(spark, sections, out), []
    for s in sections:
        for p in s.parts:
            for name, f in p.figures.items() if isinstance(p, Paragraph) else ():
                rows.append((s.title, name, f.table, f.column, json.dumps(f.where, sort_keys=True), None if found[f] is None else str(found[f]), f.show(found[f])))
    return spark.createDataFrame(rows, "section string, name string, table string, column string, where string, value string, shown string")


def document(spark: SparkSession, sections: list[Section], out: str, title: str) -> str:
    """Markdown of all sections over the tables below ``out``."""
    found = look_up(spark, sections, out)
    elements: list[report.Element] = [("h1", title)]
    for s in sections:
        elements.append(("h2", s.title))
        for p in s.parts:
            if isinstance(p, Excerpt):
                elements.append(report.table_of(p.frame(spark.read.parquet(f"{out}/{p.table}")), p.title, p.rows))
            elif said := p.said({k: found[f] for k, f in p.figures.items()}):
                elements.append(("p", said))
    return report.render(elements)
