"""Report sections: every number that is said stands in a published table."""

import json
import re

import duckdb
import pytest

from tessella.plans import report, runner, sections, standard
from tessella.plans.sections import Excerpt, Figure, Paragraph, Section

SF = "/root/testdata/sf0.001"


def test_every_number_is_in_the_tables(spark, tmp_path):
    out, parts = str(tmp_path), standard.sections()
    runner.run(spark, standard.stages(), SF, out)
    text = sections.document(spark, parts, out, "Standing report")
    assert [line[3:] for line in text.splitlines() if line.startswith("## ")] == [s.title for s in parts] and len(parts) == 7
    used = sections.figures(spark, parts, out).collect()
    for r in used:  # read again by another engine
        where = " AND ".join(f"\"{k}\" IS NOT DISTINCT FROM '{v}'" for k, v in json.loads(r["where"]).items()) or "TRUE"
        cells = duckdb.sql(f"SELECT \"{r['column']}\" FROM '{out}/{r['table']}/*.parquet' WHERE {where}").fetchall()
        assert len(cells) == 1 and str(cells[0][0]) == r["value"], r
    number = r"-?\d[\d,]*(?:\.\d+)?"
    shown = {x for r in used for x in re.findall(number, r["shown"])} | {"0.0001"}
    said = [line for line in text.splitlines() if line and line[0] not in "#|*"]
    assert len(said) == sum(isinstance(p, Paragraph) for s in parts for p in s.parts)
    assert all(x in shown for line in said for x in re.findall(number, line))
    written = "".join(p.text + p.unless for s in parts for p in s.parts if isinstance(p, Paragraph))
    assert not re.search(r"\d", re.sub(r"\{\w+\}", "", written)), "a text holds a number of its own"


@pytest.fixture
def small(spark, tmp_path):
    rows = [("a", 1, 0.5, None), ("a", 2, 0.25, True), (None, 3, None, False)]
    spark.createDataFrame(rows, "k string, i int, x double, b boolean").write.parquet(f"{tmp_path}/s/t")
    return str(tmp_path)


def test_figures_need_one_row(spark, small):
    said = lambda f: sections.document(spark, [Section("S", [Paragraph("{f}", {"f": f})])], small, "T").split("\n\n")[-1].strip()
    assert said(Figure("s/t", "i", {"k": None})) == "3"
    assert said(Figure("s/t", "x", {"k": None})) == "-"
    assert said(Figure("s/t", "x", {"k": "a", "i": 2}, report.percent)) == "0.25 %"
    for where, n in (({"k": "a"}, 2), ({"k": "z"}, 0), ({}, 3)):
        with pytest.raises(sections.FigureError, match=f"i of s/t .*: {n} rows"):
            said(Figure("s/t", "i", where))


def test_alternatives_and_excerpts(spark, small):
    f = {"x": Figure("s/t", "x", {"i": 1}), "n": Figure("s/t", "x", {"i": 3})}
    parts = [
        Paragraph("high {x}", {"x": f["x"]}, lambda v: v["x"] > 0.4, "low {x}"), Paragraph("high {x}", {"x": f["x"]}, lambda v: v["x"] > 0.6, "low {x}"),
        Paragraph("known {n}", {"n": f["n"]}, lambda v: v["n"] > 0, "unknown {n}"), Paragraph("never", {"n": f["n"]}, lambda v: v["n"] > 0), Excerpt("E", "s/t", ["i", "k"], ["-i"], 2),
    ]
    text = sections.document(spark, [Section("S", parts)], small, "T")
    assert text == "# T\n\n## S\n\nhigh 0.50\n\nlow 0.50\n\nunknown -\n\n**E**\n\n| i | k |\n| --- | --- |\n| 3 | - |\n| 2 | a |\n"
    assert [r["shown"] for r in sections.figures(spark, [Section("S", parts)], small).collect()] == ["0.50", "0.50", "-", "-"]
