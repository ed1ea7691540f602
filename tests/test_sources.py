"""Readers, writers, reports and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from tessella import scratch
from tessella.plans import report, runner
from tessella.sources import files
from tessella.streaming import participation


def test_csv_as_strings(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿id,note\n007,\"a \"\"b\"\"\nc\"\nNA,nan\n8,\n".encode())
    df = files.read_csv_strings(spark, str(tmp_path / "x.csv"), ["id", "note"])
    assert [tuple(r) for r in df.collect()] == [("007", 'a "b"\nc'), (None, None), ("8", None)]
    strict = files.read_csv_strings(spark, str(tmp_path / "x.csv"), ["id", "note"], ("",))
    assert [r["id"] for r in strict.collect()] == ["007", "NA", "8"]
    assert files.check_columns(df, ["id", "text"]).count() == 1 and files.check_columns(df, ["id", "note"]).count() == 0


def test_lists_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b|c"]), (2, [])], "i int, l array<string>")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv_strings(spark, str(tmp_path / "out"), ["i", "l"]).select("i", files.list_column(F.col("l")).alias("l"))
    assert {r["i"]: r["l"] for r in back.collect()} == {"1": ["a", "b|c"], "2": []}
    texts = spark.createDataFrame([("['x', 'y']",), ("p | q",), (None,)], "t string")
    assert [r[0] for r in texts.select(files.list_column(F.col("t"))).collect()] == [["x", "y"], ["p", "q"], []]


def test_metrics_checksums_and_outputs(spark, tmp_path):
    path = str(tmp_path / "m")
    files.write_metrics(spark.createDataFrame([(1, 2.5)], "n int, x double"), path)
    assert tuple(files.read_metrics(spark, path).first()) == (1, 2.5)
    files.append_jsonl(spark, [{"a": "ñ"}], str(tmp_path / "j"))
    files.append_jsonl(spark, [{"a": "z"}], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    (tmp_path / "f.txt").write_text("hello")
    assert files.checksums(spark, str(tmp_path / "f.txt")).first()["md5"] == "5d41402abc4b2a76b9719d911017c592"
    assert files.missing_outputs(spark, [path, str(tmp_path / "none")]) == [str(tmp_path / "none")]


def test_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("A:1", 'x "<&', [1]), ("V:2", None, [])], "node_id string, name string, l array<int>")
    edges = spark.createDataFrame([("A:1", "V:2", 3)], "src string, dst string, weight long")
    files.write_graphml(nodes, edges, str(tmp_path / "g"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "g")).collect())
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(root.findall(f"{ns}graph/{ns}node")) == 2 and len(root.findall(f"{ns}graph/{ns}edge")) == 1


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1234)], "name string, n int")
    text = report.render([("h1", "T"), ("p", "x"), ("bullets", ["a"]), report.table_of(df, "Tab"), ("callout", "c"), ("pagebreak",)])
    assert "# T" in text and "a\\|b" in text and "1,234" in text
    assert report.inventory({"t": df}).first()["n_rows"] == 1


def test_streams(spark):
    events = participation.read_events(spark, "/root/testdata/sf0.001", "events.parquet")
    q = participation.tumbling_counts(events).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n_rows) from tumbling").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    q = participation.edge_weights(events).writeStream.outputMode("complete").format("memory").queryName("edge_weights").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(weight) from edge_weights").first()[0] > 0


def test_json_lines_and_partitions(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2}\n')
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "a int, b string").collect()), key=str) == [(1, "x"), (2, None), (None, None)]
    for k, text in enumerate(('{"C0": ["V:1", "V:2"], "C1": ["V:3"]}', '{"V:1": "C0", "V:2": "C0", "V:3": "C1"}')):
        (tmp_path / f"p{k}.json").write_text(text)
        got = sorted(map(tuple, files.read_partition(spark, str(tmp_path / f"p{k}.json")).collect()))
        assert got == [("C0", "V:1"), ("C0", "V:2"), ("C1", "V:3")]


def test_as_list(spark):
    cases = {'["a", "b"]': ["a", "b"], "['a']": ["a"], " plain text ": ["plain text"], "a|b": ["a|b"], "": [], " ": [], None: []}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, s string").select("i", files.as_list(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in sorted(rows)] == list(cases.values())


def test_stages_write_and_stop(spark, tmp_path):
    ok = lambda s, d: s.range(3)

    def bad(s, d):
        raise ValueError("no")

    stages = [runner.Stage("first", {"a": ok, "b": ok}), runner.Stage("second", {"c": ok})]
    took = runner.run(spark, stages, "unused", str(tmp_path))
    assert list(took) == ["first", "second"] and spark.read.parquet(str(tmp_path / "first" / "b")).count() == 3
    text = runner.document(spark, stages, str(tmp_path), "All tables")
    assert text.startswith("# All tables") and "## second" in text and "| first/a | 1 | 3 |" in text
    with pytest.raises(runner.StageError, match="stage broken, table x: no"):
        runner.run(spark, [runner.Stage("broken", {"x": bad, "y": ok})], "unused", str(tmp_path))
    assert not (tmp_path / "broken" / "y").exists()


def test_formats():
    assert (report.percent(12.345), report.percent(None), report.shortened("a  b\nc", 9), report.shortened("abcdef gh", 6)) == ("12.35 %", "-", "a b c", "abcde…")
    assert report.wrapped("aa bb cc", 5) == "aa bb\ncc"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(Cluster())
