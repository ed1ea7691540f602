"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import hashlib
import math
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import quality, queries
from tests.llm.test_documents import brute_hits, near_groups

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smoke tables of up to 2,000 characters, so that brute force can take all of them."""
    return spark.read.parquet(f"{SF}/documents.parquet").where("length(text) <= 2000 or text is null").cache()


def test_quality_stage(spark, docs):
    net, p = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")), quality.NetParams()
    want = [(i, t) for i, t in rows(docs) if quality.probability((t or "").encode(), net, p) >= 0.7]
    out = STAGES["quality"](spark, docs, SF)
    assert out.columns == docs.columns and rows(out) == want and 0 < len(want) < docs.count()


def test_near_duplicate_stage(spark, docs):
    component = near_groups(rows(docs))
    out = STAGES["near_duplicates"](spark, docs, SF)
    assert out.columns == docs.columns and rows(out) == [(i, t) for i, t in rows(docs) if component[i][1] == i]


def test_decontamination_stage(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    out = STAGES["decontamination"](spark, docs, SF)
    assert out.columns == docs.columns and rows(out) == [(i, t) for i, t in rows(docs) if not brute_hits(t, items)[1]]


def test_bpe_stage(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in STAGES["bpe"](spark, docs, SF).collect()}
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows(docs)}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest()) for i, x in ids.items()}


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, want.collect()))


def test_stages_take_odd_rows(spark, odd, none):
    """Null ids and texts, repeats, long texts, columns whose names clash; and empty tables."""
    clash = odd.withColumn("own_score", F.lit(9.0)).withColumn("text_id", F.lit("x")).withColumn("kept_id", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and out.count() <= clash.count() and out.where("own_score <> 9 or text_id <> 'x' or kept_id <> 3").count() == 0
        assert stage(spark, none, SF).count() == 0
    assert STAGES["bpe"](spark, clash, SF).count() == clash.count() and STAGES["bpe"](spark, none, SF).count() == 0


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert len(got) > 0
    if name in queries.ORACLE:
        want = con.sql(queries.ORACLE[name])
        order = sorted(want.columns)
        assert sorted(df.columns) == order
        at = [want.columns.index(c) for c in order]
        assert sorted(tuple(plain(r[c]) for c in order) for r in got) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
