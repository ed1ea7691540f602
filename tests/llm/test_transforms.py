"""Whitening, sharding and fill-in-the-middle against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import fill_middle, sharding, whitening
from tessella.llm.queries import QUERIES
from tessella.llm.shared import new_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, n long, x array<long>, whitened double"


def vectors(spark, rows):
    """Vectors with further columns whose names clash with results."""
    return spark.createDataFrame([(i, v, 7, [1], 0.5) for i, v in rows], VECTORS)


def exact(rows):
    """Fit list, sums and covariance in fractions."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[sum((Fraction(v[a]) - Fraction(sums[a], n)) * (Fraction(v[b]) - Fraction(sums[b], n)) for v in fit) / n for b in range(d)] for a in range(d)]
    return x, fit, sums, np.array([[float(c) for c in r] for r in cov])


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e7])
def test_whitening_against_fractions(spark, scale):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix * scale + 3 * scale).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # one vector many times
    x, fit, sums, cov = exact(rows)
    values = np.linalg.eigvalsh(cov)[::-1]
    got = {r["vec_id"]: r for r in whitening.whiten(vectors(spark, rows), 4).collect()}
    assert len(got) == len(rows)
    z = np.array([got[i]["whitened"] for i, _ in rows])
    n, firsts = len(fit), {v: k for k, v in reversed(list(enumerate(x[i] for i, _ in rows)))}
    for k, (i, _) in enumerate(rows):
        r = got[i]
        assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert r["explained"] == pytest.approx(values[:4] / np.trace(cov), rel=1e-9)
        assert z[k] == pytest.approx(z[firsts[x[i]]], abs=1e-12)
    once = z[sorted(firsts.values())]
    error = np.abs((once - once.mean(0)).T @ (once - once.mean(0)) / n - np.eye(4)).max()
    assert error < 1e-9 and got[0]["identity_error"] < 1e-9
    # Each component is the projection on an axis: whitened times the root of its value, regressed on x, gives a unit vector.
    centre = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x[i], sums, strict=True)] for i, _ in rows])
    axes = np.linalg.lstsq(centre, z * np.sqrt(values[:4]), rcond=None)[0]
    assert np.linalg.norm(axes, axis=0) == pytest.approx(1, abs=1e-8) and np.abs(cov @ axes - axes * values[:4]).max() < 1e-7 * values[0]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1e300, 0.0])]
    rows = [(7, [0.5, 1.0]), (7, [0.5, 1.0]), (None, [0.25, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(vectors(spark, odd + rows), 4).collect()
    assert sorted((r["vec_id"] or 0, r["n"], len(r["whitened"])) for r in got) == [(0, 3, 2), (7, 3, 2), (7, 3, 2), (8, 3, 2), (9, 1, 3)]
    by = {r["vec_id"]: r for r in got}
    assert by[7]["whitened"][1] is None and by[7]["explained"] == pytest.approx([1, 0]) and by[9]["whitened"] == [None] * 3 and by[9]["explained"] == [0, 0, 0]
    assert int(by[8]["deviation"]) == (128 + 64) ** 2 and by[None]["whitened"][0] == pytest.approx(0)
    assert whitening.whiten(vectors(spark, odd), 4).count() == 0 and whitening.whiten(vectors(spark, []), 4).count() == 0


def test_huge_entries_are_exact(spark):
    """Numbers of about 2^50 steps and sums of squares beyond 38 digits or 64 bits."""
    rows = [(i, [(-1) ** i * 2.0**42 + i, float(i * i)]) for i in range(9)]
    x, fit, sums, _ = exact(rows)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, rows), 2).collect()}
    assert all(int(got[i]) == sum((len(fit) * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i, _ in rows)
    far = whitening.whiten(vectors(spark, [(1, [2.0**54]), (2, [-(2.0**54)])]), 1).collect()
    assert [int(r["deviation"]) for r in far] == [2**126] * 2 or [r["deviation"] for r in far] == [None] * 2


def test_remaindering():
    rng = random.Random(1)
    bound = 10**40
    primes = whitening.primes_for(bound)
    values = [rng.randrange(-bound, bound) for _ in range(50)] + [0, bound, -bound]
    residues = [np.array([v % p for v in values], dtype=np.int64) for p in primes]
    assert list(whitening.from_residues(residues, primes)) == values
    assert all(p < 1 << 20 and all(p % k for k in range(2, 1100)) for p in primes)


def test_whitening_query(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([np.floor(256 * np.array(r["embedding"], dtype=np.float64)) for r in rows])
    fit = np.unique(x, axis=0)
    cov = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    want = (x - fit.mean(0)) @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    assert len(got) == 4 * len(rows) and {r["component"] for r in got} == {1, 2, 3, 4}
    sign = {}
    for r in got:
        w = want[at[r["vec_id"]], r["component"] - 1]
        s = sign.setdefault(r["component"], np.sign(w * r["whitened"]))
        assert r["whitened"] == pytest.approx(s * w, abs=1e-9) and r["identity_error"] < 1e-9


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def test_sharding_is_whole_balanced_and_gapless(spark, docs_of):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(200) + "é") for i in range(3000)] + [(5, "same text" * 9)] * 1500 + [(None, "lost")] * 300 + [(9000, None), (9001, "")]
    path = new_path(spark, "test")
    keyed = sharding.keyed(docs_of(rows), 512)
    first = sharding.write_map(keyed, path, 8, 512)
    got = sharding.place(keyed, first).collect()
    sizes = lambda t: len((t or "").encode()) + 1
    have = [(-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got]
    assert sorted(have) == sorted((-1 if i is None else i, sizes(t), zlib.crc32((t or "").encode())) for i, t in rows)
    own = shards_of(got)
    assert set(own) == set(range(8)) and all(sorted(r["slot"] for r in many) == list(range(len(many))) for many in own.values())
    loads = [sum(r["size"] for r in many) for many in own.values()]
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    homes = {}
    for r in got:
        homes.setdefault((r["virtual_slot"], r["piece"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in homes.values()) and max(p for _, p in homes) > 0  # the hot id is in pieces
    # The next version moves rows into the ninth shard alone, and is balanced too.
    second = sharding.place(keyed, sharding.write_map(keyed, path, 9, 512)).collect()
    before = {r["uid"]: r["shard"] for r in got}
    assert all(r["shard"] in (before[r["uid"]], 8) for r in second)
    loads = [sum(r["size"] for r in many) for many in shards_of(second).values()]
    assert len(loads) == 9 and max(loads) - min(loads) <= 0.06 * sum(loads) / 9
    assert sharding.versions(spark, path) == [1, 2] and sharding.read_map(spark, path, 1).agg({"shard": "max"}).first()[0] == 7
    # Fewer shards: what the last one held is dealt out, the rest stays.
    third = {r["uid"]: r["shard"] for r in sharding.place(keyed, sharding.write_map(keyed, path, 8, 512)).collect()}
    assert all(third[r["uid"]] == r["shard"] for r in second if r["shard"] != 8) and set(third.values()) == set(range(8))


def test_maps_are_edited_only_where_needed():
    units = [sharding.Unit(s, 0, 1, 10 + s % 7, 1) for s in range(400)]
    first = sharding.dealt(units, dict.fromkeys(range(4), 0))
    assert sharding.edited(first, units, 4) == first
    grown = [sharding.Unit(u.virtual_slot, 0, 1, u.bytes * (3 if u.virtual_slot < 60 else 1), 1) for u in units] + [sharding.Unit(400, 0, 1, 30, 1)]
    after = sharding.edited(first, grown, 4)
    loads = [sum(u.bytes for u in after if u.shard == s) for s in range(4)]
    assert max(loads) - min(loads) < 60 and len(after) == 401
    assert sum(a.shard != b.shard for a, b in zip(first, after, strict=False)) < 60
    assert sharding.edited([], units, 4) == first and sharding.edited(first, [], 4) == []


def test_sharding_odd(spark, odd, none):
    got = sharding.shard(odd, new_path(spark, "test"), 3).collect()
    assert len(got) == odd.count() and all(sorted(r["slot"] for r in many) == list(range(len(many))) for many in shards_of(got).values())
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode()) + 1 for r in odd.collect())
    path = new_path(spark, "test")
    assert sharding.shard(none, path, 3).count() == 0 and sharding.read_map(spark, path).count() == 0
    with pytest.raises(ValueError, match="no version 4"):
        sharding.read_map(spark, path, 4)


def test_sharding_query(spark):
    got = QUERIES["op12_sharding"](spark, SF).collect()
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in rows.items()}
    assert all(sorted(r["slot"] for r in many) == list(range(len(many))) for many in shards_of(got).values())
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None and r["shard_of_nine"] in (8, r["shard"]) for r in got)


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    """One text at a time: the expected row."""
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    ts = TOKEN.findall(text)
    a, b = sorted((h1 % (len(ts) + 1), h2 % (len(ts) + 1)))
    p, m, s = "".join(ts[:a]), "".join(ts[a:b]), "".join(ts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(ts), "plain", None, None, text
    return (len(ts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(ts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_against_one_text_at_a_time(spark, docs_of, odd, none):
    rng = random.Random(9)
    parts = ["a", "bc", "é", "日本", "🙂", " ", "  ", "\n", "\t", "\x0b\x0c\r", " ", "\x1f", "<P", "<", "P>", "<S>", "M>", "\x00", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(1500)]
    rows += [(-5, "minus id"), (2000, "w " * 300_000), (2001, " " * 5000), (2002, "é" * 9000), (2003, "<M>"), (2004, "<P>" * 1000)]
    for df in (docs_of(rows), odd):
        got = fill_middle.restore(fill_middle.transform(df)).collect()
        have = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=repr)
        assert have == sorted(((r["doc_id"], *middle(r["doc_id"], r["text"]), r["text"] or "") for r in df.collect()), key=repr)
    assert {r["form"] for r in fill_middle.transform(docs_of(rows)).select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(none)).count() == 0


def test_fill_middle_of_slices():
    """Blocks are slices of a batch; a mark that two texts share is none."""
    texts = pa.array(["x", "<", "P> a b", "", "c d\n", "<S", ">"])
    h = [np.array([1] * 5), np.array([2] * 5), np.array([0] * 5), np.array([90] * 5)]
    n, form, before, inside, out = fill_middle.cut(texts.slice(1, 5), h)
    assert n.tolist() == [1, 3, 0, 3, 1] and form.tolist() == [1, 1, 0, 1, 1]
    assert out.to_pylist()[1] == "<P>P><S> b<M> a" and out.to_pylist()[3] == "<P>c<S>\n<M> d" and fill_middle.rebuilt(out, form).to_pylist() == texts.slice(1, 5).to_pylist()


def test_restore_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "plain", "old"), (2, "a b", None, "old"), (3, "<S>c<P>a<M>b", "spm", "old")], "doc_id long, output string, form string, restored string")
    assert [r["restored"] for r in fill_middle.restore(rows).orderBy("doc_id").collect()] == ["", "a b", "abc"]
