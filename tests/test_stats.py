"""Statistics against published formulas and simple counts."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import concentration, quality, relational, scoring, stats, text_stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def gini(x):
    x = sorted(x)
    n, total = len(x), sum(x)
    return None if not total else round(sum((2 * i - n - 1) * v for i, v in enumerate(x, 1)) / (n * total), 4)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12))
def test_concentration_against_loops(spark, x):
    got = concentration.concentration(frame(spark, [(v,) for v in x], "n long"), "n").first()
    down, total = sorted(x, reverse=True), sum(x)
    assert got["gini"] == (None if gini(x) is None else pytest.approx(gini(x), abs=2e-4)) and got["top3_n"] == sum(down[:3])
    if total:
        for s in (0.5, 0.8):
            below = sum(sum(down[: i + 1]) / total < s - 1e-12 for i in range(len(x)))
            assert got[f"units_for_{int(100 * s)}pct"] == min(below + 1, len(x))


def test_gini_bounds(spark):
    assert concentration.gini(frame(spark, [(5,)] * 4, "n long"), "n").first()["gini"] == 0
    assert concentration.gini(frame(spark, [(0,)] * 3, "n long"), "n").first()["gini"] is None
    assert concentration.gini(frame(spark, [], "n long"), "n").first()["n"] == 0


def test_correlations(spark):
    rows = frame(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    s = stats.spearman(rows, "a", "b").first()
    assert (s["n"], s["rho"]) == (5, pytest.approx(0.9)) and s["p"] == pytest.approx(0.03739, abs=1e-4)
    assert stats.kendall(rows, "a", "b").first()["tau"] == pytest.approx(0.8)
    assert stats.pearson_log1p(rows, "a", "b").first()["n"] == 5


def test_rank_tests(spark):
    rows = frame(spark, [(v, True) for v in (1.0, 2.0, 3.0)] + [(v, False) for v in (4.0, 5.0, 6.0)], "x double, g boolean")
    m = stats.mann_whitney(rows, "x", F.col("g")).first()
    assert (m["n1"], m["n2"], m["u"]) == (3, 3, 0) and m["p"] == pytest.approx(math.erfc(4 / math.sqrt(5.25) / math.sqrt(2)), abs=1e-4)
    k = stats.kruskal(rows, "x", "g").first()
    assert k["h"] == pytest.approx(3.8571, abs=1e-4) and k["p"] == pytest.approx(0.04953, abs=1e-4)


def test_chi_square_and_agreement(spark):
    rows = frame(spark, [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10 + [("c", "x")] * 3, "a string, b string")
    got = stats.chi_square(rows, "a", "b").first()
    assert (got["n"], got["dof"]) == (60, 1) and got["chi2"] == pytest.approx(5.4, abs=1e-3) and got["p"] == pytest.approx(0.020137, abs=1e-4)
    same = frame(spark, [(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert tuple(stats.agreement(same, "a", "b").first()) == (30, 1.0, 1.0)


def test_moments_and_outliers(spark):
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(50)] + [40.0]
    got = stats.outliers(frame(spark, [(v, 1.0) for v in x], "v double, c double"), ["v", "c"])
    by = {r["variable"]: r for r in got.collect()}
    assert by["v"]["n_robust"] >= 1 and by["c"]["n_robust"] == 0 and by["c"]["mad"] == 0
    n, m = len(x), sum(x) / len(x)
    m2, m3 = (sum((v - m) ** k for v in x) / n for k in (2, 3))
    assert by["v"]["skew"] == pytest.approx(m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2), abs=1e-3)


def test_quality(spark):
    df = frame(spark, [("1", " ", None), ("2", "x", None), ("2", "x", None)], "a string, b string, c string")
    p = {r["column"]: r for r in quality.profile(df, "t", ("a",)).collect()}
    assert p["a"]["kind"] == "entero" and not p["a"]["primary_key"] and p["b"]["n_blank"] == 1 and p["c"]["empty"] and p["c"]["kind"] == "vacia"
    assert {r["by"]: r["n_duplicates"] for r in quality.duplicates(df, "t", ["a"]).collect()} == {"row": 1, "a": 1}


def test_group_comparison_keeps_null_groups(spark):
    df = frame(spark, [("g", "POS", 0.9), (None, "NEG", 0.8), ("g", "NEU", 0.7)], "g string, predicted string, confidence double")
    got = {r["grp"]: r for r in relational.group_comparison(df, {"G": "g"}, "predicted", scoring.LABELS, "confidence").collect()}
    assert got["g"]["n"] == 2 and got[None]["n_NEG"] == 1 and not got["g"]["comparable"] and got["g"]["net_polarity"] == 50


def test_tfidf_pairs_cross_documents(spark):
    df = frame(spark, [("g", 1, ["a", "b"]), ("g", 2, ["c"]), ("h", 1, ["a"])], "g string, i int, w array<string>")
    got = {(r["grp"], r["term"]): r["weight"] for r in text_stats.tfidf_by_group(df, "g", "i", F.col("w"), 9).collect()}
    assert set(got) == {("g", "a"), ("g", "b"), ("g", "c"), ("g", "a b"), ("g", "b c"), ("h", "a")} and got["h", "a"] == 1
    assert text_stats.tfidf_by_group(df.where("g = 'g'"), "g", "i", F.col("w"), 9).count() == 0


def test_scores(spark):
    df = frame(spark, [(1, "great thanks"), (2, "you idiot"), (3, None)], "i int, t string")
    got = {r["i"]: r for r in scoring.score_texts(df, "t").collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3)] == ["POS", "NEG", "NEU"]
    assert all(abs(r["prob_NEG"] + r["prob_NEU"] + r["prob_POS"] - 1) < 1e-5 and r["confidence"] >= 1 / 3 for r in got.values())

    def load():
        return lambda texts: [(0.2, 0.3, 0.5)] * len(texts)

    assert scoring.score_batches(df, "t", load).where("predicted = 'POS' and not low_confidence").count() == 3


def test_running_sums_by_ranges_equal_one_pass(spark):
    """Cut into ranges or not, and in either order; a value's mass may be large."""
    rows = [(float(v), (v * 37) % 11 + 1) for v in range(-40, 60)]
    df = spark.createDataFrame(rows, "v double, m long").repartition(5)
    for down in (False, True):
        total, want = 0, {}
        for v, m in sorted(rows, reverse=down):
            total += m
            want[v] = total
        for most in (10**6, 0):
            assert {r["v"]: r["up"] for r in stats.cumulated(df, "v", "m", "up", down, most).collect()} == want
    assert stats.cumulated(df.limit(0), "v", "m", "up", most=-1).count() == 0


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert stats.spearman(df, "a", "b").first()["rho"] is None and stats.pearson_log1p(df, "a", "b").first()["p"] is None


def test_tfidf_by_ranges_equals_one_pass(spark):
    """Border pairs of neighbours that stand in different ranges are found too."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), [rng.choice("abcde") for _ in range(rng.randrange(4))]) for i in range(120)]
    df = spark.createDataFrame(rows, "o long, g string, w array<string>").repartition(7)
    one, cut = (sorted(map(tuple, text_stats.tfidf_by_group(df, "g", "o", F.col("w"), 40, most).collect())) for most in (10**6, 0))
    assert one == cut and any(" " in r[2] for r in one)


def test_quantiles_by_ranges_equal_percentiles(spark):
    """Counted and cut into ranges or aggregated at once: the same numbers, with ties, nulls and single rows."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, 1.5, 2.0, 7.0, rng.random()])) for _ in range(300)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = {"q0": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "top": 1.0}
    one, cut = ({r["g"]: r.asDict() for r in stats.quantiles(df, "x", "g", probs, most).collect()} for most in (10**6, -1))
    assert set(one) == set(cut) == {"a", "b", "one"}
    assert all(cut[g][k] == pytest.approx(v) for g in one for k, v in one[g].items() if k != "g")
    both = [sorted(map(tuple, stats.distribution(df, "x", "g", most).collect())) for most in (10**6, -1)]
    assert [r[:2] for r in both[0]] == [r[:2] for r in both[1]] and all(a == pytest.approx(b) for x, y in zip(*both, strict=True) for a, b in zip(x[1:], y[1:], strict=True) if a is not None)
    both = [sorted(map(tuple, stats.outliers(df.where("g = 'a'"), ["x"], most).collect())) for most in (10**6, -1)]
    assert all(a == pytest.approx(b) for a, b in zip(both[0][0][1:], both[1][0][1:], strict=True) if a is not None)


def test_distribution_of_nothing(spark):
    got = stats.distribution(spark.createDataFrame([], "x double"), "x").collect()
    assert len(got) == 1 and got[0]["n"] == 0 and got[0]["median"] is None and got[0]["std"] == 0


def test_examples_of_classes(spark):
    rows = [(1, "NEG", 0.9), (2, "NEG", 0.9), (3, "NEG", 0.4), (4, "NEG", 0.6), (5, "POS", 0.7)]
    df = spark.createDataFrame(rows, "id int, predicted string, confidence double")
    got = sorted(map(tuple, scoring.representative_examples(df, "id").collect()))
    assert got == [(1, "NEG", "highest", 0.9), (3, "NEG", "lowest", 0.4), (4, "NEG", "middle", 0.6), (5, "POS", "highest", 0.7)]


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_kendall_against_all_pairs(spark, most):
    """Ranges of any size, hot values and ties give the sum over all pairs."""
    rng = random.Random(most)
    rows = [(rng.choice([5, 5, rng.randrange(40)]), rng.choice([3, rng.randrange(30), rng.randrange(30)])) for _ in range(260)]
    sign = lambda x: (x > 0) - (x < 0)
    s = sum(sign(a - c) * sign(b - d) for i, (a, b) in enumerate(rows) for c, d in rows[:i])
    pairs = frame(spark, rows, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("m"))
    assert stats.concordance(pairs, most) == s
    assert stats.concordance(pairs.limit(0), most) == 0


def test_running_shares_in_ranges(spark):
    rows = [(i, i % 7) for i in range(50)]
    one, cut = (relational.with_shares(frame(spark, rows, "k long, n long"), "n", "k", most=m).orderBy("k").collect() for m in (100, 5))
    assert [(r["k"], r["pct"]) for r in one] == [(r["k"], r["pct"]) for r in cut]
    assert [r["cum_pct"] for r in cut] == pytest.approx([r["cum_pct"] for r in one], abs=0.011)
    h = [[tuple(r) for r in concentration._histogram(frame(spark, rows, "k long, n long"), "n", most=m).orderBy("v").collect()] for m in (100, 2)]
    assert h[0] == h[1] and h[0][-1][2] == 50
