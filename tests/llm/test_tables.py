"""Operators on vectors, pages and conversations."""

import random

import numpy as np

from tessella.llm import chat, multi_index, url_lists

P = multi_index.IndexParams(per_cell=5, rounds=6, block=16)


def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        base = rng.normal(size=16)
        for _ in range(6):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.3])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(900 + i, rows[0][1], 0) for i in range(40)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, rows[0][1], None), (1004, [float("inf")] + [0.0] * 15, 1), (1005, [1.0, None], 0), (1006, [], 0), (1007, [3.0, 4.0], 0), (1008, [6.0, 8.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in multi_index.link_vectors(df, P).collect()}
    x = np.array([r[1] for r in rows], dtype=np.float64)
    label = np.array([r[2] for r in rows])
    close = (multi_index.cosines(x, x) >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    for i, r in enumerate(rows):
        assert got[r[0]]["n_links"] == close[i].sum()
    reach = close | np.eye(len(rows), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([r[0] for r in rows])
    assert all(got[ids[i]]["component_id"] == ids[reach[i]].min() for i in range(len(rows)))
    assert [got[i]["n_links"] for i, *_ in odd] == [0, 0, 0, 0, 0, 0, 0, 1, 1] and got[1008]["component_id"] == 1007
    assert multi_index.link_vectors(df.limit(0), P).count() == 0


def test_vectors_that_share_an_id(spark):
    """Equal ids do not make different vectors one; columns whose names clash are ignored."""
    rows = [(5, [1.0, 0.0], 0, 9, 9), (5, [0.0, 1.0], 0, 9, 9), (6, [1.0, 0.01], 0, 9, 9), (7, [0.01, 1.0], 0, 9, 9), (7, [0.01, 1.0], 0, 9, 9), (None, [1.0, 0.0], 0, 9, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links long, component_id long")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in multi_index.link_vectors(df, P).collect()))
    assert got == [(0, 0, 0, True), (5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (7, 2, 5, False)]


def test_recall_of_all_embeddings(spark):
    """A whole table with production parameters: links against brute force, none below the threshold."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in multi_index.link_vectors(df).collect()}
    rows = [r for r in df.collect() if r["label"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    x, label = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["label"] for r in rows])
    close = (multi_index.cosines(x, x) >= 0.98) & (label[:, None] == label[None])
    want = {r["vec_id"]: int(n) - 1 for r, n in zip(rows, close.sum(axis=1), strict=True)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.999 * sum(want.values())


def test_blocks_of_rows_change_nothing(monkeypatch):
    """Codebooks and limits by single rows are those of whole arrays."""
    rng = np.random.default_rng(3)
    x = multi_index._unit(rng.normal(size=(300, 8)))
    whole = [multi_index._codebook(x[:, half], 12, 5) for half in (slice(0, 4), slice(4, 8))]
    limit = multi_index._limit(x, tuple(whole), P)
    monkeypatch.setattr(multi_index, "CELLS", 12)
    assert all(np.allclose(a, multi_index._codebook(x[:, half], 12, 5)) for a, half in zip(whole, (slice(0, 4), slice(4, 8)), strict=True))
    assert abs(multi_index._limit(x, tuple(whole), P) - limit) < 1e-12


def test_traversal_visits_in_order_up_to_the_limit():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    got = multi_index.traverse(a, b, 0.8)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8}


def test_url_lists(spark):
    pages = spark.createDataFrame(
        [(1, "https://u:p@Sub.Bad.Example.org:80/fr/x?q#y", "2024-02-01"), (1, "https://u:p@Sub.Bad.Example.org:80/fr/x?q#y", "2024-02-01"), (2, "http://bad.example.org/", "2024-03-01"), (3, None, "2024-02-01"), (4, "not a url", "2024-02-01"), (5, "http://bad.example.org/", None), (6, "http://ok.example.org./de.html", "2024-02-01"), (None, "http://bad.example.org/", "2024-01-09")],
        "page_id long, url string, day string",
    )
    events = spark.createDataFrame(
        [("Bad.example.org", "a", "2024-01-10", "add"), ("bad.example.org", "a", "2024-01-10", "add"), ("bad.example.org", "a", "2024-02-15", "remove"), ("sub.bad.example.org/fr", "b", "2024-01-01", "add"), (None, "a", "2024-01-01", "add"), ("ok.example.org", "a", "2024-01-01", "odd"), ("ok.example.org", "a", "2024-02-01", "add"), ("ok.example.org", "a", "2024-02-01", "remove")],
        "entry string, list string, day string, action string",
    )
    got = sorted(((r["page_id"], r["host"], r["n_active"], r["entry"], r["listed"]) for r in url_lists.filter_urls(pages, events).collect()), key=str)
    assert got == sorted(
        [(1, "sub.bad.example.org", 2, "sub.bad.example.org/fr", True)] * 2 + [(2, "bad.example.org", 0, None, False), (3, "", 0, None, False), (4, "", 0, None, False), (5, "bad.example.org", 0, None, False), (6, "ok.example.org", 0, None, False), (None, "bad.example.org", 0, None, False)],
        key=str,
    )
    assert url_lists.filter_urls(pages.limit(0), events).count() == 0 and url_lists.filter_urls(pages, events.limit(0)).where("listed").count() == 0


def test_url_paths_against_brute_force(spark):
    rng = random.Random(4)
    some = lambda: "/".join(rng.choice(["Ads", "ads", "a", "B", "x.html", "x", ""]) for _ in range(rng.randrange(5)))
    hosts = ["Ex.org", "ex.org", "sub.ex.org"]
    urls = [(i, f"https://{rng.choice(hosts)}/{some()}{rng.choice(['', '?q/z', '#f/z'])}", "2024-02-01") for i in range(150)]
    urls += [(900, "http://ex.org", "2024-02-01"), (901, "  http://Ex.org/Ads/x.html  ", "2024-02-01")]
    entries = sorted({f"{rng.choice(hosts)}/{some()}".rstrip("/") for _ in range(60)} | {"Ex.org/Ads", "ex.org/Ads/x.html"})
    pages = spark.createDataFrame(urls, "page_id long, url string, day string")
    events = spark.createDataFrame([(e, "a", "2024-01-01", "add") for e in entries], "entry string, list string, day string, action string")
    active = {e.split("/", 1)[0].lower() + e[len(e.split("/", 1)[0]) :] for e in entries}
    got = {r["page_id"]: r for r in url_lists.filter_urls(pages, events).collect()}
    for i, url, _ in urls:
        host, _, path = url.strip().split("://")[1].split("?")[0].split("#")[0].partition("/")
        host, parts = host.lower(), path.split("/")
        keys = {host, "ex.org"} | {f"{host}/{'/'.join(parts[:k])}" for k in range(1, len(parts) + 1) if parts[k - 1]}
        keys |= {f"{host}/{parts[0].split('.')[0]}"} if parts[0] else set()
        met = sorted(keys & active, key=lambda e: (-len(e), e))
        assert (got[i]["n_active"], got[i]["entry"]) == (len(met), met[0] if met else None), url
    assert got[901]["entry"] == "ex.org/Ads/x.html"


def test_url_ties_repeats_and_clashes(spark):
    """Equal entries of two lists, repeated captures and events, long paths, columns of results' names."""
    deep = "http://a.org/" + "x/" * 5000 + "y"
    pages = spark.createDataFrame([(1, "http://a.org/x/z", "2024-05-01", "h", True), (1, "http://a.org/x/z", "2024-05-01", "h", True), (2, deep, "2024-05-01", "h", True)], "page_id long, url string, day string, host string, listed boolean")
    events = [("a.org/x", "n", "2024-01-01", "add"), ("a.org/x", "m", "2024-02-01", "add"), ("a.org/x", "m", "2024-02-01", "add"), ("a.org", "k", "2024-01-01", "add"), ("a.org/x", None, "2024-03-01", "add")]
    got = url_lists.filter_urls(pages, spark.createDataFrame(events, "entry string, list string, day string, action string")).collect()
    assert [(r["n_active"], r["entry"], r["list"], str(r["since"]), r["host"]) for r in got] == [(4, "a.org/x", "", "2024-03-01", "a.org")] * 3


def test_preferences_of_repeats(spark):
    """Repeated turns stay and are ordered by role and text; repeated pairs are one; clashing columns are ignored."""
    turns = spark.createDataFrame(
        [(1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (2, 0, "user", "a", 0), (2, 0, "user", "a", 0), (2, 0, "user", "c", 0)],
        "conv_id long, turn long, role string, text string, pair_id int",
    )
    pairs = spark.createDataFrame([(7, 1, 2), (7, 1, 2), (8, 1, 1), (None, 1, 2)], "pair_id long, chosen_id long, rejected_id long")
    got = sorted((r["pair_id"] or 0, r["n_prefix"], r["n_chosen"], r["n_rejected"]) for r in chat.preferences(turns, pairs).collect())
    assert got == [(0, 2, 1, 1), (7, 2, 1, 1), (8, 3, 0, 0)]


def test_preferences(spark):
    rng = random.Random(3)
    turns, convs = [], {}
    for c in range(20):
        n = rng.randrange(0, 5)
        convs[c] = [("user" if k % 2 == 0 else "assistant", rng.choice(["hi", "yo", "", "é🙂"])) for k in range(n)]
        turns += [(c, k, role, text, "x") for k, (role, text) in enumerate(convs[c])]
    turns += [(None, 0, "user", "lost", "x"), (30, 0, None, None, "x"), (30, None, "assistant", "first", "x")]
    convs[30] = [("assistant", "first"), ("unknown", "")]
    pairs = [(i, rng.randrange(20), rng.randrange(20)) for i in range(60)] + [(100, 30, None), (101, 77, 3)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in chat.preferences(df, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()}
    show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
    for i, a, b in pairs:
        c, r = convs.get(a, []), convs.get(b, [])
        k = next((j for j, (x, y) in enumerate(zip(c, r)) if x != y), min(len(c), len(r)))
        g = got[i]
        assert (g["n_prefix"], g["prompt"], g["chosen"], g["rejected"]) == (k, show(c[:k]), show(c[k:]), show(r[k:]))
        spans = [tuple(map(int, s.split("-"))) for s in g["chosen_spans"].split(",") if s]
        assert [g["chosen"][s:e] for s, e in spans] == [f"{t}<|end|>\n" for role, t in c[k:] if role == "assistant"]
    assert chat.preferences(df.limit(0), spark.createDataFrame([], "pair_id long, chosen_id long, rejected_id long")).count() == 0
