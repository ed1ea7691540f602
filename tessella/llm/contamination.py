"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ``window`` words (a shorter item is one window). A
document is hit where all words of a window stand in it in order: containment 1 of an item-sized
window. With that threshold the necessary prefix of a window, its shingles ordered by rarity in
the corpus, is its single rarest shingle; only documents that hold it can hold the window. The
position of that shingle inside the window bounds where the window would start and end, and the
whole window is then compared word by word.

Words are taken from every text once. That pass writes one row a document and one row for each
place of a shingle that the benchmark has; rarity, prefixes and candidates come from these rows,
and only the texts of candidates are read again, one of each group of equal texts. Rows are known
by a digest of their text, as hits depend on nothing else, so neither null nor repeated ids matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written

#: What is no word character, one by one: such a class is a table lookup, ranges are a chain of tests.
_BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Words of lower-cased text; A-Z are word characters too, so words may be taken before lowering.
WORD = f"[^{_BREAKS}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcast the benchmark's side up to so many windows (some 200 bytes each); beyond, shuffle.
BROADCAST_WINDOWS = 200_000
#: Broadcast texts' candidate places and hits up to so many places (some 100 bytes each); beyond, shuffle.
BROADCAST_PLACES = 200_000
#: Rows of documents pass the join with the benchmark's shingles under so many keys of their own.
SALTS = 1024


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """Words in the case they have; never null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``(item_id, offset, win, k)``: each item's windows and the width of their shingles."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(lower_ascii(F.col("text"))).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    out = words.select("item_id", "w", F.explode(starts).alias("s"))
    out = out.select("item_id", F.slice("w", F.col("s") + 1, window).alias("win"))
    return out.withColumn("k", F.least(F.size("win"), F.lit(shingle)))


def _key(words: str, at: Column, k: int) -> Column:
    """Hash of k words from ``at`` (from 0); null where fewer are left."""
    return F.when(at + k <= F.size(words), F.xxhash64(*(F.get(F.col(words), at + i) for i in range(k))))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _spots(rows: DataFrame, keys: DataFrame, widths: list[int], small) -> DataFrame:
    """One pass over the texts: ``doc_id, n_words, text_id, p, key``.

    A row with ``p`` -1 for each document, and one for each place of a shingle that is in ``keys``.
    """
    many = len(widths)
    docs = rows.select("doc_id", _digest(F.col("text")).alias("text_id"), words_of(lower_ascii(F.col("text"))).alias("w"), F.monotonically_increasing_id().alias("salt"))
    spots = docs.select("doc_id", "text_id", "w", "salt", F.explode(F.sequence(F.lit(-1), F.size("w") * many - 1)).alias("q"))
    at = (F.col("q") / many).cast("int") if many > 1 else F.col("q")
    key = F.lit(None).cast("long")
    for i, k in enumerate(widths):
        key = F.when(F.col("q") % many == i, _key("w", at, k)).otherwise(key)
    first = F.col("q") < 0
    spots = spots.select(
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.size("w")).cast("long").alias("n_words"),
        "text_id",
        F.when(first, F.lit(-1)).otherwise(at).alias("p"),
        F.when(first, F.pmod("salt", F.lit(SALTS))).otherwise(key).alias("key"),
    )
    passes = keys.unionByName(keys.sparkSession.range(SALTS).select(F.col("id").alias("key")))
    return spots.join(small(passes), "key", "left_semi").select("doc_id", "n_words", "text_id", "p", "key")


def _hits(docs: DataFrame, items: DataFrame, window: int, shingle: int, broadcast_windows: int, broadcast_places: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_words, text_id)`` of every row, and ``(text_id, n_hit, items)`` of texts with hits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = item_windows(items, window, shingle).groupBy("win", "k").agg(F.collect_set("item_id").alias("items"))
    windows = written(windows.select(F.array_join("win", " ").alias("joined"), "win", "k", "items"), "windows")
    sizes = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most `shingle` rows
    widths = sorted(sizes) or [shingle]
    small = F.broadcast if sum(sizes.values()) <= broadcast_windows else (lambda df: df)
    parts = None
    for k in widths:
        own = windows.where(F.col("k") == k).select("joined", "win", F.explode(F.sequence(F.lit(0), F.size("win") - k)).alias("o"))
        own = own.select("joined", F.size("win").alias("n"), "o", _key("win", F.col("o"), k).alias("key"))
        parts = own if parts is None else parts.unionByName(own)
    found = written(_spots(rows, parts.select("key").distinct(), widths, small), "spots")
    heads = found.where("p < 0").select("doc_id", "n_words", "text_id")
    spots = found.where("p >= 0").select("text_id", "p", "key")
    # How often each of the benchmark's shingles occurs in the corpus; a window's prefix is its rarest.
    rarity = parts.join(spots.groupBy("key").agg(F.count("*").alias("df")), "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = rarity.groupBy("joined", "n").agg(F.min(F.struct("df", "key", "o")).alias("r")).where("r.df > 0")
    prefix = prefix.select("joined", "n", F.col("r.key").alias("key"), F.col("r.o").alias("o"))
    start = F.col("p") - F.col("o")
    tried = spots.join(small(prefix), "key").where(start >= 0).groupBy("text_id").agg(F.collect_set(F.struct(start.alias("s"), "n", "joined")).alias("c"))
    tried = written(tried, "candidates")
    places = tried.agg(F.sum(F.size("c")).alias("n")).first()["n"] or 0
    close = F.broadcast if places <= broadcast_places else (lambda df: df)
    # Of equal texts, that of the smallest id is compared.
    one = heads.join(close(tried), "text_id").groupBy("text_id").agg(F.min("doc_id").alias("one"), F.first("c").alias("c"))
    texts = rows.withColumn("own_id", _digest(F.col("text"))).join(close(one), F.col("own_id").eqNullSafe(F.col("text_id")) & F.col("doc_id").eqNullSafe(F.col("one")))
    # Words first, then candidates: in one select the words would be taken anew for every candidate.
    compared = texts.select("text_id", words_of(lower_ascii(F.col("text"))).alias("w"), "c").select("text_id", "w", F.explode("c").alias("c"))
    end = F.col("c.s") + F.col("c.n")
    same = F.array_join(F.slice("w", F.col("c.s") + 1, F.col("c.n")), " ") == F.col("c.joined")
    hits = compared.where(F.when(end <= F.size("w"), same).otherwise(False)).select("text_id", F.col("c.s").alias("s"), end.alias("e"), F.col("c.joined").alias("joined"))
    hits = hits.join(small(windows.select("joined", "items")), "joined").groupBy("text_id")
    hits = hits.agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = hits.select("text_id", _covered("spans").alias("n_hit"), F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    return heads, close(written(hits, "hits"))


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_places: int = BROADCAST_PLACES
) -> DataFrame:
    """Find benchmark windows inside documents.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored. Returns per row of
    ``docs``: ``doc_id, n_words, n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``items_sha256`` (of the sorted ids, comma-joined; of the empty string without hits) and
    ``contaminated``. Null texts have no words; items without words hit nothing; items without an
    id hit, but are not counted; repeated items count by their id. Every row is judged by its own
    text, whether its ``doc_id`` is null or repeated. Empty tables give no hits.
    """
    heads, hits = _hits(docs, items, window, shingle, broadcast_windows, broadcast_places)
    none = F.array().cast("array<string>")
    return heads.join(hits, "text_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _covered(spans: str) -> Column:
    """Number of places inside any of the sorted half-open spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["e"]).alias("end"),
        (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns; null and repeated ids are kept apart."""
    _, hits = _hits(docs, items, window, 3, BROADCAST_WINDOWS, BROADCAST_PLACES)
    return docs.join(hits.select(F.col("text_id").alias("__hit")), _digest(docs["text"]) == F.col("__hit"), "left_anti")
