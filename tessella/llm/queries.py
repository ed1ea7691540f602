"""Registered queries of the corpus operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, contamination, fill_middle, lattice, licenses, minhash, multi_index, quality, sharding, token_files, url_lists, whitening
from tessella.llm.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five words, similarity 0.75."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and summed up."""
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries, made by rule from the hosts and first segments that occur.

    A third of all hosts, parent domains and host/segment pairs are entries of one of two lists.
    Each is added on a day of 2024; half are removed after 60 days, and of these a fifth return
    another 60 days later.
    """
    host, segment = url_lists.host_of(F.col("url")), url_lists.first_segment(F.col("url"))
    keys = pages.select(F.explode(url_lists.keys_of(host, segment)).alias("entry")).distinct()
    n = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("int")
    keys = keys.select("entry", n.alias("n")).where("n % 3 = 0")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 300).cast("int"))
    event = lambda days, action: F.struct(F.date_add(start, days).alias("day"), F.lit(action).alias("action"))
    events = F.array(
        event(0, "add"), F.when(F.col("n") % 2 == 0, event(60, "remove")), F.when(F.col("n") % 10 == 0, event(120, "add"))
    )
    named = F.when(F.col("n") % 4 < 2, "adult").otherwise("malware").alias("list")
    return keys.select("entry", named, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("entry", "list", "e.day", "e.action")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the dated entries; a page's fetch day follows from its id."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")).alias("day")
    found = url_lists.filter_urls(pages.select("page_id", "url", day), list_events(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("day", "since")})


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by unigram counts and by the subword lattice."""
    return lattice.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings of equal label with a cosine of 0.98 or more."""
    return multi_index.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) as pair i, for all conversations."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.where("conv_id is not null").groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(
        F.max(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("conv_id") % 2 == 1, F.col("conv_id"))).alias("rejected_id"),
    )
    return chat.preferences(turns, pairs)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of all embeddings, a row each."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), 4)
    each = white.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"), "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by the first map, and where the second one, edited for nine, has them."""
    path, rows = new_path(spark, "slot_map"), sharding.keyed(table(spark, sf_dir, "documents"))
    eight, nine = sharding.write_map(rows, path, 8), sharding.write_map(rows, path, 9)
    after = nine.select("virtual_slot", "piece", F.col("shard").alias("shard_of_nine"))
    placed = sharding.place(rows, eight).join(F.broadcast(after), ["virtual_slot", "piece"])  # as many rows as units
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "shard_of_nine")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all documents, and their texts rebuilt."""
    both = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_token_output,
        op3_url_filters,
        op4_bpe,
        op5_lm_scoring,
        op6_embedding_near_dedup,
        op7_decontamination,
        op8_license_scan,
        op9_quality_classifier,
        op10_preference_format,
        op11_embedding_whitening,
        op12_sharding,
        op13_fill_middle,
    )
}

#: A-Z to a-z alone, as the contracts ask; DuckDB's lower() would change other letters too.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT a AS doc_id, a AS to_ FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(to_) AS c FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op3_url_filters": r"""
WITH p AS (
  SELECT page_id, (DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INT))::DATE AS day,
    lower(regexp_replace(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#\\\s]+)', 1), '\.$', '')) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#.]+)', 1) AS seg FROM pages),
q AS (SELECT *, string_split(host, '.') AS parts FROM p),
k AS (
  SELECT DISTINCT page_id, day, host, unnest(CASE WHEN host = '' THEN [NULL] ELSE list_concat(
    CASE WHEN seg = '' THEN []::VARCHAR[] ELSE [host || '/' || seg] END,
    list_transform(range(1, greatest(len(parts) - 1, 1) + 1), lambda i: array_to_string(parts[i:], '.'))) END) AS entry FROM q),
n AS (SELECT entry, CAST('0x' || substr(md5(entry), 1, 6) AS INT) AS n FROM (SELECT DISTINCT entry FROM k WHERE entry IS NOT NULL)),
e AS (
  SELECT entry, CASE WHEN n % 4 < 2 THEN 'adult' ELSE 'malware' END AS list, (DATE '2024-01-01' + n % 300)::DATE AS d, n FROM n WHERE n % 3 = 0),
v AS (
  SELECT lower(entry) AS entry, list, d AS since, CASE WHEN n % 2 = 0 THEN d + 60 END AS until FROM e
  UNION ALL SELECT lower(entry), list, d + 120, NULL FROM e WHERE n % 10 = 0),
m AS (
  SELECT k.page_id, k.day, k.host, v.entry, v.list, v.since, row_number() OVER (PARTITION BY page_id ORDER BY length(v.entry) DESC NULLS LAST, v.entry, v.list, v.since) AS r
  FROM k LEFT JOIN v ON k.entry = v.entry AND k.day >= v.since AND (v.until IS NULL OR k.day < v.until))
SELECT a.page_id, a.day::DATE::VARCHAR AS day, a.host, c.n AS n_active, a.entry, a.list, a.since::DATE::VARCHAR AS since, c.n > 0 AS listed
FROM m a JOIN (SELECT page_id, count(entry) AS n FROM m GROUP BY page_id) c USING (page_id) WHERE a.r = 1""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE g AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a AS vec_id, a AS to_ FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.to_),
c AS (SELECT vec_id, min(to_) AS c FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, d.vec_id) AS component_id, d.vec_id = coalesce(c.c, d.vec_id) AS kept
FROM embeddings d LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op7_decontamination": f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s+9], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s+n-1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, s, spots.n FROM spots JOIN win USING (n, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_preference_format": """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS r FROM conversations),
g AS (
  SELECT pair_id, conv_id % 2 AS side, max(conv_id) AS conv_id, list(role ORDER BY turn, role, text) AS roles,
    list(r ORDER BY turn, role, text) AS rs FROM t GROUP BY 1, 2),
b AS (
  SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id,
    coalesce(max(rs) FILTER (side = 0), []) AS c, coalesce(max(roles) FILTER (side = 0), []) AS cr,
    coalesce(max(rs) FILTER (side = 1), []) AS j, coalesce(max(roles) FILTER (side = 1), []) AS jr FROM g GROUP BY pair_id),
p AS (
  SELECT *, coalesce(list_position(list_transform(range(1, least(len(c), len(j)) + 1), lambda i: c[i] = j[i]), false) - 1, least(len(c), len(j))) AS k FROM b),
s AS (SELECT *, c[k+1:] AS ca, cr[k+1:] AS cra, j[k+1:] AS ja, jr[k+1:] AS jra FROM p)
SELECT pair_id, chosen_id, rejected_id, k::BIGINT AS n_prefix, len(ca)::BIGINT AS n_chosen, len(ja)::BIGINT AS n_rejected,
  coalesce(array_to_string(c[:k], ''), '') AS prompt, coalesce(array_to_string(ca, ''), '') AS chosen, coalesce(array_to_string(ja, ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: cra[i] = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(ca[:i-1], lambda x: length(x))), 0) + length(cra[i]) + 5)::BIGINT || '-' || list_sum(list_transform(ca[:i], lambda x: length(x)))::BIGINT), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ja) + 1), lambda i: jra[i] = 'assistant'), lambda i:
    (coalesce(list_sum(list_transform(ja[:i-1], lambda x: length(x))), 0) + length(jra[i]) + 5)::BIGINT || '-' || list_sum(list_transform(ja[:i], lambda x: length(x)))::BIGINT), ','), '') AS rejected_spans
FROM s""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(ts) AS n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, coalesce(array_to_string(ts[1:a], ''), '') AS pre, coalesce(array_to_string(ts[a+1:b], ''), '') AS mid, coalesce(array_to_string(ts[b+1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
}
