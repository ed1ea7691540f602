"""Token-ID output: Parquet list columns, read back selectively.

Layout of a token set below ``path``:

* ``tokens/``  one file a range of ids, in ascending ``doc_id``: ``doc_id, part, at`` (ids of the
  part before the document), ``n_tokens, ids`` (list of int, end id included). Ids are
  dictionary-encoded (a vocabulary fits one dictionary page) and fall back to delta packing;
  counts and ids of documents are delta-packed. Row groups are bounded in bytes, pages in rows and
  bytes, and the writer adds page indexes, so a few documents or columns cost a few pages.
* ``parts/``   one row a part: its first global position.

A document starts at its part's position plus ``at``. Both folders are written by Spark's own
Parquet writer: a lost executor's task is written again, and only committed files are read.
"""

from __future__ import annotations

from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Chunks whose ids a worker remembers (twice as many at most, and pre-tokens a sixth), and the longest of them in characters.
REMEMBERED, REMEMBERED_LENGTH = 260_000, 40
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1000
#: Rows that are encoded at a time.
BLOCK = 2048
#: The byte-level format's own pre-token pattern (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the ids of a chunk that no cut is allowed before; ids have four bytes each.
NO_CUT = b"-"
#: Where a text is cut besides spaces, and the mark of such a cut after the space that is put there.
LETTER_STOP, JOINT = "([A-Za-zÀ-ÖØ-öø-ɏ])([,.])", "\x1f"
LAYOUT = [f"<{n}I" for n in range(40)]
ROWS = "doc_id long, part int, at long, n_tokens long, ids array<int>"


class TextEncoder:
    """Encodes with the tokenizers library; each distinct piece of text is encoded once and remembered.

    Pre-tokens of a byte-level tokenizer don't influence each other, and none reaches over a space
    that is followed by other than white space, as such a space starts a pre-token. Arrow cuts all
    texts at such spaces, and between a Latin letter and a comma or full stop, where no pre-token
    reaches over either, and numbers the distinct chunks; only chunks not seen before meet the
    pre-token pattern and the library's model. Texts in which white space follows a space, or that
    hold an added token's string or the mark of a cut, are encoded by themselves.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PRE_TOKENS)
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        #: Ids by chunk: as the first of a text, and after a space.
        #: The dictionary that grows, and the full one before it.
        self.chunks: list[tuple[dict[str, bytes], dict[str, bytes]]] = [({}, {}), ({}, {})]

    def encode(self, texts: list[str] | pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one row of unsigned 32-bit integers, and where each text begins.

        ``end``, ids in bytes, follows every text.
        """
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        parts = pc.split_pattern(pc.replace_substring_regex(texts, LETTER_STOP, rf"\1 {JOINT}\2"), " ")
        edges = parts.offsets.to_numpy()
        first = np.zeros(int(edges[-1]), dtype=bool)
        first[edges[:-1]] = True
        at = np.empty(first.size, dtype=np.int32)
        found: list[bytes] = []
        for spaced, mask in ((0, first), (1, ~first)):
            coded = parts.values.filter(pa.array(mask)).dictionary_encode()
            at[mask] = coded.indices.to_numpy() + len(found)
            found += self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), spaced)
            del coded
        del first, mask
        # Texts that can't be cut at every space have one piece: all their ids.
        odd = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) == len(NO_CUT)
        alone = np.logical_or.reduceat(odd[at], edges[:-1]) if len(texts) else np.zeros(0, dtype=bool)
        for a in (JOINT, *self.added):
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        n_parts = np.where(alone, 1, np.diff(edges)) + 1
        begins = np.concatenate(([0], np.cumsum(n_parts)))
        use = np.empty(int(begins[-1]), dtype=np.int32)
        is_end = np.zeros(use.size, dtype=bool)
        is_end[begins[1:] - 1] = True
        is_own = np.zeros(use.size, dtype=bool)
        is_own[begins[:-1][alone]] = True
        use[is_end] = len(found)
        use[is_own] = len(found) + 1 + np.arange(int(alone.sum()))
        use[~is_end & ~is_own] = at[~np.repeat(alone, np.diff(edges))]
        found.append(end)
        found += [self._whole(texts[i].as_py()) for i in np.flatnonzero(alone)]
        del parts, at, is_end, is_own
        return _laid_out([b"" if x == NO_CUT else x for x in found] if odd.any() else found, use, begins)

    def _ids(self, chunks: list[str], spaced: int) -> list[bytes]:
        """Ids of distinct chunks, each with its space before it if ``spaced``; NO_CUT where none is allowed there."""
        known, older = self.chunks[spaced]
        out = list(map(known.get, chunks))
        words, other, aged = [], [], older.get
        for i, x in enumerate(out):
            if x is None:
                chunk = chunks[i]
                x = aged(chunk)
                if x is not None:
                    out[i] = known[chunk] = x
                elif spaced and chunk.isalpha():
                    words.append(i)
                elif spaced and (not chunk or chunk[0].isspace()) and chunk[:1] != JOINT:
                    out[i] = NO_CUT
                else:
                    other.append(i)
        fresh = [chunks[i] for i in words]
        found = self._words(fresh)
        if found is None:  # the pattern's letters are not those of isalpha()
            other += words
        else:
            known.update(zip(fresh, found, strict=True))
            for i, x in zip(words, found, strict=True):
                out[i] = x
        for i in other:
            chunk = chunks[i]
            out[i] = x = self._cut(chunk[1:] if chunk[:1] == JOINT else " " + chunk if spaced else chunk)
            if len(chunk) <= REMEMBERED_LENGTH:
                known[chunk] = x
        if len(known) > REMEMBERED:
            self.chunks[spaced] = ({}, known)
        return out

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of words, each with a space before it; None if one of them is not a single pre-token."""
        if not words:
            return []
        text = " " + " ".join(words)
        if len(self.pattern.findall(text)) != len(words):
            return None
        tokenize, layout, space = self.model.tokenize, LAYOUT, self.letters[32]
        out = []
        for word in charmap_decode(text.encode(), "strict", self.letters)[0].replace(space, "\n" + space).split("\n")[1:]:
            ids = [t.id for t in tokenize(word)]
            out.append(pack(layout[len(ids)] if len(ids) < len(layout) else f"<{len(ids)}I", *ids))
        return out

    def _cut(self, text: str) -> bytes:
        """Ids of a text by its pre-tokens."""
        known, out = self.pieces, []
        for piece in self.pattern.findall(text):
            x = known.get(piece)
            if x is None:
                ids = [t.id for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.letters)[0])]
                x = pack(f"<{len(ids)}I", *ids)
                if len(known) > REMEMBERED // 6:
                    known.clear()
                if len(piece) <= REMEMBERED_LENGTH:
                    known[piece] = x
            out.append(x)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        """Ids of one text: by the library itself where it holds an added token's string."""
        if any(a in text for a in self.added):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        return self._cut(text)


def _laid_out(found: list[bytes], use: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``found[use]`` in a row, and the places of ``begins`` in it."""
    pool = np.frombuffer(b"".join(found), dtype="<u4")
    sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[use]
    ends = np.cumsum(n, dtype=np.int32)
    places = np.repeat(starts[use] - ends + n, n)
    places += np.arange(places.size, dtype=np.int32)
    return pool[places], np.concatenate(([0], ends))[begins].astype(np.int64)


def _byte_letters() -> str:
    """The letters that stand for the 256 bytes in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return "".join(chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder a worker and file."""
    return TextEncoder(path)


def blocks(texts: pa.Array, rows: int = BLOCK, size: int = 6 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of blocks of up to ``rows`` rows and, past a first row, ``size`` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    k = 0
    while k < len(ends):
        limit = size + (ends[k - 1] if k else 0)
        n = max(min(int(np.searchsorted(ends, limit, "right")) - k, rows), 1)
        yield k, n
        k += n


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` in ascending ``doc_id`` order and write a token set.

    Null and empty texts have the end id alone. Rows that repeat a ``doc_id`` are written one after
    the other, ordered by a hash of their text, then by it; null ids come first. Other columns are
    ignored; an empty table gives an empty set. ``parts`` bounds the number of files.

    Files are ranges of id and hash: no text is among the samples that the driver gets, and rows
    that share an id can be dealt out, unless their texts are the same too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("tie"))
    ranged = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("text"))
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, end = encoder(tokenizer), 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for k, size in blocks(batch.column(1)):
                part = batch.slice(k, size)
                # Taken, not sliced: some of pyarrow's text functions misread an array inside another.
                ids, before = own.encode(part.column(1).take(pa.array(np.arange(size))), end)
                lists = pa.ListArray.from_arrays(before.astype(np.int32), ids.view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(at + before[:-1]), pa.array(np.diff(before)), lists], names=["doc_id", "part", "at", "n_tokens", "ids"]
                )
                at += int(before[-1])
                del part, ids, before, lists
                pa.default_memory_pool().release_unused()

    writer = ranged.mapInArrow(run, ROWS).write.option("compression", "zstd")
    for key, value in {
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.compression.codec.zstd.level": "1",
    }.items():
        writer = writer.option(key, value)
    writer.parquet(f"{path}/tokens")
    sums = spark.read.schema(ROWS).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a part: as many as the files, however many documents there are.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("part", F.coalesce(before, F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of a token set, without reading any ids."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a token set; filters on doc_id reach row groups and pages."""
    return _placed(spark, path).select("doc_id", "start", "n_tokens", "ids")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    tokens = spark.read.schema(ROWS).parquet(f"{path}/tokens")
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    return tokens.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("at"))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the checksum over little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            edges = lists.offsets.to_numpy()
            sums = [crc32(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
