"""Fill-in-the-middle over whole Arrow batches.

A text's tokens are words with the white space before them, and white space at its end. All texts of
a block lie in one UTF-8 buffer; no text is taken by itself. A table of byte classes tells white
space; a mask of adjacent bytes tells where tokens end; its running sum, set back at each text,
counts them, and a binary search in it finds the bytes at which the texts are cut, for all rows
together. Bytes of several-byte letters are no white space, so cuts never split one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.llm.token_files import blocks

#: Before the prefix, suffix and middle (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "42:"
#: Shares of a hundred: of texts that are changed at all, and of these, of the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
#: Bytes a block, unless one text is longer.
BLOCK_BYTES = 4 << 20
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
MARK = np.isin(np.arange(256), [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of an id; a null id is taken as empty."""
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, ends included; the array has no nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


def marks(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the three marks stand inside texts, and the rows that hold them."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & MARK[data[1:-1]] & (data[2:] == PREFIX[2]))
    row = np.searchsorted(edges, at, "right") - 1
    inside = at + 3 <= edges[row + 1]
    return at[inside], row[inside]


def joined(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts put together of pieces of a pool: a row of ``starts`` and ``sizes`` for each."""
    flat, many = starts.ravel(), sizes.ravel()
    ends = np.cumsum(many)
    places = np.repeat(flat - ends + many, many)
    places += np.arange(len(places))
    edges = np.concatenate(([0], ends[sizes.shape[1] - 1 :: sizes.shape[1]])) if len(sizes) else np.zeros(1, dtype=np.int64)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(pool[places])])


def cut(texts: pa.Array, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of all texts, given their four numbers."""
    data, edges = buffer_of(texts)
    begin, end = edges[:-1], edges[1:]
    filled = end > begin
    # A token ends where a word does, or the text.
    blank = SPACE[data]
    stop = ~blank
    stop[:-1] &= blank[1:]
    stop[end[filled] - 1] = True
    count = np.concatenate(([0], np.cumsum(stop, dtype=np.int32)))
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    base = count[begin]
    n = (count[end] - base).astype(np.int64)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    # The byte after the k-th end of a text; no token is its beginning.
    after = lambda k: np.where(k == 0, begin, np.searchsorted(count, base + k, "left"))
    first, second = after(np.minimum(a, b)), after(np.maximum(a, b))
    held = np.zeros(len(n), dtype=bool)
    held[marks(data, edges)[1]] = True
    form = np.where(~filled | held | (h[2] % 100 >= RATE), PLAIN, np.where(h[3] % 100 < SPM_RATE, SPM, PSM))
    pool = np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, dtype=np.uint8)])
    p, s, m = (np.full(len(n), len(data) + k) for k in (0, 3, 6))
    three, none = np.full(len(n), 3), np.zeros(len(n), dtype=np.int64)
    prefix, middle, suffix = (begin, first - begin), (first, second - first), (second, end - second)
    order = {
        PLAIN: [(begin, end - begin)] + [(begin, none)] * 5,
        PSM: [(p, three), prefix, (s, three), suffix, (m, three), middle],
        SPM: [(s, three), suffix, (p, three), prefix, (m, three), middle],
    }
    starts, sizes = (np.stack([np.choose(form, [order[f][k][j] for f in (PLAIN, PSM, SPM)]) for k in range(6)], axis=1) for j in (0, 1))
    return n, form, letters[first] - letters[begin], letters[second] - letters[first], joined(pool, starts, sizes)


def rebuilt(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts that outputs were made of, from them and their forms alone."""
    data, edges = buffer_of(outputs)
    begin, end = edges[:-1], edges[1:]
    at, row = marks(data, edges)
    at = at[form[row] != PLAIN].reshape(-1, 3)  # a changed text has three marks, as it had none
    one, two, three = (np.zeros(len(form), dtype=np.int64) for _ in range(3))
    changed = form != PLAIN
    one[changed], two[changed], three[changed] = at[:, 0], at[:, 1], at[:, 2]
    front, back, middle = (one + 3, two - one - 3), (two + 3, three - two - 3), (three + 3, end - three - 3)
    none = (begin, np.zeros(len(form), dtype=np.int64))
    order = {PLAIN: [(begin, end - begin), none, none], PSM: [front, middle, back], SPM: [back, middle, front]}
    starts, sizes = (np.stack([np.choose(form, [order[f][k][j] for f in (PLAIN, PSM, SPM)]) for k in range(3)], axis=1) for j in (0, 1))
    return joined(data, starts, sizes)


FIM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame) -> DataFrame:
    """Fill-in-the-middle forms of ``docs(doc_id, text)``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` tokens; the id's hash decides on the form and on the two cuts. Empty and null texts, those
    that hold a mark and those that the hash leaves out are ``plain``: the output is the text, the
    two lengths in code points are null. Rows that repeat an id are each cut by the same numbers; a
    null id counts as empty. Other columns are ignored; an empty table gives an empty one. No
    shuffle: a task holds one block of texts, or one longer text, a few times over.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *draws(F.col("doc_id").cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, size in blocks(batch.column(1), 1 << 16, BLOCK_BYTES):
                part = batch.slice(k, size)
                n, form, before, inside, output = cut(part.column(1), [part.column(j).to_numpy() for j in range(2, 6)])
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), FORMS.take(pa.array(form)), pa.array(before.astype(np.int64), mask=plain), pa.array(inside.astype(np.int64), mask=plain), output],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                del part, output

    return rows.mapInArrow(run, FIM)


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`transform` with ``restored``, the text rebuilt from ``output`` and ``form``.

    Null outputs are taken as empty, and forms that are none of the three as plain.
    """
    names = [c for c in rows.columns if c != "restored"]
    own = rows.select(*(F.coalesce("output", F.lit("")).alias(c) if c == "output" else F.col(c) for c in names))
    form, output = names.index("form"), names.index("output")
    schema = StructType([*own.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, size in blocks(batch.column(output), 1 << 16, BLOCK_BYTES):
                part = batch.slice(k, size)
                kind = pc.index_in(part.column(form), FORMS).fill_null(PLAIN).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, rebuilt(part.column(output), kind)], names=[*names, "restored"])
                del part

    return own.mapInArrow(run, schema)
