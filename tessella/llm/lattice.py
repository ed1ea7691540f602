"""LM scoring by the marginal likelihood of all subword segmentations.

The pieces of an existing vocabulary and their scores weight every segmentation of a text; a
forward recursion in log space adds them up. White space always starts a piece, so the lattice of
a text falls apart into the lattices of its words and its log probability is their sum, plus that
of its end. Words are therefore scored once for the whole corpus, not once per place.

The installed vocabularies store merge ranks, not unigram scores. A piece's score is therefore its
share of the pieces that the vocabulary's own segmentation gives for all training tokens, each
piece, byte piece and the end counted once more (add-one); an ill-fitting vocabulary shows in the
score alone, not in the recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.token_files import blocks

LN10 = log(10)
#: Most frequent words, counted in workers without a join: about 40 bytes each. The rest is joined.
FREQUENT = 300_000
#: Words that go through the recursion side by side, at most, and numbers in their largest array.
ABREAST, CELLS = 4096, 2_000_000
#: Bytes of text that a worker splits at a time.
BLOCK = 4 << 20
MARK = "▁"
#: Odd multipliers of the polynomial hash of a piece and of its place in the table.
STEP, SPREAD, PLACES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18


class Lattice:
    """A vocabulary's pieces with natural logs of their probabilities, and the forward recursion.

    Every character, piece or not, can also be spelled by one byte piece for each of its bytes.
    Without ``uses`` all pieces weigh the same. ``ends`` are the training texts.
    """

    def __init__(self, path: str, uses: dict[int, int] | None = None, ends: int = 0) -> None:
        model, uses = processor(path), uses or {}
        names, bytes_ = {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                bytes_[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                names[model.id_to_piece(i)] = i
        total = sum(uses.get(i, 0) for i in (*names.values(), *bytes_.values())) + ends + len(names) + 256 + 1
        self.logs = {name: log((uses.get(i, 0) + 1) / total) for name, i in names.items()}
        self.bytes = np.array([log((uses.get(bytes_.get(b, -1), 0) + 1) / total) for b in range(256)])
        self.end = log((ends + 1) / total)
        self.longest = max(map(len, self.logs))
        self._place()

    def _place(self) -> None:
        """Lay pieces out by hash, the next free place where one is taken."""
        size = 1 << PLACES
        self.keys, self.masses = np.zeros(size, dtype=np.uint64), np.zeros(size)
        for name, value in self.logs.items():
            key = np.zeros(1, dtype=np.uint64)
            for c in name:
                key = key * STEP + np.uint64(ord(c) + 1)
            at = int(((key * SPREAD) >> np.uint64(64 - PLACES))[0])
            while self.keys[at] != 0:
                if self.keys[at] == key[0]:
                    raise ValueError(f"two pieces have one hash: {name!r}")
                at = (at + 1) % size
            self.keys[at], self.masses[at] = key[0], exp(value)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Probabilities of pieces by hash; zero where no piece has it."""
        flat = keys.ravel()
        at = ((flat * SPREAD) >> np.uint64(64 - PLACES)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == flat, self.masses[at], 0.0)
        left = np.flatnonzero((found != flat) & (found != 0))
        while left.size:
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            hit = found == flat[left]
            out[left[hit]] = self.masses[at[left[hit]]]
            left = left[~hit & (found != 0)]
        return out.reshape(keys.shape)

    def _spelled(self, codes: np.ndarray) -> np.ndarray:
        """Log of each character's spelling in bytes."""
        c, low, own = codes.astype(np.int64), 0x3F, self.bytes
        one = own[c & 0x7F]
        two = own[0xC0 | (c >> 6 & 0x1F)] + own[0x80 | c & low]
        three = own[0xE0 | (c >> 12 & 0xF)] + own[0x80 | (c >> 6 & low)] + own[0x80 | c & low]
        four = own[0xF0 | (c >> 18 & 7)] + own[0x80 | (c >> 12 & low)] + own[0x80 | (c >> 6 & low)] + own[0x80 | c & low]
        return np.where(c < 0x80, one, np.where(c < 0x800, two, np.where(c < 0x10000, three, four)))

    def word(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of one word, however long."""
        text = MARK + word
        get, longest = self.logs.get, self.longest
        spelled = self._spelled(_codes(text)).tolist()
        forward = [0.0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            logs = [forward[end - 1] + spelled[end - 1]]
            for start in range(max(end - longest, 0), end):
                p = get(text[start:end])
                if p is not None:
                    logs.append(forward[start] + p)
            top = max(logs)
            forward[end] = top + log(sum([exp(x - top) for x in logs])) if len(logs) > 1 else top
        return forward[-1]

    def words(self, words: list[str]) -> np.ndarray:
        """``word()`` of each: words of about one length go through the recursion side by side."""
        out = np.empty(len(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        at, rising = 0, sizes[order]
        while at < len(order):
            stop = int(np.searchsorted(rising, rising[at] * 1.2, "right"))
            part = order[at : min(stop, at + ABREAST)]
            at += len(part)
            if len(part) < 3:
                found = np.full(len(part), np.nan)
            else:
                longest = int(sizes[part[-1]])
                codes = _codes("".join([(MARK + words[i]).ljust(longest, "\0") for i in part])).reshape(len(part), longest)
                found = self._side_by_side(codes, sizes[part])
            for k in np.flatnonzero(np.isnan(found)):
                found[k] = self.word(words[part[k]])
            out[part] = found
        return out

    def _side_by_side(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The recursion over the rows of ``codes``, words by ascending size, filled up with zeros.

        Sums are kept as numbers and scaled as they shrink; a word in which neighbouring sums lie too
        far apart for that gets no number, and is left to the recursion over logs.
        """
        rows, n = codes.shape
        reach = min(n, self.longest)
        chars = np.zeros((n + reach - 1, rows), dtype=np.uint32)  # a place of all words lies together
        chars[reach - 1 :] = codes.T
        forward = np.zeros((n + reach + 1, rows))  # the sum for an end is at that place plus reach
        forward[reach] = 1
        scale, least, out, done = np.zeros(rows), np.ones(rows), np.full(rows, np.nan), 0
        step = max(CELLS // (reach * rows), 1)
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            m, region = hi - lo, chars[lo : hi + reach - 1]
            ways = np.empty((m, reach, rows))  # by end, then start
            keys, wide = np.zeros((len(region) + 1, rows), dtype=np.uint64), region.astype(np.uint64) + np.uint64(1)
            for length in range(1, reach + 1):
                keys = keys[: len(region) - length + 1] * STEP + wide[length - 1 :]
                ways[:, reach - length] = self._find(keys[reach - length : reach - length + m])
            ways[:, reach - 1] += np.exp(self._spelled(region[reach - 1 : reach - 1 + m]))
            for i in range(m):
                end = lo + i + 1
                here = np.einsum("ij,ij->j", forward[end : end + reach], ways[i])
                forward[end + reach] = here
                np.minimum(least, here, out=least)
                while done < rows and sizes[done] == end:
                    if least[done] > 1e-280:
                        out[done] = np.log(here[done]) + scale[done]
                    done += 1
                if end % 4 == 0:
                    window = forward[end + 1 : end + reach + 1]
                    top = window.max(axis=0)
                    top[top == 0] = 1
                    window /= top
                    scale += np.log(top)
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(maxsize=2)
def processor(path: str):
    """One sentencepiece model a worker and file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def mixture(counted: np.ndarray, share: float, lattice: np.ndarray) -> np.ndarray:
    """Natural log of ``counted + share * exp(lattice)``, in log space, so no word is too long."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(counted), log(share) + lattice)


def training(doc_id: Column) -> Column:
    """Rows that are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of all texts, lower-cased, and the texts' words as their numbers with edges."""
    # Taken, not sliced: pyarrow's lower-casing reads the wrong bytes of an array that starts inside another.
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(own))
    flat = words.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an edge of a text leaves empty words
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    edges = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = flat.filter(real).dictionary_encode()
    return coded, kept[edges]


def score_texts(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """Score every document; ``path`` is a sentencepiece model that every executor can read.

    ``docs(doc_id, text)``; other columns are ignored. Words are runs without ASCII white space of
    the text with A-Z lowered, followed by one end token. Returns per row ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score`` (add-one unigram), ``score`` (the lattice) and
    ``mixed_score`` (a word's share of the training tokens beside its lattice, which has the mass of
    words seen once), all log10.

    Null and empty texts consist of the end token. Rows that repeat a ``doc_id`` are scored each
    by itself; rows without ``doc_id`` are held out. Without any training row no word is known and
    all pieces weigh the same. An empty table gives an empty one.

    Counting pre-aggregates in workers and shuffles one row for each word and block. Scoring sends
    nothing for the ``frequent`` words, whose scores go along with the tasks, and one row for each
    document and rarer word otherwise; those meet the word table in a join that can be split.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        training(F.col("doc_id")).alias("learn"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counts = rows.mapInArrow(_word_counts, "word binary, c long, n long")
    words = written(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counts")
    ends = rows.where("learn").count()
    sums = words.agg(F.sum("c").alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, distinct = (sums["tokens"] or 0) + ends, sums["distinct"] + (ends > 0)
    share = min(max(sums["once"] / max(total, 1), 0.001), 0.5)
    uses = _uses(words.where("c > 0"), path)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(path, uses, ends)
        for batch in _joined(batches, 100_000):
            names = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            c, lattice = batch.column(1).to_numpy(), own.words(names)
            base = np.log((c + 1) / (total + distinct + 1))
            mixed = mixture((1 - share) * c / max(total, 1), share, lattice)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x / LN10) for x in (base, lattice, mixed))], names=WEIGHED)

    weighed = written(words.mapInArrow(weigh, WEIGHED_SCHEMA), "words")
    top = weighed.where(F.col("n") >= _threshold(words, frequent)).select("word", "c", "base", "model", "mixed").toArrow().combine_chunks()
    sure = [top.column("word").combine_chunks(), *(top.column(x).to_numpy() for x in ("base", "model", "mixed"))] + [top.column("c").to_numpy() > 0]
    own_end = (log((ends + 1) / (total + distinct + 1)) / LN10, Lattice(path, uses, ends).end / LN10, log((1 - share) * ends / max(total, 1) or share) / LN10, int(ends > 0))
    shared = docs.sparkSession.sparkContext.broadcast((sure, own_end))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: one row of sums over frequent words, one for each rarer word."""
        (names, *weights, known), end = shared.value
        for batch in batches:
            for k, size in blocks(batch.column(3), 4096, BLOCK):
                part = batch.slice(k, size)
                coded, edges = _split(part.column(3))
                words, at = coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), coded.indices.to_numpy()
                doc = np.repeat(np.arange(size), np.diff(edges))
                found = pc.index_in(words, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[at] if len(words) else np.zeros(0, dtype=np.int64)
                is_sure = found >= 0
                here, hit = doc[is_sure], found[is_sure]
                base, model, mixed = (np.bincount(here, weights=w[hit], minlength=size) + e for w, e in zip(weights, end, strict=False))
                n_known = np.bincount(here, weights=known[hit], minlength=size).astype(np.int64) + end[3]
                pairs, n = np.unique(doc[~is_sure].astype(np.int64) * max(len(words), 1) + at[~is_sure], return_counts=True)
                uid, zeros = part.column(0).to_numpy(), np.zeros(pairs.size)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.nulls(size, pa.binary()), pa.array(np.diff(edges) + 1), pa.array(n_known), pa.array(base), pa.array(model), pa.array(mixed)],
                    names=TALLY,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[pairs // max(len(words), 1)]), pa.nulls(pairs.size, pa.int64()), pa.nulls(pairs.size, pa.bool_()),
                        words.take(pa.array(pairs % max(len(words), 1))), pa.array(n), pa.array(zeros.astype(np.int64)), *[pa.array(zeros)] * 3,
                    ],
                    names=TALLY,
                )
                del part, coded, words, at, doc, found, here, hit, pairs
                pa.default_memory_pool().release_unused()

    # A row has a number of its own, as doc_id may repeat or be null; it stays in the written table.
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "learn", "text")
    tallies = written(numbered.mapInArrow(tally, TALLY_SCHEMA), "tallies")
    rare = tallies.where("word is not null").select("uid", "word", "n")
    rare = rare.join(weighed.select("word", "c", "base", "model", "mixed"), "word").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        *(F.sum(F.col("n") * F.col(x)).alias(f"rare_{x}") for x in ("base", "model", "mixed")),
    )
    heads = tallies.where("word is null").select("uid", "doc_id", "learn", "n", "n_known", "base", "model", "mixed")
    out = heads.join(rare, "uid", "left")
    both = {x: F.col(x) + F.coalesce(f"rare_{x}", F.lit(0.0)) for x in ("base", "model", "mixed")}
    return out.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        both["base"].alias("base_score"),
        both["model"].alias("score"),
        both["mixed"].alias("mixed_score"),
    )


def _threshold(words: DataFrame, frequent: int) -> int:
    """The smallest count for which no more than ``frequent`` words occur as often."""
    step = F.floor(F.log2("n") * 8)  # a few hundred steps at most
    left, least = frequent, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        if r["k"] > left:
            break
        left, least = left - r["k"], r["n"]
    return (1 << 62) if least is None else least


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _uses(words: DataFrame, path: str) -> dict[int, int]:
    """How often the vocabulary's own segmentation of all training tokens uses each piece, by its id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        uses = np.zeros(model.get_piece_size(), dtype=np.int64)
        for batch in batches:
            found = model.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(), [len(x) for x in found])
            np.add.at(uses, np.fromiter((i for x in found for i in x), dtype=np.int64, count=times.size), times)
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], names=["piece", "uses"])

    found = words.select("word", "c").mapInArrow(count, "piece long, uses long").groupBy("piece").agg(F.sum("uses").alias("uses"))
    return {r["piece"]: r["uses"] for r in found.collect()}  # as many rows as the vocabulary has pieces


WEIGHED = ["word", "c", "n", "base", "model", "mixed"]
WEIGHED_SCHEMA = "word binary, c long, n long, base double, model double, mixed double"
TALLY = ["uid", "doc_id", "learn", "word", "n", "n_known", "base", "model", "mixed"]
TALLY_SCHEMA = "uid long, doc_id long, learn boolean, word binary, n long, n_known long, base double, model double, mixed double"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each block with their counts in training rows (c) and in all rows (n)."""
    for batch in batches:
        for k, size in blocks(batch.column(2), 1 << 20, BLOCK):
            part = batch.slice(k, size)
            coded, edges = _split(part.column(2))
            at, many = coded.indices.to_numpy(), len(coded.dictionary)
            learn = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(edges))
            counts = [np.bincount(at[learn], minlength=many), np.bincount(at, minlength=many)]
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), *map(pa.array, counts)], names=["word", "c", "n"])
            del part, coded, at, learn, counts
            pa.default_memory_pool().release_unused()
