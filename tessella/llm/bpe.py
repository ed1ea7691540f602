"""BPE encoding and decoding with a contiguous rank array per short word.

A word's symbols are held as one array of part boundaries beside one array of the ranks of
adjacent parts. The minimum rank is found by scanning the array, its boundary is deleted, and the
ranks of the two neighbours are looked up again, until no adjacent parts can merge. Words are
short, so the scan beats any heap. A word of more than ``SHORT`` bytes, for which scanning would
cost the square of its length, takes its merges in the same order from a heap over linked parts.
Each worker keeps the ids of short words it has met, in a bounded memory, and joins them per text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = "doc_id long, ids binary, decoded string"
#: Words whose ids a worker remembers, about 150 bytes each; only those of up to SHORT bytes.
REMEMBERED = 600_000
#: The longest word in bytes that is merged by scanning.
SHORT = 64
_NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCodec:
    """Encoder and decoder for a tokenizer file of the word-ending BPE kind.

    Normalises (NFC, white space to one space, lower case), takes words by the file's own pattern,
    and works on their bytes. Added tokens are found in the raw text first, as the format asks.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.alphabet = byte_alphabet()
        self.first = [self.vocab.get(c) for c in self.alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in self.alphabet]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.texts: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, bytes] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: repeatedly merge the adjacent parts of lowest rank, leftmost first."""
        data = word.encode("utf-8")
        parts = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        parts = [p for p in parts if p is not None]  # a byte that the vocabulary lacks has no id
        return self._scanned(parts) if len(parts) <= SHORT else self._heaped(parts)

    def _scanned(self, parts: list[int]) -> list[int]:
        """Merges by scanning the array of ranks, which lies beside that of the parts."""
        pairs = self.ranks
        at = [pairs.get(pair, (_NO_RANK, 0)) for pair in zip(parts, parts[1:])]
        while at:
            best = min(at)
            if best[0] == _NO_RANK:
                break
            i = at.index(best)
            parts[i : i + 2] = [best[1]]
            del at[i]
            if i < len(at):
                at[i] = pairs.get((parts[i], parts[i + 1]), (_NO_RANK, 0))
            if i:
                at[i - 1] = pairs.get((parts[i - 1], parts[i]), (_NO_RANK, 0))
        return parts

    def _heaped(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place); entries whose pair is gone are passed over."""
        pairs, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in pairs]
        heap = [(rank, i, new, pair) for rank, new, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != pair[0] or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in pairs:
                    rank, merged = pairs[parts[a], parts[b]]
                    heapq.heappush(heap, (rank, a, merged, (parts[a], parts[b])))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> bytes:
        text = lower(unicodedata.normalize("NFC", text) if not text.isascii() else text)
        words = self.words.findall(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        long = []
        for word in words:
            if word not in known:
                known[word] = np.array(self.encode_word(word), dtype="<u4").tobytes()
                if len(word) > SHORT:
                    long.append(word)
        out = b"".join(map(known.__getitem__, words))
        for word in long:
            del known[word]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        pieces = self.split.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in pieces if p)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: the file names no decoder, so word ends and bytes stay as written."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def text(self, ids: bytes) -> str:
        """A readable text: bytes back to characters, a space at each word end."""
        place = {c: i for i, c in enumerate(self.alphabet)}
        out = bytearray()
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            token = self.texts[i]
            if i in self.special.values():
                out += token.encode()
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            out += bytes(place[c] for c in token.removesuffix(self.suffix)) + b" " * ends
        return out.decode("utf-8", "replace")


def lower(text: str) -> str:
    """Lower case letter by letter (no final-sigma rule, as the tokenizer format does it)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """One codec a worker and file."""
    return WordCodec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of every document.

    ``docs(doc_id, text)``; ``path`` is a tokenizer file that every executor can read. Returns per
    row ``doc_id, ids`` (little-endian unsigned 32-bit integers) and ``decoded``. Null and empty
    texts have no ids and decode to the empty string; rows may repeat and ids may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CODES)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from the operator's own output.

    Digests are taken in the worker, so that ids and decoded texts don't travel back only to be
    reduced to 64 characters. Nulls, empty texts, repeats and further columns are as above; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out: list[list] = [[], [], []]
            for t in batch.column(1).to_pylist():
                ids = own.encode(t or "")
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
