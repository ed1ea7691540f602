"""Vectorised word and shingle hashes over UTF-8 bytes (numpy, 64 bits, no per-word Python)."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche a uint64 array (xor-shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


_BYTE = mix(np.arange(256, dtype=np.uint64) * _ODD + np.uint64(77))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z on bytes; bytes of other characters stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = odd_numbers(64, 5)


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text's bytes, A-Z lower-cased, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not raw.size:
        return np.empty(0, dtype=np.uint64)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not starts.size:
        return np.empty(0, dtype=np.uint64)
    length = ends - starts
    at = np.arange(raw.size) - np.repeat(starts, np.diff(np.concatenate((starts, [raw.size])))) if starts[0] == 0 else None
    if at is None:
        at = np.empty(raw.size, dtype=np.int64)
        at[: starts[0]] = 0
        at[starts[0] :] = np.arange(raw.size - starts[0]) - np.repeat(starts - starts[0], np.diff(np.concatenate((starts, [raw.size]))))
    longest = int(length.max())
    weights = _WEIGHTS if longest <= 64 else odd_numbers(longest, 5)
    terms = _BYTE[_LOWER[raw]] * weights[np.minimum(at, weights.size - 1)]
    terms[~word] = 0
    return mix(np.add.reduceat(terms, starts) + length.astype(np.uint64) * _ODD)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of the whole sequence if it is shorter."""
    n = words.size
    if not n:
        return words
    k = min(n, width)
    weights = odd_numbers(k, 1000 + k)
    out = words[: n - k + 1] * weights[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * weights[i]
    return mix(out)
