"""Word and shingle hashes of whole texts, vectorised over an Arrow batch with numpy.

Words are maximal runs without space, tab, line feed, vertical tab, form feed or carriage return;
A-Z are lower-cased first. A word's hash is a multilinear hash of its bytes to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once: bounds the temporary arrays, about 60 bytes for each byte of text.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE = _random(256, 1 << 40)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _random(4096, 1 << 41)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _random(2 * n, 1 << 41)
    return _PLACE


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about CHUNK bytes, with the index of the first; null is empty."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > CHUNK:
            yield first, run
            first, size, run = i, 0, []
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): the words of text i are bounds[i]:bounds[i+1]."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    letter = ~_IS_SPACE[buf]
    at = np.flatnonzero(letter)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.greater(np.diff(at), 1, out=new[1:])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[buf[at]] * _places(int(length.max()))[place], first)
        h = mix(h + length.astype(np.uint64))
    return h, np.concatenate(([0], np.searchsorted(at[first], ends))).astype(np.int64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text's word hashes; a shorter text is one shingle, an empty one none."""
    n = len(h)
    if not n:
        return h
    weights = _random(max(k, n if n < k else 0), 1 << 42)
    with np.errstate(over="ignore"):
        if n < k:
            return mix((h * weights[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s += h[j : n - k + 1 + j] * weights[j]
        return np.unique(mix(s + np.uint64(k)))
