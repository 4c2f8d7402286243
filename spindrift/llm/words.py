"""Hashes of the words of many texts at once, in NumPy: no Python object for each word.

A word is a maximal run of bytes outside of [\\x20\\x09-\\x0D]. Its hash is a polynomial over its bytes modulo 2**64, each byte first
replaced by a random 64-bit number, then scrambled with the word's length. Words of several texts are found in one pass over the Arrow
buffer; a single text beyond the chunk size is cut between words, so memory is bounded by the chunk and the longest word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

np.seterr(over="ignore")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """seed chooses one of many independent hash functions."""

    def __init__(self, seed: int = 0, lower: bool = True):
        base = mix64(np.array([2 * seed + 1], np.uint64) * _STEP)
        self.factor = int(base[0]) | 1
        self.inverse = pow(self.factor, -1, 1 << 64)
        self.values = mix64(base + _STEP * np.arange(1, 257, dtype=np.uint64))
        if lower:
            self.values = self.values[_LOWER]
        self.values[_SPACE] = 0
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.factor, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each word data[start:end]; between two words there are only spaces, or nothing."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._powers(len(data))
        terms = self.values[data]
        terms *= self.up[: len(data)]
        return mix64(np.add.reduceat(terms, starts) * self.down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and the bounds of each. Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(data: np.ndarray, size: int = CHUNK):
    """Ranges of about `size` bytes that end behind a space or with the data."""
    begin = 0
    while begin < len(data):
        end = begin + size
        while end < len(data):
            behind = np.flatnonzero(_SPACE[data[end : end + 65536]])
            if len(behind):
                end += int(behind[0]) + 1
                break
            end += 65536
        yield begin, min(end, len(data))
        begin = end


def word_bounds(data: np.ndarray, cuts: np.ndarray, kinds: np.ndarray | None = None, parted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; cuts: positions where a text begins, which no word crosses.

    kinds (of each byte value, space 0) and parted (of each pair of kinds) cut words further, where neighbouring bytes are parted.
    """
    edge = np.zeros(len(data) + 1, bool)
    if kinds is None:
        space = _SPACE[data]
        edge[1:-1] = space[1:] != space[:-1]
    else:
        kind = kinds[data]
        space = kind == 0
        edge[1:-1] = parted.ravel()[kind[:-1] * np.uint8(len(parted)) + kind[1:]]
    edge[0] = edge[-1] = True
    edge[cuts] = True
    at = np.flatnonzero(edge)
    word = ~space[at[:-1]] if len(data) else np.zeros(0, bool)
    return at[:-1][word], at[1:][word]


def lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spared: np.ndarray) -> np.ndarray:
    """data with A-Z lower-cased, but in words that have a byte of those spared (a table of all byte values)."""
    low = _LOWER[data]
    if len(kept := np.flatnonzero(spared[data])):
        words = np.unique(np.searchsorted(starts, kept, side="right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[words]] += 1
        step[ends[words]] -= 1
        np.copyto(low, data, where=np.cumsum(step[:-1], dtype=np.int8) > 0)
    return low


def hashed_words(texts: pa.Array, *hashers: WordHasher) -> tuple[list[np.ndarray], np.ndarray]:
    """For each hasher the hashes of all words of all texts, and the bounds of each text in them."""
    data, bounds = text_bytes(texts)
    found, counts = [[] for _ in hashers], np.zeros(len(bounds), np.int64)
    for a, b in chunks(data):
        inside = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
        starts, ends = word_bounds(data[a:b], inside)
        for hasher, out in zip(hashers, found, strict=True):
            out.append(hasher.hashes(data[a:b], starts, ends))
        counts += np.searchsorted(starts + a, bounds)
    return [np.concatenate([np.zeros(0, np.uint64), *out]) for out in found], counts
