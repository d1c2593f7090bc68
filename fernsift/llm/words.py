"""Words of many texts at once, as 64-bit hashes, by numpy over the UTF-8 bytes.

A word is a longest run of bytes other than space and ``\\x09-\\x0D``. Its hash depends on its bytes alone:
the sum of a random number per byte value times a power of an odd base by position in the word, mixed at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=1)
def _tables():
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | U(1)
    lowered = values.copy()
    lowered[0x41:0x5B] = values[0x61:0x7B]
    other = np.ones(256, bool)  # what is no letter or digit, of ASCII
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        other[a:b] = False
    base = np.full(CHUNK + 1, _BASE, np.uint64)
    base[0] = 1
    inverse = np.full(CHUNK + 1, U(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return space, other, values, lowered, np.cumprod(base), np.cumprod(inverse)


@dataclass
class Words:
    """``hashes`` of all words in order; words of text i are ``first[i]:first[i + 1]``; ``chars`` are code points in words."""

    hashes: np.ndarray
    first: np.ndarray
    chars: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null rows are empty."""
    texts = pa.chunked_array(texts).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    width = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize) if len(texts) else np.zeros(1, width)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return body[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """All words of all texts; ``lower`` folds A-Z (only these). With ``letters`` all ASCII but letters and digits parts words."""
    body, at = raw(texts)
    space, other, values, lowered, power, inverse = _tables()
    blank = (other if letters else space)[body]
    n = len(body)
    new = np.zeros(n + 1, bool)
    new[at] = True
    inside = ~blank
    after = np.ones(n + 1, bool)  # a word ends before here: blank, the start of a text, or the end
    after[:n] = blank | new[:n]
    before = np.ones(n, bool)
    if n:
        before[1:] = blank[:-1]
        before |= new[:n]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after[1:]) + 1
    table = lowered if lower else values
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        upto = int(np.searchsorted(ends, low + CHUNK, "right"))
        if upto == done:  # one word longer than a chunk
            hashes[done] = _long(body[low : ends[done]], table, power)
            done += 1
            continue
        high = int(ends[upto - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[body[low:high]] * power[: high - low], out=sums[1:])
        s = starts[done:upto] - low
        hashes[done:upto] = (sums[ends[done:upto] - low] - sums[s]) * inverse[s]
        done = upto
    hashes = mix(hashes)
    first = np.searchsorted(starts, at)
    points = np.zeros(n + 1, np.int64)
    np.cumsum(inside & ((body & 0xC0) != 0x80), out=points[1:])
    return Words(hashes, first, points[at[1:]] - points[at[:-1]])


def _long(word: np.ndarray, table: np.ndarray, power: np.ndarray) -> np.uint64:
    total, step = U(0), U(1)
    with np.errstate(over="ignore"):
        for k in range(0, len(word), CHUNK):
            part = word[k : k + CHUNK]
            total = total + np.sum(table[part] * power[: len(part)], dtype=np.uint64) * step
            step = step * power[CHUNK]
    return total


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; one of the whole if there are fewer, none without words."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, U(size), np.uint64)
    for k in range(size):
        out *= _BASE
        out += words[k : k + n]
        out ^= out >> U(29)
    return mix(out)
