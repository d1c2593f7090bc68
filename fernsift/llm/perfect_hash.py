"""A minimal perfect hash of a set of keys, built and asked by numpy.

Level by level, every key that has a slot of a bit array for itself sets that bit; the others go to the next, smaller
array. The number of set bits before its own is a key's place, ``0 .. n - 1``. Asking costs a few array look-ups
whatever the number of keys; a key that is not in the set may get a place too, which a stored fingerprint tells.
"""

from __future__ import annotations

import numpy as np
import xxhash

from fernsift.llm.words import U, mix

SPREAD = 2  # slots per key of a level


def key_hashes(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers per key; keys are integers, strings or None."""
    out = np.empty((len(keys), 2), np.uint64)
    for i, k in enumerate(keys):
        data = b"" if k is None else b"i" + int(k).to_bytes(16, "little", signed=True) if isinstance(k, int) else b"s" + str(k).encode()
        h = xxhash.xxh3_128_intdigest(data)
        out[i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    return out[:, 0], out[:, 1]


def fingerprints(hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (mix(hashes[0] ^ mix(hashes[1])) >> U(32)).astype(np.uint32)


def _slots(hashes, level: int, size: int) -> np.ndarray:
    return mix(hashes[0] + U(level + 1) * (hashes[1] | U(1))) % U(size)


def build(hashes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Bit arrays by level. The pairs of numbers must differ."""
    levels, left = [], hashes
    while len(left[0]):
        size = (SPREAD * len(left[0]) + 63) // 64 * 64
        slots = _slots(left, len(levels), size)
        alone = np.bincount(slots.astype(np.int64), minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        rest = ~alone[slots]
        left = left[0][rest], left[1][rest]
        if len(levels) > 200:
            raise ValueError("two keys have the same hash")
    return levels


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        self.before, total = [], 0
        for x in self.bits:
            self.before.append(total + np.cumsum(x, dtype=np.int64) - x)
            total += int(x.sum())
        self.size = total

    def places(self, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The place of every key; -1 for keys that no level has."""
        out = np.full(len(hashes[0]), -1, np.int64)
        open_ = np.arange(len(out))
        for level, bits in enumerate(self.bits):
            slots = _slots((hashes[0][open_], hashes[1][open_]), level, len(bits)).astype(np.int64)
            hit = bits[slots] == 1
            out[open_[hit]] = self.before[level][slots[hit]]
            open_ = open_[~hit]
        return out
