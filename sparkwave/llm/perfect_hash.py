"""A minimal perfect hash over 128-bit keys with a fingerprint and a count per key.

Keys are thrown into a bit array about twice their number; those that hit a place
alone keep it, the others go to the next, smaller array. A key's index is the number
of places taken before its own, so n keys get the indices 0 to n - 1. About three
bits per key, plus two bytes of fingerprint and the counts.
"""

from __future__ import annotations

import io

import numpy as np

_LOAD = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (hi + np.uint64((level + 1) * int(_MIX) & 0xFFFFFFFFFFFFFFFF)) ^ lo
    x ^= x >> np.uint64(31)
    x *= _MIX2
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def _finger(lo: np.ndarray) -> np.ndarray:
    return ((lo * _MIX2) >> np.uint64(48)).astype(np.uint16)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], finger: np.ndarray, counts: np.ndarray):
        self.levels, self.finger, self.counts = levels, finger, counts
        taken = [np.cumsum(bits, dtype=np.int64) for bits in levels]
        ends = np.cumsum([0, *(t[-1] for t in taken)])
        self.before = [t - bits + end for t, bits, end in zip(taken, levels, ends)]

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """Keys are distinct."""
        levels, left_hi, left_lo = [], hi, lo
        while len(left_hi):
            size = max(64, _LOAD * len(left_hi))
            at = _place(left_hi, left_lo, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            again = ~bits[at]
            left_hi, left_lo = left_hi[again], left_lo[again]
        made = cls(levels, np.empty(len(hi), np.uint16), np.empty(len(hi), counts.dtype))
        index = made.index(hi, lo)
        made.finger[index], made.counts[index] = _finger(lo), counts
        return made

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of every key; -1 for some keys that are not in the set."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = _place(hi[left], lo[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def lookup(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of every key; 0 where the fingerprint says that the key is not in the set."""
        index = self.index(hi, lo)
        found = index >= 0
        found[found] = self.finger[index[found]] == _finger(lo[found])
        out = np.zeros(len(hi), self.counts.dtype)
        out[found] = self.counts[index[found]]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        sizes = np.array([len(b) for b in self.levels], np.int64)
        packed = np.concatenate([np.packbits(b) for b in self.levels]) if self.levels else np.empty(0, np.uint8)
        np.savez(out, sizes=sizes, packed=packed, finger=self.finger, counts=self.counts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        with np.load(io.BytesIO(data)) as f:
            levels, at = [], 0
            for size in f["sizes"]:
                width = (int(size) + 7) // 8
                levels.append(np.unpackbits(f["packed"][at : at + width], count=int(size)).astype(bool))
                at += width
            return cls(levels, f["finger"], f["counts"])
