"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from sparkwave.llm.segments import Cache

WORDS = 5
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_cache = Cache(lambda w: int.from_bytes(blake2b(w, digest_size=8).digest(), "little"), limit=30_000)


def shingle_set(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct ``n``-word shingles; a text of fewer words is one shingle of all its words, a text without words has none.

    Words are runs of characters other than ASCII white space, with A-Z in lower case.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _FACTOR + h[k : len(h) - width + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)
