"""Seeded random numbers that depend only on the seed and the draw index.

Partitioning, retries and row order cannot change them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwave.functions.scalar import _c

# Fixed values of the mulberry32 generator
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF
TWO_32 = 4294967296.0


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product; the left side goes in halves to stay inside a long."""
    high = F.shiftright(a, 16) * b
    low = a.bitwiseAND(0xFFFF) * b
    return (F.shiftleft(high.bitwiseAND(0xFFFF), 16) + low).bitwiseAND(MASK)


def _let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def uniform(seed, draw) -> Column:
    """Draw number ``draw`` (from 0) of the mulberry32 sequence of ``seed``, in [0, 1).

    The sequence has 2^32 draws; a draw beyond them is an error, since it would repeat an earlier one.
    """
    s = _c(seed).cast("long").bitwiseAND(MASK)
    d = _c(draw).cast("long")
    d = F.when((d < 0) | (d > MASK), F.raise_error(F.lit("a draw must be from 0 to 2^32 - 1"))).otherwise(d)
    n = (d + 1).bitwiseAND(MASK)
    state = (s + _mul32(n, F.lit(STEP).cast("long"))).bitwiseAND(MASK)

    def scramble(t: Column) -> Column:
        mixed = _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
        return t.bitwiseXOR((t + mixed).bitwiseAND(MASK))

    t = _let(state, lambda a: _mul32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1))))
    return _let(_let(t, scramble), lambda u: u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(TWO_32))


def gauss(seed, draw) -> Column:
    """Standard normal from draws 2*draw and 2*draw+1 (Box-Muller).

    A first uniform of exactly 0 counts as half a step, so indices stay fixed.
    """
    return gauss_from(uniform(seed, _c(draw) * 2), uniform(seed, _c(draw) * 2 + 1))


def gauss_from(u: Column, w: Column) -> Column:
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(0.5 / TWO_32)))) * F.cos(2 * math.pi * w)


def draws_of(dist: str) -> int:
    return 1 if dist == "uniform" else 2


def toleranced(nominal, tol, dist: str, seed, first_draw) -> Column:
    """A value with a tolerance: uniform over it, or normal with it as three sigma."""
    n, t, d = _c(nominal).cast("double"), _c(tol).cast("double"), _c(first_draw)
    if dist == "uniform":
        return n * (1 + t * (uniform(seed, d) * 2 - 1))
    return n * (1 + t / 3 * gauss_from(uniform(seed, d), uniform(seed, d + 1)))
