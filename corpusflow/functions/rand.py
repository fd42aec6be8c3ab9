"""Seeded draws that do not depend on row order or partitioning (R1..R3).

A draw is the first 32 bits of ``md5('seed:stream:key')`` divided by 2^32.
It is a pure function of (seed, stream, key): re-running a task after an
executor loss, or reading the input with another split layout, gives the
same numbers.  (A Mersenne-Twister stream cannot be reproduced in parallel,
so the permutation differs from a single-process one; the distribution and
determinism are what is kept.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seeded_bits(seed: int, stream: str, key) -> Column:
    """The 32-bit integer behind :func:`seeded_uniform` (a LONG in [0, 2^32))."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), _c(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: int, stream: str, key) -> Column:
    """A uniform draw in [0, 1)."""
    return seeded_bits(seed, stream, key) / F.lit(TWO_32)


def seeded_index(seed: int, stream: str, key, n) -> Column:
    """A uniform choice of an index in [0, n)."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.floor(seeded_uniform(seed, stream, key) * n_col).cast("int")
