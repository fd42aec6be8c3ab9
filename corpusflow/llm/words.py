"""Vectorised text helpers that run inside Spark tasks.

The operators of this subpackage read whole texts in Arrow batches.  A batch
is cut into blocks of a few MB of UTF-8 (a longer text is a block of its own),
and each block is handled at once with numpy: word and line spans come from
byte masks, and the hash of any byte range from running polynomial sums.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_RADIX = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    h = h + U((seed * _MULT + _MULT) & (2**64 - 1))
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _byte_table(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U)
    if fold_case:
        upper = (codes >= 65) & (codes <= 90)
        codes = np.where(upper, codes + U(32), codes)
    return mix(codes, 77)


_TABLES = {False: _byte_table(False), True: _byte_table(True)}
_CODES = {fold: np.array([c + 32 if fold and 65 <= c <= 90 else c for c in range(256)], dtype=U) + U(1) for fold in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The second sum is taken modulo a prime: sums modulo 2^64 alone are equal for
#: some texts of much inner symmetry, whatever the radix.
_PRIME = U((1 << 42) - 11)
_CHUNK_BITS = 12
_CHUNK = 1 << _CHUNK_BITS
_ROOT = 0x2B7E151628A % int(_PRIME)
_ROOT_INV = pow(_ROOT, -1, int(_PRIME))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    low = np.full(_CHUNK, base, dtype=U)
    low[0] = 1
    low = np.multiply.accumulate(low)
    high = np.full((n >> _CHUNK_BITS) + 1, pow(base, _CHUNK, 1 << 64), dtype=U)
    high[0] = 1
    high = np.multiply.accumulate(high)
    return np.multiply.outer(high, low).reshape(-1)[:n]


_LOW_INV = _power(_RADIX_INV, _CHUNK)


def _inverse(at: np.ndarray) -> np.ndarray:
    """The inverse radix to the power of each position, modulo 2^64."""
    high = _power(pow(_RADIX_INV, _CHUNK, 1 << 64), (int(at.max()) >> _CHUNK_BITS) + 1 if len(at) else 1)
    return high[at >> _CHUNK_BITS] * _LOW_INV[at & (_CHUNK - 1)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    return (((a * (b >> U(21))) % _PRIME << U(21)) + a * (b & U((1 << 21) - 1))) % _PRIME


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime."""
    out = np.ones(1, dtype=U)
    while len(out) < n:
        out = np.append(out, _times(out, np.full(len(out), pow(base, len(out), int(_PRIME)), dtype=U)))
    return out[:n]


_IN_CHUNK, _IN_CHUNK_INV = _prime_powers(_ROOT, _CHUNK), _prime_powers(_ROOT_INV, _CHUNK)


@dataclass
class Sums:
    """Running sums of the bytes of a block: modulo 2^64 before each position, and
    modulo the prime before each chunk and inside the chunks."""

    wide: np.ndarray
    part: np.ndarray
    head: np.ndarray
    chunk: np.ndarray
    chunk_inv: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, fold_case: bool) -> Sums:
        n = len(data)
        wide = np.zeros(n + 1, dtype=U)
        np.cumsum(_TABLES[fold_case][data] * _power(_RADIX, n), out=wide[1:])
        k = (n >> _CHUNK_BITS) + 1
        codes = np.zeros((k, _CHUNK), dtype=U)
        codes.reshape(-1)[:n] = _CODES[fold_case][data]
        inner = np.cumsum(codes * _IN_CHUNK, axis=1)  # below 2^62
        part = np.zeros((k, _CHUNK), dtype=U)
        part[:, 1:] = inner[:, :-1]
        chunk = _prime_powers(pow(_ROOT, _CHUNK, int(_PRIME)), k)
        head = np.zeros(k, dtype=U)
        head[1:] = np.cumsum(_times(inner[:, -1] % _PRIME, chunk))[:-1] % _PRIME
        return cls(wide, part.reshape(-1), head, chunk, _prime_powers(pow(_ROOT_INV, _CHUNK, int(_PRIME)), k))

    def before(self, at: np.ndarray) -> np.ndarray:
        c = at >> _CHUNK_BITS
        return self.head[c] + _times(self.part[at] % _PRIME, self.chunk[c])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sum of each byte range modulo the prime, as if it began at 0."""
        diff = (self.before(end) + U(2) * _PRIME - self.before(start)) % _PRIME
        return _times(diff, _times(self.chunk_inv[start >> _CHUNK_BITS], _IN_CHUNK_INV[start & (_CHUNK - 1)]))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def release() -> None:
    """Return freed memory to the system: the workers of one stage serve the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(col: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) of a string column; rows are never cut."""
    data, off = utf8(col)
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, Block(data[off[row]: off[end]], off[row: end + 1] - off[row])
        row = end
    release()


@dataclass
class Block:
    """Whole texts laid one after another: ``data[off[d]:off[d + 1]]`` is text d."""

    data: np.ndarray
    off: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.off) - 1

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    def running(self, fold_case: bool) -> Sums:
        """Running sums of the bytes, for ``span_hash``."""
        return Sums.of(self.data, fold_case)

    def span_hash(self, run: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range, with its length; equal bytes give equal hashes."""
        start, end = np.asarray(start, dtype=np.int64), np.asarray(end, dtype=np.int64)
        h = (run.wide[end] - run.wide[start]) * _inverse(start)
        return mix(h ^ ((end - start).astype(U) * U(_MULT)) ^ mix(run.span(start, end), 3))

    @cached_property
    def word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the words ``[^\\x20\\x09-\\x0D]+``; none crosses texts."""
        return self.runs(~self.space)

    def runs(self, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the longest runs of a byte mask inside the texts."""
        if not len(solid):
            none = np.zeros(0, dtype=np.int64)
            return none, none
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < len(solid))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def word_off(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words."""
        return np.searchsorted(self.word_spans[0], self.off)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.word_off))

    def word_hashes(self, fold_case: bool = False) -> np.ndarray:
        return self.span_hash(self.running(fold_case), *self.word_spans)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte mask over each text."""
        run = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.off[1:]] - run[self.off[:-1]]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (windows may cross texts: the
    caller masks those); empty when there are fewer than k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out *= U(0xA24BAED4963EE407)
        out += words[j: j + n]
    return mix(out, k)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position lie in one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1:] if n > 0 else np.zeros(0, dtype=bool)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: keys found more than once, and those found earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later
