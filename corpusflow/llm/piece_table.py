"""A worker's bounded table of encoded text pieces.

A text is cut where no token of the vocabulary can cross, the pieces of a
block are hashed and made distinct at once, and only pieces that the worker has
not met are encoded.  The ids of whole texts are then gathered with numpy.
Beyond ``MAX_PIECES`` the table starts afresh, so its memory is bounded; what
it holds never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from corpusflow.llm.words import Block, U, blocks

MAX_PIECES = 1_500_000
TABLE_BLOCK = 6 << 20

#: (list of pieces) -> ids of each
Encoder = Callable[[list[str]], list[list[int]]]


class PieceTable:
    def __init__(self, encode: Encoder):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=U)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 20, dtype=np.uint16)
        self.used = 0

    def _add(self, block: Block, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = block.data.tobytes()
        got = self.encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist())])
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter(chain.from_iterable(got), dtype=np.uint16, count=int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used: self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)

    def block_ids(self, block: Block, start: np.ndarray, end: np.ndarray, doc_at: np.ndarray,
                  tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block and the offset of each text in them.

        ``start``/``end`` are the pieces in order and ``doc_at`` the first piece
        of each text (and their number); ``tail`` is an id put after each text.
        """
        hashes = block.span_hash(block.running(False), start, end)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MAX_PIECES:
            self._clear()
        row = np.searchsorted(self.keys, keys)
        known = row < len(self.keys)
        known[known] = self.keys[row[known]] == keys[known]
        if not known.all():
            new = first[~known]
            self._add(block, keys[~known], start[new], end[new])
            row = np.searchsorted(self.keys, keys)
        at, size = self.at[row][back], self.size[row][back]
        if tail is not None:  # one more piece after each text
            at, size = np.insert(at, doc_at[1:], -1), np.insert(size, doc_at[1:], 1)
            doc_at = doc_at + np.arange(len(doc_at))
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total, dtype=np.int64)
        source += np.repeat(at - (ends - size), size)
        if tail is not None:
            closing = ends[doc_at[1:] - 1] - 1
            source[closing] = 0
        out = self.ids[source]
        if tail is not None:
            out[closing] = tail
        return out, np.append(0, ends)[doc_at]


def batch_ids(table: PieceTable, col: pa.Array, spans: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]],
              tail: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of the blocks of a string column."""
    for row, end, block in blocks(col, TABLE_BLOCK):
        yield row, end, *table.block_ids(block, *spans(block), tail)


def word_pieces(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces between ASCII white space, for vocabularies that drop white space."""
    return *block.word_spans, block.word_off


def gap_pieces(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for byte-level vocabularies whose tokens take one leading space.

    Cuts lie before a single space, and on both sides of a single line feed,
    between characters that are not white space; no token crosses them.
    """
    d, n = block.data, len(block.data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[block.off] = True
    if n >= 3:
        # bytes of white space, the wide characters' bytes taken generously
        odd = (d == 0xC2) | ((d >= 0xE1) & (d <= 0xE3))
        white = block.space.copy()
        white |= odd
        white[1:] |= odd[:-1]
        white[2:] |= (odd & (d >= 0xE1))[:-2]
        lone = np.zeros(n, dtype=bool)
        lone[1:-1] = ~white[:-2] & ~white[2:]
        inner = np.zeros(n, dtype=bool)
        inner[1:-1] = ~cut[1:-2] & ~cut[2:-1]  # neither neighbour is in another text
        lone &= inner
        line = lone & (d == 0x0A)
        cut[:-1] |= line | (lone & (d == 0x20))
        cut[1:] |= line
    at = np.flatnonzero(cut)
    return at[:-1], at[1:], np.searchsorted(at, block.off)
