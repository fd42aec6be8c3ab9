"""Packing along a space-filling curve (operator 3).

Each document becomes a vector of hashed 4-byte features, is projected on a
few fixed random directions and quantised; the Hilbert index of that point is
its place on the curve.  Spark range-sorts the texts by (place, identifier),
and each range lays its documents end to end and cuts every ``SEQ_LEN``
tokens, so neighbours on the curve share sequences.  Only the last sequence of
a range can be short, and it is padded to ``SEQ_LEN`` unless its length is a
power of two.

A document's ids are those of the byte-level vocabulary followed by id 0.  A
null or empty text is the single id 0.  Equal texts have equal places and
follow each other by identifier; rows that repeat an identifier too are each
packed (their order among themselves is by text).  An empty table gives an
empty table.  Sequence identifiers are unique, not dense: the range's number
times 2^32 plus the number within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark import TaskContext

from corpusflow.llm.piece_table import PieceTable, batch_ids, gap_pieces
from corpusflow.llm.tokens import library_bytes
from corpusflow.llm.words import blocks

SEQ_LEN, END_ID = 1024, 0
#: Feature buckets, projected dimensions and bits of each on the curve.
BUCKETS, DIMS, BITS = 512, 4, 10
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def directions() -> np.ndarray:
    """Fixed random directions in feature space (orthogonal to the all-ones vector,
    which only tells a text's spread)."""
    d = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    return d - d.mean(axis=0)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (Skilling's transpose, all rows at once)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, places on the curve) of a string column."""
    dirs = directions()
    for row, end, block in blocks(col):
        d = block.data.astype(np.uint32)
        vec = np.zeros((block.n_docs, BUCKETS))
        if len(d) >= 4:
            gram = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
            bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            for k in range(block.n_docs):
                s, e = block.off[k], block.off[k + 1] - 3
                if e > s:
                    vec[k] = np.bincount(bucket[s:e], minlength=BUCKETS)
        norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        z = (vec @ dirs) / np.maximum(norm, 1e-9)
        unit = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution function
        yield row, end, hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def with_curve_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, key in curve_keys(batch.column(1)):
                some = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), some.column(0), some.column(1)], ["curve", "doc_id", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"curve long, doc_id {kind}, text string")


def pack(docs: DataFrame, encoder: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text",
         seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids.

    ``encoder``: the tokenizers file, the rank file of the same vocabulary and
    its split pattern.  The texts are shuffled once, as texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length",
             *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PieceTable = library_bytes(*encoder)
        base, filled = TaskContext.get().partitionId() << 32, 0
        late: list = []  # rows of the sequence that is not full yet
        for batch in batches:
            for row, end, ids, off in batch_ids(table, batch.column(1), gap_pieces, tail=END_ID):
                # one cut at every text start and every full sequence
                cuts = np.union1d(off, np.arange((-filled) % seq_len, len(ids) + 1, seq_len))
                cuts = cuts[cuts <= len(ids)]
                begin, size = cuts[:-1], np.diff(cuts)
                doc = np.searchsorted(off, begin, side="right") - 1
                place = filled + begin
                wide = ids.astype("<u4")
                some = pa.table({
                    "doc_id": batch.column(0).slice(row, end - row).take(pa.array(doc)),
                    "start": begin - off[doc],
                    "length": size,
                    "ids_crc32": np.fromiter((zlib.crc32(wide[s: s + n]) for s, n in zip(begin.tolist(), size.tolist())), np.int64, len(begin)),
                    "doc_tokens": (off[1:] - off[:-1])[doc],
                    "sequence_id": base + place // seq_len,
                    "offset": place % seq_len,
                })
                if with_ids:
                    some = some.append_column("ids", pa.array([wide[s: s + n].tolist() for s, n in zip(begin, size)], pa.list_(pa.int32())))
                filled += len(ids)
                late.append(some)
                done = pa.concat_tables(late)
                last = done["sequence_id"].to_numpy()
                open_ = int(np.searchsorted(last, base + filled // seq_len)) if filled % seq_len else len(last)
                yield from _batches(done.slice(0, open_), seq_len, names)
                late = [done.slice(open_)]
        if late and late[0].num_rows:
            short = filled % seq_len
            yield from _batches(late[0], short if short & (short - 1) == 0 else seq_len, names)

    keyed = with_curve_key(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "text")
    return ranged.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {COLUMNS}, padded_length long" + (", ids array<int>" if with_ids else ""))


def _batches(done: pa.Table, padded: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    if done.num_rows:
        done = done.append_column("padded_length", pa.array(np.full(done.num_rows, padded, dtype=np.int64)))
        yield from done.select(names).combine_chunks().to_batches()
