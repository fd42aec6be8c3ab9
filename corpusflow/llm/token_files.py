"""Binary token files with a wavelet matrix per shard (operator 4).

A shard holds the ids of a run of whole documents, each closed by ``END_ID``,
as 16 bit-planes: plane 0 is the highest bit of the ids in order, and each
further plane follows the order that a stable split by the plane before it
leaves (zeros first).  Ranks are kept per 4096 bits.  From one file
one can read any token, count a token in any prefix, find its n-th occurrence and
read whole documents.  Opening a file unpacks its planes; the ids themselves are
only rebuilt where they are asked for.

File layout (little endian): magic ``CFWM1``, then zstandard frames with an
index of (offset, length): header JSON, document identifiers, document
offsets, the planes and their rank blocks.  Documents are in ascending order
of identifier, within and across shards.  A task writes a file under a name of
its own and then renames it, so a repeated task leaves one whole file.

Defined results: null counts as empty (only the end id); rows that repeat an
identifier are each written, in order of their texts; a null identifier sorts
first; an empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.piece_table import batch_ids, word_pieces
from corpusflow.llm.tokens import library_words

END_ID, BITS = 2, 16
MAGIC = b"CFWM1"
#: Tokens after which a shard is closed (with its last document whole).
SHARD_TOKENS = 1 << 21
RANK_EVERY = 4096


def _spread(bit: np.ndarray, zeros: int) -> np.ndarray:
    """Where a stable split by ``bit`` (zeros first) puts each element."""
    ones = np.cumsum(bit, dtype=np.int32)
    to = np.arange(len(bit), dtype=np.int32) - ones
    ones += np.int32(zeros - 1)
    np.copyto(to, ones, where=bit.view(bool))
    return to


class WaveletMatrix:
    """Ids as bit-planes with rank support."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, cur = len(ids), ids.astype(np.uint16)
        zeros, planes, ranks = [], [], []
        for b in range(BITS - 1, -1, -1):
            bit = ((cur >> np.uint16(b)) & np.uint16(1)).astype(np.uint8)
            ones = int(bit.sum())
            zeros.append(n - ones)
            planes.append(np.packbits(bit, bitorder="little"))
            edge = np.arange(0, n, RANK_EVERY)
            sums = np.add.reduceat(bit, edge, dtype=np.int64) if n else np.zeros(0, np.int64)
            ranks.append(np.append(0, np.cumsum(sums)).astype("<i8"))
            nxt = np.empty_like(cur)
            nxt[_spread(bit, n - ones)] = cur
            cur = nxt
        return cls(n, zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        blk = i // RANK_EVERY
        part = self.planes[level][blk * RANK_EVERY // 8: (i + 7) // 8]
        return int(self.ranks[level][blk]) + int(np.unpackbits(part, count=i - blk * RANK_EVERY, bitorder="little").sum())

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for level in range(BITS):
            bit = self._bit(level, i)
            out = out << 1 | bit
            i = self._down(level, i, bit)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(BITS):
            bit = token >> (BITS - 1 - level) & 1
            lo, hi = self._down(level, lo, bit), self._down(level, hi, bit)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before position ``end``."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token; -1 if there is none."""
        lo, hi = self._range(token, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(BITS - 1, -1, -1):
            bit = token >> (BITS - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        before = self.ranks[level] if bit else np.minimum(np.arange(len(self.ranks[level])) * RANK_EVERY, self.n) - self.ranks[level]
        blk = int(np.searchsorted(before, k, side="right")) - 1
        lo = blk * RANK_EVERY
        bits = np.unpackbits(self.planes[level][lo // 8: (lo + RANK_EVERY) // 8], bitorder="little")[: self.n - lo]
        return lo + int(np.flatnonzero(bits == bit)[k - int(before[blk])])

    def tokens(self) -> np.ndarray:
        """All ids in order: the stable splits undone from the last plane up."""
        out = np.zeros(self.n, dtype=np.uint16)
        for level in range(BITS - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            out = out.take(_spread(bit, self.zeros[level]))
            out |= bit.astype(np.uint16) << np.uint16(BITS - 1 - level)
        return out


def dump(matrix: WaveletMatrix, doc_ids: list, off: np.ndarray) -> bytes:
    """A shard file's bytes."""
    head = json.dumps({"n": matrix.n, "zeros": matrix.zeros, "docs": len(doc_ids), "end_id": END_ID}).encode()
    ids = json.dumps(doc_ids, separators=(",", ":")).encode()
    parts = [head, ids, off.astype("<i8").tobytes(), *[p.tobytes() for p in matrix.planes], *[r.tobytes() for r in matrix.ranks]]
    pack = zstandard.ZstdCompressor(level=1)
    frames = [pack.compress(p) for p in parts]
    size = np.array([len(f) for f in frames], dtype="<i8")
    return MAGIC + struct.pack("<i", len(frames)) + size.tobytes() + b"".join(frames)


class Shard:
    """An opened shard file."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<i", raw, len(MAGIC))
        at = len(MAGIC) + 4
        size = np.frombuffer(raw, "<i8", n, at)
        ends = at + 8 * n + np.cumsum(size)
        unpack = zstandard.ZstdDecompressor()
        part = [unpack.decompress(raw[e - s: e]) for s, e in zip(size.tolist(), ends.tolist())]
        head = json.loads(part[0])
        self.doc_ids = json.loads(part[1])
        self.off = np.frombuffer(part[2], "<i8")
        planes = [np.frombuffer(p, np.uint8) for p in part[3: 3 + BITS]]
        ranks = [np.frombuffer(p, "<i8") for p in part[3 + BITS: 3 + 2 * BITS]]
        self.matrix = WaveletMatrix(head["n"], head["zeros"], planes, ranks)


def write_shards(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` to ``folder`` (a URI all executors share).

    Returns the manifest: part, shard, file, docs, tokens; one row per file.
    The texts are range-sorted by identifier and shuffled once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fs_, root = library_words(path), *pafs.FileSystem.from_uri(folder)
        fs_.create_dir(root, recursive=True)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        chunks: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(chunks)
            size = np.concatenate(sizes)
            off = np.append(0, np.cumsum(size))
            name = f"{root}/part-{part:06d}-{shard:06d}.wm"
            own = f"{root}/.{uuid.uuid4().hex}"
            with fs_.open_output_stream(own) as f:
                f.write(dump(WaveletMatrix.build(ids), doc_ids, off))
            fs_.move(own, name)
            return pa.RecordBatch.from_pydict({
                "part": [part], "shard": [shard], "file": [name], "docs": [len(doc_ids)], "tokens": [len(ids)]},
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for row, end, ids, off in batch_ids(table, batch.column(1), word_pieces, tail=END_ID):
                names = batch.column(0).slice(row, end - row).to_pylist()
                at = 0
                while at < len(names):
                    stop = int(np.searchsorted(off, off[at] + shard_tokens - held, side="left"))
                    stop = min(max(stop, at + 1), len(names))
                    doc_ids += names[at:stop]
                    chunks.append(ids[off[at]: off[stop]])
                    sizes.append(np.diff(off[at: stop + 1]))
                    held += int(off[stop] - off[at])
                    at = stop
                    if held >= shard_tokens:
                        yield close()
                        doc_ids, chunks, sizes, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, "doc_id")
    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, "part int, shard int, file string, docs long, tokens long")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32
    (and the ids).  ``manifest`` has a row per file, so numbering files is small."""
    before = F.sum("tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "shard", "file", F.coalesce(before, F.lit(0)).alias("before"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                with fs_.open_input_stream(name) as f:
                    shard = Shard(f.read())
                wide, off = shard.matrix.tokens().astype("<u4"), shard.off
                spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
                cols = [
                    pa.array(shard.doc_ids, batch_kind), pa.array(first + off[:-1]), pa.array(np.diff(off)),
                    pa.array([zlib.crc32(wide[s:e]) for s, e in spans], pa.int64())]
                if with_ids:
                    cols.append(pa.array([wide[s:e].tolist() for s, e in spans], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    batch_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "part", "shard").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
