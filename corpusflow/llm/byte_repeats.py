"""Exact repeated byte strings over all documents (operator 8).

In the place of merging the shards' Burrows-Wheeler transforms by refining an
interleave, which takes a pass per byte of common prefix, this sorts hashed
symbols of sparse suffixes: there is no lexicographic order and no prefix length
in bytes.  A shard (one of Spark's input tasks) keeps a suffix only at its
anchors: the anchor of a start i is the smallest 8-byte gram (hashed, leftmost
of ties) among the ``WINDOW`` grams from i, so equal strings have their anchor
at the same place, and the starts of one anchor are consecutive.  As a repeat
is judged on ``LENGTH`` bytes, a suffix is read to that depth as two symbols:
the bytes that lie in every string of the anchor, and the tail to the end of
the last one; its transform symbol is what stands before it, back to the first
start.

The merge interleaves the shards' suffixes by the first symbol and refines
each interval with more than one suffix by the second, then by the symbol
before.  The common prefix of neighbours follows from the round in which they
part: an interval of one suffix is unique; suffixes that never part, and whose
symbols before agree, are repeated from all their starts; what parts only at
the tail or before the suffix is the edge of a repeat, and there the strings
of each start are told apart by their own hashes.  All of that is decided from
neighbours in order, so a group of any size streams through in bounded memory.

Texts are UTF-8 bytes, and matches never cross documents.  Defined results: a
null or empty text has no bytes; overlapping occurrences in one text count;
equal texts of at least ``LENGTH`` bytes go whole, all of them; rows that
repeat an identifier are documents of their own; an empty table gives an empty
table; other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import row_keyed, stored
from corpusflow.llm.words import Block, U, blocks, mix, repeated

LENGTH, WINDOW, GRAM = 400, 128, 8


def anchors(block: Block, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start): the starts of strings of ``length``
    bytes inside one text, by anchor; positions in the block."""
    data, off = block.data, block.off
    none = np.zeros(0, dtype=np.int64)
    n = len(data) - GRAM + 1
    stop = off[1:] - length + 1  # starts before this
    fits = stop > off[:-1]
    if n < window or not fits.any():
        return none, none, none
    grams = np.ndarray(n, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    key = grams * U(0x9E3779B97F4A7C15)
    key ^= key >> U(29)
    key *= U(0xBF58476D1CE4E5B9)
    key &= U(0xFFFFFFFF00000000)
    key |= np.arange(n, dtype=U)
    span = 1
    while span < window:
        step = min(span, window - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    first = np.zeros(len(key) + 1, dtype=np.int8)
    first[off[:-1][fits]] += 1
    np.add.at(first, stop[fits], -1)
    start = np.flatnonzero(np.cumsum(first[:-1], dtype=np.int8))
    at = (key[start] & U(0xFFFFFFFF)).astype(np.int64)
    head = np.ones(len(at), dtype=bool)
    head[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    lo = np.flatnonzero(head)
    return at[lo], start[lo], start[np.append(lo[1:], len(at)) - 1]


def suffixes(docs: DataFrame, id_col: str, text_col: str, length: int, window: int) -> DataFrame:
    """The shards' sparse transforms: sym (first symbol), rest (tail, symbol before
    and extent), doc_id, lo (first start), n (starts), known.

    Suffixes that are equal within a block are known to repeat: one of them
    stands for all in the merge, the others are dealt out evenly.  So a symbol
    that a large part of all suffixes share is one row a block."""
    core = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, _, block in blocks(batch.column(1)):
                at, lo, hi = anchors(block, length, window)
                if not len(at):
                    continue
                sums = block.running(False)
                sym = block.span_hash(sums, at, at + core)
                tail = block.span_hash(sums, at + core, hi + length)
                before = block.span_hash(sums, lo, at)
                rest = mix(tail ^ mix(before ^ ((hi - lo).astype(U) << U(8)), 3), 4)
                known, later = repeated(mix(sym ^ mix(rest, 6), 7))
                spread = np.flatnonzero(later)
                sym[spread] = mix(sym[spread] + mix(at[spread].astype(U), 8), 9)
                doc = np.searchsorted(block.off, lo, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(sym.view(np.int64)), pa.array(rest.view(np.int64)), ids.take(pa.array(row + doc)),
                    pa.array((lo - block.off[doc]).astype(np.int64)), pa.array((hi - lo + 1).astype(np.int32)), pa.array(known)],
                    ["sym", "rest", "doc_id", "lo", "n", "known"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"sym long, rest long, doc_id {kind}, lo long, n int, known boolean")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]]:
    """Each batch with rows, and the one after it."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, batch
            held = batch
    if held is not None:
        yield held, None


def intervals(order: DataFrame) -> DataFrame:
    """Read the merged order: suffixes repeated from all their starts (sure),
    and those at the edge of a repeat, with one of each kind they may meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None      # (sym, rest) of the row before
        opened = None    # the first rest of the current sym
        for batch, after in _with_next(batches):
            sym, rest = batch.column("sym").to_numpy(), batch.column("rest").to_numpy()
            n = len(sym)
            up, up_rest = np.empty(n + 1, dtype=bool), np.empty(n + 1, dtype=bool)  # same as the row above
            up[1:-1], up_rest[1:-1] = sym[1:] == sym[:-1], rest[1:] == rest[:-1]
            up[0] = last is not None and last[0] == sym[0]
            up_rest[0] = last is not None and last[1] == rest[0]
            up[-1] = after is not None and after.column("sym")[0].as_py() == sym[-1]
            up_rest[-1] = after is not None and after.column("rest")[0].as_py() == rest[-1]
            up_rest &= up
            above, below = up[:-1], up[1:]
            above_rest, below_rest = up_rest[:-1], up_rest[1:]
            head = np.maximum.accumulate(np.where(~above, np.arange(n), -1))
            first = np.where(head >= 0, rest[np.maximum(head, 0)], opened if opened is not None else 0)
            sure = above_rest | below_rest | batch.column("known").to_numpy(zero_copy_only=False)
            shared = above | below                       # an interval of several suffixes
            mixed = shared & ((first != rest) | (below & ~below_rest))
            edge = (shared & ~sure) | (mixed & ~below_rest)  # of equal ones, the last stands for all
            last, opened = (sym[-1], rest[-1]), first[-1]
            for mask, kind_ in ((sure, True), (edge, False)):
                some = batch.filter(pa.array(mask))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), some.column("lo"), some.column("n"), pa.array(np.full(some.num_rows, kind_))],
                        ["doc_id", "lo", "n", "sure"])

    kind = order.schema["doc_id"].dataType.simpleString()
    return order.mapInArrow(run, f"doc_id {kind}, lo long, n int, sure boolean")


def edge_strings(texts: DataFrame, length: int) -> DataFrame:
    """hash, doc_id, start of every string that starts in an edge run of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("edges")
            for row, end, block in blocks(batch.column("text")):
                sums, doc, start = block.running(False), [], []
                for d in range(row, end):
                    if not runs[d].is_valid:
                        continue
                    own = np.unique(np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in runs[d].as_py()]))
                    doc.append(np.full(len(own), d))
                    start.append(own)
                if not doc:
                    continue
                doc, start = np.concatenate(doc), np.concatenate(start)
                at = block.off[doc - row] + start
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.span_hash(sums, at, at + length).view(np.int64)), batch.column("doc_id").take(pa.array(doc)),
                    pa.array(start)], ["hash", "doc_id", "lo"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "edges").where("edges is not null").mapInArrow(run, f"hash long, doc_id {kind}, lo long")


def _twice(strings: DataFrame) -> DataFrame:
    """Rows whose hash a neighbour in order shares, joined to runs of starts per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch, after in _with_next(batches):
            h = batch.column("hash").to_numpy()
            same = np.empty(len(h) + 1, dtype=bool)
            same[1:-1] = h[1:] == h[:-1]
            same[0] = last is not None and last == h[0]
            same[-1] = after is not None and after.column("hash")[0].as_py() == h[-1]
            last = h[-1]
            yield batch.filter(pa.array(same[:-1] | same[1:])).select(["doc_id", "lo"])

    kind = strings.schema["doc_id"].dataType.simpleString()
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(run, f"doc_id {kind}, lo long")


def cover(spans: list[dict], n: int, length: int) -> np.ndarray:
    """Which of n bytes lie in a string that starts in one of the runs (lo, n)."""
    lo = np.array([x["lo"] for x in spans], dtype=np.int64)
    hi = lo + np.array([x["n"] for x in spans], dtype=np.int64) - 1 + length
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and kept_sha256; with ``with_text``
    also the bytes that are kept."""
    keyed, key = row_keyed(docs.select(id_col, text_col), id_col)
    out = _remove_repeats(keyed, key, text_col, length, window, with_text)
    if key != id_col:
        names = keyed.select(F.col(key).alias("row"), F.col(id_col).alias("name"))
        out = out.join(names, F.col("doc_id") == F.col("row")).select(F.col("name").alias("doc_id"), *out.columns[1:])
    return out


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int, window: int, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    merged = suffixes(docs, "doc_id", "text", length, window).repartition(parts, "sym").sortWithinPartitions("sym", "rest")
    found = stored(intervals(merged), "repeat-intervals")
    per_doc = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.when(F.col("sure"), F.struct("lo", "n"))).alias("sure"),
        F.collect_list(F.when(~F.col("sure"), F.struct("lo", "n"))).alias("edges"))
    joined = docs.join(per_doc, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "text", "sure", F.when(F.size("edges") > 0, F.col("edges")).alias("edges"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, sure = batch.column("text"), batch.column("sure")
            more = batch.column("more") if "more" in batch.schema.names else None
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = (texts[k].as_py() or "").encode("utf-8")
                spans = list(sure[k].as_py() or []) + [{"lo": x, "n": 1} for x in (more[k].as_py() or [] if more is not None else [])]
                gone = 0
                n_spans = 0
                kept = raw
                if spans:
                    mask = cover(spans, len(raw), length)
                    gone = int(mask.sum())
                    n_spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((doc, len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            take = 6 if with_text else 5
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, types))[:take]], names[:take])

    # the texts move once; those with an edge wait in a table for what it decides
    joined = stored(joined, "repeat-texts")
    edges = stored(_twice(edge_strings(joined, length)).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("lo").alias("more")), "repeat-edges")
    plain = joined.where("edges is null").select("doc_id", "text", "sure").mapInArrow(finish, columns)
    open_ = joined.where("edges is not null").join(edges, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "sure", "more")
    return plain.unionByName(open_.mapInArrow(finish, columns))
