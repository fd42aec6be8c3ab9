"""Near-duplicate documents by SimHash and multi-index hashing (operator 12).

A text's fingerprint has a bit set where over half of the XXH64 values of its
three-word shingles have it.  Fingerprints within ``DISTANCE`` = 3 bits are
linked, and the classes are the connected components.

Equal fingerprints are one row.  A fingerprint is indexed by its two 32-bit
segments; of two fingerprints within three bits, one segment differs by one bit
at most.  So each fingerprint looks up its segments and, of the 32 segments
around each, those with one bit less (the other direction is the partner's own
lookup), and every table match is verified over all 64 bits.

A bucket of more than ``DIRECT`` fingerprints with one segment value is not
matched member by member.  Its members M have the segment in common, so a pair
of them is linked if the other segments differ by three bits at most, and a
member with a lookup from one bit away if they differ by two.  Every member
enters the ball of two bits around its other segment, every lookup the ball of
one bit, and in each point of those balls all are linked to one hub, a member
within one bit of the point: all of these are true links, and the two of any
true link meet in some point beside a hub that both are linked to.  The classes
are therefore exact, and the work grows with the number of members, never with
its square.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; the class is named by its smallest identifier (missing ones
last); where identifiers are missing or repeat, every row stands for itself; an
empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import components, row_keyed, stored
from corpusflow.llm.words import Block, U, blocks

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Words hashed at a time, so that a long text needs no more memory.
_WORDS = 1 << 15


def fingerprint(raw: bytes, start: np.ndarray, end: np.ndarray) -> int:
    """SimHash of one text (A-Z folded) whose words are these byte ranges."""
    n = len(start)
    if not n:
        return 0
    k = min(SHINGLE, n)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n - k + 1, _WORDS):
        hi = min(lo + _WORDS + k - 1, n)  # the last word of the last shingle, plus one
        joined = b" ".join(raw[start[lo]: end[hi - 1]].split())
        at = np.cumsum(end[lo:hi] - start[lo:hi] + 1)
        first = np.append(0, at[:-1])[: hi - lo - k + 1].tolist()
        last = (at[k - 1:] - 1).tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first, last)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n - k + 1).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def block_fingerprints(block: Block) -> np.ndarray:
    raw = block.data.tobytes().lower()
    start, end = block.word_spans
    at = block.word_off
    return np.array([fingerprint(raw, start[a:b], end[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], dtype=U)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(block_fingerprints(block).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


#: Fingerprints with one segment value that are matched member by member.
DIRECT = 32
_BITS = [1 << i for i in range(32)]
_BALL1 = [0, *_BITS]
_BALL2 = [*_BALL1, *[_BITS[i] | _BITS[j] for i in range(32) for j in range(i)]]


def _within(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among ``distinct`` (rep, fp) with the components of all pairs
    within three bits; of fingerprints in small buckets, each such pair."""
    segment = F.array(
        F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.shiftrightunsigned("fp", 32).alias("other")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("other")))
    table = distinct.select("rep", "fp", F.inline(segment))
    probes = table.select("*", F.explode(F.lit(_BALL1)).alias("mask")).where(
        (F.col("mask") == 0) | (F.col("key").bitwiseAND(F.col("mask")) != 0)).select(
        F.col("rep").alias("p_rep"), F.col("fp").alias("p_fp"), "seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"),
        F.col("other").alias("p_other"), F.col("mask").alias("p_mask"))
    hot = stored(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DIRECT).select("seg", "key"), "simhash-hot")
    some = not hot.isEmpty()
    small = table.join(hot, ["seg", "key"], "left_anti") if some else table
    small = small.select("seg", "key", "rep", "fp")
    found = probes.join(small, (probes["seg"] == small["seg"]) & (probes["key"] == small["key"])
                        & ((F.col("p_mask") != 0) | (F.col("p_fp") < F.col("fp"))) & _within("p_fp", "fp"))
    found = found.select(F.col("p_rep").alias("a"), F.col("rep").alias("b"))
    if not some:
        return found
    members = table.join(hot, ["seg", "key"], "left_semi")
    near = probes.where("p_mask <> 0").join(hot, ["seg", "key"], "left_semi")

    def around(df: DataFrame, rep: str, other: str, ball: list[int]) -> DataFrame:
        return df.select("seg", "key", F.col(rep).alias("a"), F.col(other).alias("o"), F.explode(F.lit(ball)).alias("m")).select(
            "seg", "key", F.col("o").bitwiseXOR(F.col("m")).alias("z"), "a")

    hubs = around(members, "rep", "other", _BALL1).groupBy("seg", "key", "z").agg(F.min("a").alias("b"))
    rows = around(members, "rep", "other", _BALL2).unionByName(around(near, "p_rep", "p_other", _BALL1))
    starred = rows.join(hubs, ["seg", "key", "z"]).where("a <> b").select("a", "b").distinct()
    return found.unionByName(starred)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    keyed, key = row_keyed(docs.select(id_col, text_col), id_col)
    prints = stored(fingerprints(keyed, key, text_col), "simhash-fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = stored(components(links(distinct)), "simhash-roots")
    classes = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("class"))
    out = prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class").alias("component_id"))
    if key == id_col:
        return out
    names = keyed.select(F.col(key).alias("row"), F.col(id_col).alias("name"))
    named = out.join(names, F.col("doc_id") == F.col("row"))
    best = named.groupBy(F.col("component_id").alias("c")).agg(F.min("name").alias("least"))  # min() passes nulls over
    return named.join(best, F.col("component_id") == F.col("c")).select(
        F.col("name").alias("doc_id"), "fingerprint", F.col("least").alias("component_id"))
