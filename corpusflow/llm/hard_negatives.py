"""Hard negatives by anchor-clustered shared lists (operator 13, after MAXIMUS).

Vectors are scaled to integers; a row's score for an anchor is their integer
inner product.  The anchors are clustered by direction.  For a cluster with
centre u, whose members lie within the angle t of u, a row v at the angle p
from u scores at most |a| |v| cos(max(0, p - t)) with any member a.  Each task
sorts its rows by |v| cos(max(0, p - t)) once per cluster, and all members walk
that one list from the top, some rows at a time.  A member stops when the bound
of the next row is below all that it could still use: its k-th best so far, or
the least score that is allowed.  So every result is certified, whatever the
order of the rows; the best of earlier rows of the task count on.

Two such walks follow each other: the first finds an anchor's positives (best
rows of its own label), the second, for each anchor and positive, the best rows
of other labels whose scores lie in the window that the positive's score sets.
Each task sends its best of each, and Spark ranks those.  Anchors are taken in
blocks of about ``ANCHORS``, each two passes over the rows, so what is
collected and broadcast is bounded by the block.

Defined results: rows with a null identifier, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as ending in zeros;
components count as at most 2^40 in size, and sums are 64 bits; rows of equal
scores come by identifier, then by stored order; rows of repeated identifiers
stand for themselves; an anchor without positives, or a positive without
negatives, has no rows; an empty table gives an empty table; other columns
never matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusflow.llm.store import stored

SCALE = 256
#: Anchors of one pass, about.
ANCHORS = 4096
#: Rows of a list that its members take at a time.
_STEP = 512
_LARGEST = float(1 << 40)


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, row, label, vec): the rows that take part, scaled to integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(3)
            size = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            owner = np.repeat(np.arange(len(size)), size)
            fine = np.bincount(owner[~np.isfinite(x)], minlength=len(size)) == 0
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(SCALE * x)), -_LARGEST, _LARGEST).astype(np.int64)
            off = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(off, pa.array(whole))], ["vec_id", "row", "label", "vec"])
            yield out.filter(pa.array(fine))

    some = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return some.mapInArrow(run, "vec_id long, row long, label long, vec array<long>")


def matrix(vec: pa.ListArray) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    size = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = vec.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = x
    return out


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.hstack([x, np.zeros((len(x), d - x.shape[1]), dtype=x.dtype)])


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their integers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    if most < 2.0**53:
        return (rows.astype(np.float64) @ anchors.T.astype(np.float64)).astype(np.int64)
    return rows @ anchors.T


@dataclass
class Cluster:
    members: np.ndarray  # places of its anchors
    centre: np.ndarray   # unit direction, or zero
    angle: float         # no member lies farther from the centre


def clusters(anchors: np.ndarray, rounds: int = 8) -> list[Cluster]:
    """Anchors clustered by direction (spherical k-means, about the square root of
    their number, started from evenly spaced ones)."""
    n = len(anchors)
    size = np.linalg.norm(anchors.astype(np.float64), axis=1)
    unit = anchors / np.where(size > 0, size, 1)[:, None]
    k = math.isqrt(max(n - 1, 0)) + 1 if n else 0
    centre = unit[np.linspace(0, n - 1, k).astype(int)] if n else unit
    for _ in range(rounds if n else 0):
        own = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        length = np.linalg.norm(total, axis=1)
        centre = np.where(length[:, None] > 0, total / np.where(length > 0, length, 1)[:, None], centre)
    out = []
    for c in range(k):
        members = np.flatnonzero(own == c)
        if len(members):
            angle = float(np.arccos(np.clip(unit[members] @ centre[c], -1, 1)).max())
            # a zero anchor scores zero with all; any bound holds for it
            out.append(Cluster(members, centre[c], angle + 1e-7))
    return out


@dataclass
class Wants:
    """What is sought: for each slot the k best rows with a score in [low, high]
    for its anchor, of the anchor's label or of other labels."""

    anchors: np.ndarray
    rows: np.ndarray    # the anchors' own rows
    labels: np.ndarray  # the anchors' labels
    slot: np.ndarray    # the anchor of each slot
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool


class Best:
    """The best rows of each slot so far: parallel arrays, best first in a slot."""

    def __init__(self, wants: Wants):
        self.wants = wants
        self.slot = self.score = self.ident = self.row = np.zeros(0, dtype=np.int64)
        self.need = wants.low.copy()  # the least score that is of use to each slot

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        mine = np.isin(self.slot, slot)
        s, c, i, r = (np.concatenate([a[mine], b]) for a, b in
                      ((self.slot, slot), (self.score, score), (self.ident, ident), (self.row, row)))
        order = np.lexsort((r, i, -c, s))
        s, c, i, r = s[order], c[order], i[order], r[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        kth = place == self.wants.k - 1
        self.need[s[kth]] = np.maximum(self.need[s[kth]], c[kth])
        keep = place < self.wants.k
        self.slot, self.score, self.ident, self.row = (
            np.concatenate([a[~mine], b[keep]]) for a, b in ((self.slot, s), (self.score, c), (self.ident, i), (self.row, r)))


def walk(best: Best, found: list[Cluster], vec: np.ndarray, ident: np.ndarray, row: np.ndarray, label: np.ndarray) -> int:
    """Take these rows into ``best``; returns how many products were formed."""
    w, formed = best.wants, 0
    d = max(vec.shape[1], w.anchors.shape[1])
    vec, anchors = _wide(vec, d), _wide(w.anchors, d)
    length = np.linalg.norm(vec.astype(np.float64), axis=1)
    size = np.linalg.norm(anchors.astype(np.float64), axis=1)
    slots_of = np.argsort(w.slot, kind="stable")
    at = np.searchsorted(w.slot[slots_of], np.arange(len(anchors) + 1))
    for c in found:
        centre = np.append(c.centre, np.zeros(d - len(c.centre)))
        cos = np.divide(vec @ centre, length, out=np.zeros(len(vec)), where=length > 0)
        bound = length * np.cos(np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - c.angle))
        order = np.argsort(-bound, kind="stable")
        slots = np.concatenate([slots_of[at[m]: at[m + 1]] for m in c.members])
        slots = slots[w.low[slots] <= w.high[slots]]
        for lo in range(0, len(order), _STEP):
            # what the best row left can score with each slot's anchor
            top = size[w.slot[slots]] * bound[order[lo]]
            slots = slots[top + np.abs(top) * 1e-9 + 1e-3 >= best.need[slots]]
            if not len(slots):
                break
            some = order[lo: lo + _STEP]
            who, place = np.unique(w.slot[slots], return_inverse=True)
            score = _products(vec[some], anchors[who])
            formed += score.size
            alike = label[some][:, None] == w.labels[who]
            fits = alike & (row[some][:, None] != w.rows[who]) if w.same else ~alike
            mine = score[:, place]
            r, s = np.nonzero(fits[:, place] & (mine >= best.need[slots]) & (mine <= w.high[slots]))
            best.add(slots[s], mine[r, s], ident[some][r], row[some][r])
    return formed


def best_rows(vectors: DataFrame, wants: Wants) -> DataFrame:
    """(slot, score, vec_id, row): the best rows of each task for each slot."""
    # one block of anchors and the clusters they fall into
    sent = vectors.sparkSession.sparkContext.broadcast((wants, clusters(wants.anchors)))
    found = StructType.fromDDL("slot long, score long, vec_id long, row long")
    schema = to_arrow_schema(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wants_, parts = sent.value
        best = Best(wants_)
        for batch in batches:
            ident, row, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row", "label"))
            walk(best, parts, matrix(batch.column("vec")), ident, row, label)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.ident, best.row)], schema=schema)

    return vectors.mapInArrow(run, found)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ints(values) -> np.ndarray:
    return np.array(list(values), dtype=np.int64)


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low_pct: int = 30,
                   high_pct: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor (identifier divisible by ``anchor_every``) and each of its
    positives the best rows of other labels that score between ``low_pct`` and
    ``high_pct`` of the positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    vectors = stored(integer_vectors(rows, id_col, vec_col, label_col), "negatives-vectors")
    anchors = vectors.where(F.col("vec_id") % anchor_every == 0)
    n_blocks = max(1, math.ceil(anchors.count() / ANCHORS))
    found = []
    for b in range(n_blocks):
        some = anchors if n_blocks == 1 else anchors.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(n_blocks)) == b)
        found.append(_block(vectors, some, positives, negatives, low_pct, high_pct))
    return reduce(DataFrame.unionByName, found)


def _block(vectors: DataFrame, anchors: DataFrame, positives: int, negatives: int, low_pct: int, high_pct: int) -> DataFrame:
    spark = vectors.sparkSession
    asked = sorted(anchors.collect(), key=lambda r: (r.vec_id, r.row))  # one block
    vec = matrix(pa.array([r.vec for r in asked], pa.list_(pa.int64())))
    own, labels = _ints(r.row for r in asked), _ints(r.label for r in asked)
    n = len(asked)
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    wants = Wants(vec, own, labels, np.arange(n), np.full(n, least), np.full(n, most), positives, True)
    pairs = _first(best_rows(vectors, wants), positives).select("slot", "score", "vec_id", "row").collect()  # a few for each anchor
    pairs.sort(key=lambda r: (r.slot, -r.score, r.vec_id, r.row))
    low = _ints(-(-low_pct * r.score // 100) for r in pairs)
    high = _ints(high_pct * r.score // 100 for r in pairs)
    wants = Wants(vec, own, labels, _ints(r.slot for r in pairs), low, high, negatives, False)
    names = spark.createDataFrame(
        [(s, asked[r.slot].vec_id, r.vec_id, r.score) for s, r in enumerate(pairs)],
        "slot long, anchor_id long, positive_id long, positive_score long")
    out = _first(best_rows(vectors, wants), negatives)
    return out.join(names, "slot").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """The embeddings with the labels that the query mines: where the identifier is
    divisible by 7, the next of ten."""
    label = F.col("label").cast("long")
    return embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
