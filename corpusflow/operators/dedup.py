"""Near-duplicate removal: weighted trigram Jaccard, first-wins (D1..D4, J3, J4).

Semantics kept from the original: texts are scanned in order of first
appearance; a text is dropped when its weighted character-trigram Jaccard
with an earlier *kept* text is strictly above 4/5; afterwards every row
whose text is kept survives, so exact copies of a kept text all stay
(``mode='reference'``).  ``mode='strict'`` keeps one row per kept text.

The plan:

1. Distinct texts with ``rk`` = first appearance (``min(ord)``).  A group of
   exact copies collapses in the map-side partial aggregate, so a text
   copied a billion times costs one row per input partition.
2. Tokens: the trigram multiset becomes a set by numbering repeats; weighted
   Jaccard equals set Jaccard on tokens.  A task computes the tokens of its
   texts with numpy; no token ever becomes a row.
3. Candidates: a text becomes one row with a parity sketch of its tokens
   (:func:`corpusflow.functions.grams.parity_sketch`).  Two sketches differ in at
   most as many bits as the token sets in tokens, and similar texts differ in
   fewer than a ninth of their tokens, so no similar pair is lost; unlike texts
   differ in far more.  Trigrams are few, so two texts of one language share some
   token of any prefix: rows per token, and the pairs they make, grow far faster
   than the sketches.  Texts are dealt over tiles by length; a task compares two
   tiles whose lengths fit (:func:`close_pairs`) and returns close pairs only.
   The comparisons, a few nanoseconds each, grow as the square of the texts of
   like length; the rows that move grow as the texts, times the tiles they meet.
4. A second bound before texts move: a histogram of a text's trigrams over 256
   hashed buckets; two texts share at most the sum of the smaller counts.  Only
   pairs whose bound reaches the threshold fetch their texts.
5. Exact verification on packed trigrams.
6. Resolution: lexicographically-first maximal independent set, in rounds: a
   text with no undecided earlier neighbour is kept, its later neighbours are
   dropped.  Decisions are appended to a table in the shared folder; rounds go
   on until every text is decided.

The rows per prefix token (:func:`prefix_rows`) and their refinement remain as
helpers for few texts; the scans do not need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.grams import (
    close_sketches, common_counts, gram_counts, gram_histogram, histograms, packed_grams, parity_sketch, part_names, sketch_words,
    token_names,
)
from corpusflow.functions.text import char_ngrams
from corpusflow.session import ensure_checkpoint_dir, scratch_path, written

# ---------------------------------------------------------------------------
# threshold helpers (integer form, no float or decimal literal differences)
# ---------------------------------------------------------------------------

def similar(inter: Column, sz_a: Column, sz_b: Column) -> Column:
    """``inter / (sz_a + sz_b - inter) > 4/5`` written as integers."""
    union = sz_a + sz_b - inter
    return (F.lit(K.JACCARD_DEN) * inter) > (F.lit(K.JACCARD_NUM) * union)


def prefix_len(sz: Column) -> Column:
    """Tokens a text of ``sz`` tokens must contribute to the candidate join."""
    return sz - F.floor(sz * K.JACCARD_NUM / K.JACCARD_DEN).cast("long")


def length_ok(sz_a: Column, sz_b: Column) -> Column:
    lo, hi = F.least(sz_a, sz_b), F.greatest(sz_a, sz_b)
    return F.lit(K.JACCARD_DEN) * lo > F.lit(K.JACCARD_NUM) * hi


# ---------------------------------------------------------------------------
# D1 as a column expression (for small inputs and tests)
# ---------------------------------------------------------------------------

def trigram_tokens(x) -> Column:
    """Tokens ``gram + k`` of one text (k numbers repeats of a gram).

    A sorted array gives each repeat its index; the first position is found
    with ``array_position``.  Fine for single pairs; the distributed path in
    :func:`near_dup_pairs` numbers repeats with a window instead.
    """
    s = F.array_sort(char_ngrams(x))
    return F.transform(
        s, lambda e, i: F.concat(e, (i + 2 - F.array_position(s, e)).cast("string"))
    )


def trigram_jaccard(a, b) -> Column:
    """Weighted trigram Jaccard of two texts; 0.0 if either has < 3 chars."""
    ta, tb = trigram_tokens(a), trigram_tokens(b)
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(ta) + F.size(tb) - inter
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(inter / union)


# ---------------------------------------------------------------------------
# distributed pieces
# ---------------------------------------------------------------------------

def distinct_texts(df: DataFrame, text_col: str = "text", ord_col: str = "ord") -> DataFrame:
    """U3 + W2: one row per distinct text, ``rk`` = order of first appearance."""
    return df.groupBy(F.col(text_col).alias("text")).agg(
        F.min(ord_col).alias("rk"), F.count(F.lit(1)).alias("n_rows")
    )


def gram_sizes(texts: DataFrame) -> DataFrame:
    """C8 counted: ``(rk, n_grams, n_distinct)`` of every text, without a list of
    trigrams as a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [gram_counts(packed_grams(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, _, n in counts], pa.int32()), pa.array([len(g) for g, _, _ in counts], pa.int32())],
                ["rk", "n_grams", "n_distinct"])

    low = _lowered(texts)
    return low.mapInArrow(run, f"rk {low.schema['rk'].dataType.simpleString()}, n_grams int, n_distinct int")


#: Buckets of the document-frequency table: a fixed size, whatever the input.
DF_BITS = 18


def _lowered(texts: DataFrame) -> DataFrame:
    return texts.select("rk", F.lower("text").alias("low"))


def token_frequency(low: DataFrame) -> np.ndarray:
    """Texts per hashed token bucket, counted over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (token_names(packed_grams(text.as_py())) >> np.uint64(64 - DF_BITS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(1 << DF_BITS, dtype=np.int64)
    rows = low.select("low").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most 2^DF_BITS rows
        out[r.bucket] = r.n
    return out


def prefix_rows(low: DataFrame) -> DataFrame:
    """``(rk, sz, band, up, tok, p)``: the prefix tokens of every text, once in
    its own length band and once (``up``) in the next longer one."""
    sent = low.sparkSession.sparkContext.broadcast(token_frequency(low))  # a fixed table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = sent.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for rk, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tok = token_names(packed_grams(text.as_py()))
                sz = len(tok)
                n = sz - K.JACCARD_NUM * sz // K.JACCARD_DEN
                if not n:
                    continue
                order = np.lexsort((tok, freq[(tok >> np.uint64(64 - DF_BITS)).astype(np.int64)]))[:n]
                band = int(np.floor(np.log(sz) / np.log(K.JACCARD_DEN / K.JACCARD_NUM)))
                for up in (False, True):
                    for col, x in zip(cols, (np.full(n, rk), np.full(n, sz), np.full(n, band + up), np.full(n, up),
                                             tok[order].view(np.int64), np.arange(1, n + 1))):
                        col.append(x)
            if cols[0]:
                yield _prefix_batch(cols)

    return low.select("rk", "low").mapInArrow(run, "rk long, sz long, band int, up boolean, tok long, p long")


def _candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs ``rk_a < rk_b`` of two sets of prefix rows that can be similar."""
    a = first.select(*[F.col(c).alias(f"{c}_a") for c in ("rk", "sz", "band", "up", "tok", "p")])
    b = second.select(*[F.col(c).alias(f"{c}_b") for c in ("rk", "sz", "band", "up", "tok", "p")])
    room = 1 + F.least(F.col("sz_a") - F.col("p_a"), F.col("sz_b") - F.col("p_b"))
    need = (K.JACCARD_DEN + K.JACCARD_NUM) * room > K.JACCARD_NUM * (F.col("sz_a") + F.col("sz_b"))
    on = (
        (F.col("band_a") == F.col("band_b")) & (F.col("tok_a") == F.col("tok_b")) & (F.col("rk_a") < F.col("rk_b"))
        & ~(F.col("up_a") & F.col("up_b")) & length_ok(F.col("sz_a"), F.col("sz_b")) & need
    )
    return a.join(b, on).select("rk_a", "rk_b").distinct()


def gram_histograms(low: DataFrame) -> DataFrame:
    """``(rk, low, hist)``: the texts with their gram histograms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gram_histogram(packed_grams(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], ["rk", "low", "hist"])

    return low.select("rk", "low").mapInArrow(run, "rk long, low string, hist binary")


# rows whose histograms are held as numbers at a time
_BOUND_ROWS = 4096


def possible(pairs: DataFrame, hist: DataFrame) -> DataFrame:
    """The pairs whose histograms leave room for the threshold: the texts share at
    most the sum of the smaller counts, so no similar pair is lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _BOUND_ROWS):
                some = batch.slice(lo, _BOUND_ROWS)
                a, b = (histograms(some.column(c).to_pylist()) for c in ("hist_a", "hist_b"))
                most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                total = a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
                fits = (K.JACCARD_DEN + K.JACCARD_NUM) * most > K.JACCARD_NUM * total
                yield some.select(["rk_a", "rk_b"]).filter(pa.array(fits))

    ha = hist.select(F.col("rk").alias("rk_a"), F.col("hist").alias("hist_a"))
    hb = hist.select(F.col("rk").alias("rk_b"), F.col("hist").alias("hist_b"))
    return pairs.join(ha, "rk_a").join(hb, "rk_b").select("rk_a", "rk_b", "hist_a", "hist_b").mapInArrow(run, "rk_a long, rk_b long")


def _verified(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """The pairs above the threshold: ``rk_a, rk_b, inter, sz_a, sz_b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}  # of this batch: a text is in many pairs

            def counted(text: pa.Scalar) -> tuple[np.ndarray, np.ndarray, int]:
                text = text.as_py()
                if text not in counts:
                    counts[text] = gram_counts(packed_grams(text))
                return counts[text]

            keep, inter, sa, sb = [], [], [], []
            for k, (ta, tb) in enumerate(zip(batch.column("low_a"), batch.column("low_b"))):
                x, y = counted(ta), counted(tb)
                n = common_counts(x, y)
                if (K.JACCARD_DEN + K.JACCARD_NUM) * n > K.JACCARD_NUM * (x[2] + y[2]):
                    keep.append(k)
                    inter.append(n)
                    sa.append(x[2])
                    sb.append(y[2])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk_a").take(at), batch.column("rk_b").take(at), *[pa.array(c, pa.int64()) for c in (inter, sa, sb)]],
                ["rk_a", "rk_b", "inter", "sz_a", "sz_b"])

    ta = low.select(F.col("rk").alias("rk_a"), F.col("low").alias("low_a"))
    tb = low.select(F.col("rk").alias("rk_b"), F.col("low").alias("low_b"))
    both = pairs.join(ta, "rk_a").join(tb, "rk_b").select("rk_a", "rk_b", "low_a", "low_b")
    return both.mapInArrow(run, "rk_a long, rk_b long, inter long, sz_a long, sz_b long")


#: Length classes in a factor of 5/4: a text can be similar to texts of its own
#: class and of as many on either side.
CLASSES = 4
#: Texts of a tile, and bytes of their sketches.
TILE_ROWS, TILE_BYTES = 1 << 14, 1 << 26


def sketch_bits(cls: int) -> int:
    """Width of the sketches of a length class: 1.2 bits a token at least."""
    tokens = (K.JACCARD_DEN / K.JACCARD_NUM) ** ((cls + 1) / CLASSES)
    return max(64, 1 << int(np.ceil(np.log2(1.2 * tokens))))


def sketch_rows(low: DataFrame) -> DataFrame:
    """``(rk, low, hist, sz, cls, sketch)``: the texts with at least one token and
    their histograms and sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hist, sizes, classes, sketches = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                grams = packed_grams(text.as_py())
                if not len(grams):
                    continue
                cls = int(np.floor(np.log(len(grams)) / np.log(K.JACCARD_DEN / K.JACCARD_NUM) * CLASSES))
                at.append(k)
                hist.append(gram_histogram(grams))
                sizes.append(len(grams))
                classes.append(cls)
                sketches.append(parity_sketch(token_names(grams), sketch_bits(cls)))
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(hist, pa.binary()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int32()),
                 pa.array(sketches, pa.binary())], ["rk", "low", "hist", "sz", "cls", "sketch"])

    return low.select("rk", "low").mapInArrow(run, "rk long, low string, hist binary, sz long, cls int, sketch binary")


def tile_parts(sizes: dict[int, int]) -> dict[int, int]:
    """Tiles of each length class that holds texts."""
    return {c: -(-n // max(1, min(TILE_ROWS, TILE_BYTES * 8 // sketch_bits(c)))) for c, n in sizes.items() if n}


def close_pairs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs ``rk_a < rk_b`` of :func:`sketch_rows` that can be similar.

    The classes are cut into tiles of a bounded size.  A text is sent to its own
    tile and to the tiles of the classes it can be similar to, once each; two
    tiles meet in one task.  With ``most``, a text's first ``most`` partners
    (``rk_a``) in every two tiles stay, and a row with a null ``rk_a`` says that it
    has more.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("rk").isNotNull())
    sizes = {r.cls: r.n for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # some dozens
    parts = tile_parts(sizes)
    order = sorted(parts)
    first = {c: sum(parts[x] for x in order if x < c) for c in order}
    met = {c: [x for x in order if abs(x - c) <= CLASSES] for c in order}
    tiles = spark.createDataFrame(
        [(c, parts[c], first[c], first[met[c][0]], first[met[c][-1]] + parts[met[c][-1]] - 1) for c in order],
        "cls int, parts long, first long, lo long, hi long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rk")
        tile = table.column("tile").to_numpy()
        words = min(map(len, table.column("sketch").to_pylist())) // 8
        sides = []
        for t in sorted(set(tile.tolist())):
            side = table.filter(pa.array(tile == t))
            sides.append((side.column("rk").to_numpy(), side.column("sz").to_numpy(), sketch_words(side.column("sketch").to_pylist(), words)))
        both = [(sides[0], sides[-1]), (sides[1], sides[0])] if len(sides) == 2 else [(sides[0], sides[0])]
        if table.column("t_lo")[0].as_py() != table.column("t_hi")[0].as_py() and len(sides) == 1:
            both = []  # the other tile is empty
        found = [close_sketches(a, b, K.JACCARD_NUM, K.JACCARD_DEN, most) for a, b in both]
        first_ = [pa.array(x[0], pa.int64()) for x in found] + [pa.nulls(len(x[2]), pa.int64()) for x in found]
        second = [pa.array(x[1], pa.int64()) for x in found] + [pa.array(x[2], pa.int64()) for x in found]
        return pa.table({"rk_a": pa.chunked_array(first_, pa.int64()), "rk_b": pa.chunked_array(second, pa.int64())})

    placed = rows.select("rk", "sz", "cls", "sketch").join(F.broadcast(tiles), "cls")
    placed = placed.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("rk"), F.col("parts")))
    sent = placed.select("rk", "sz", "sketch", "tile", F.explode(F.sequence("lo", "hi")).alias("_t")).select(
        "rk", "sz", "sketch", "tile", F.least("tile", "_t").alias("t_lo"), F.greatest("tile", "_t").alias("t_hi"))
    return sent.groupBy("t_lo", "t_hi").applyInArrow(run, "rk_a long, rk_b long")


def later_pairs(rows: DataFrame, after: DataFrame, most: int) -> DataFrame:
    """As :func:`close_pairs` for the texts of ``after`` (rk, after) alone: their
    first ``most`` partners in ``rows`` beyond the key ``after``.

    Both sides have tiles of their own, so few texts that go on cost few tiles.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("rk").isNotNull()).select("rk", "sz", "cls", "sketch").join(after.select("rk", "after"), "rk", "left")
    sizes = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count("after").alias("m")).collect()  # some dozens
    parts = [tile_parts({r.cls: r.n for r in sizes}), tile_parts({r.cls: r.m for r in sizes})]
    first = [{c: sum(n for x, n in side.items() if x < c) for c in side} for side in parts]

    def placed(some: DataFrame, side: int, own: str, met: str) -> DataFrame:
        """The texts of a side, once for each tile of the other side that they meet."""
        tiles, other = [], 1 - side
        for c, n in parts[side].items():
            near = [x for x in parts[other] if abs(x - c) <= CLASSES]
            if near:
                tiles.append((c, n, first[side][c], min(first[other][x] for x in near), max(first[other][x] + parts[other][x] for x in near) - 1))
        tiles = spark.createDataFrame(tiles, "cls int, parts long, first long, lo long, hi long")
        return some.join(F.broadcast(tiles), "cls").select(
            "rk", "sz", "sketch", "after", (F.col("first") + F.pmod(F.xxhash64("rk"), F.col("parts"))).alias(own),
            F.explode(F.sequence("lo", "hi")).alias(met))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rk")
        words = min(map(len, table.column("sketch").to_pylist())) // 8
        is_b = table.column("after").is_valid().to_numpy()
        a, b = ((side.column("rk").to_numpy(), side.column("sz").to_numpy(), sketch_words(side.column("sketch").to_pylist(), words))
                if side.num_rows else None for side in (table.filter(pa.array(~is_b)), table.filter(pa.array(is_b))))
        none = np.zeros(0, dtype=np.int64)
        x, y, more = (none, none, none) if a is None or b is None else close_sketches(
            a, b, K.JACCARD_NUM, K.JACCARD_DEN, most, table.filter(pa.array(is_b)).column("after").to_numpy())
        return pa.table({"rk_a": pa.chunked_array([pa.array(x, pa.int64()), pa.nulls(len(more), pa.int64())]),
                         "rk_b": pa.chunked_array([pa.array(y, pa.int64()), pa.array(more, pa.int64())])})

    sent = placed(rows.withColumn("after", F.lit(None).cast("long")), 0, "t_a", "t_b").unionByName(
        placed(rows.where(F.col("after").isNotNull()), 1, "t_b", "t_a"))
    return sent.groupBy("t_a", "t_b").applyInArrow(run, "rk_a long, rk_b long")


def near_dup_pairs(texts: DataFrame) -> DataFrame:
    """J3 + D2: all pairs ``rk_a < rk_b`` of distinct texts with Jaccard > 4/5.

    ``texts`` has columns ``rk`` (unique long) and ``text``.
    Returns ``rk_a, rk_b, inter, sz_a, sz_b``.
    """
    low = written(sketch_rows(_lowered(texts)), "similar-texts")
    pairs = written(close_pairs(low).distinct(), "similar-pairs")
    return written(_verified(possible(pairs, low), low), "similar")


def refined_rows(low: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """Rows ``(rk, sz, band, up, tok, p)`` that put the texts of large groups into
    smaller ones, so that similar texts still meet.

    Two similar texts of one length band differ in fewer than ``n`` tokens, with
    ``n`` a ninth of the two largest sizes of the band together.  Dealt over ``n``
    hashed parts, their tokens are the same in one part at least, so a text joins
    the groups of its subsets in all parts.  Unlike texts agree in few parts.
    ``members`` has rk, band, up and key (what the texts have shared so far).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("rk", "band", "up", "key")), batch.column("low"))
            for rk, band, up, key, text in rows:
                tok = token_names(packed_grams(text.as_py()))
                largest = int((K.JACCARD_DEN / K.JACCARD_NUM) ** (band + 1)) + 1
                n = 2 * largest // (K.JACCARD_DEN + K.JACCARD_NUM) + 1
                name = part_names(tok, n, level)
                name = token_names(name.view(np.int64) ^ (np.arange(n) * 0x2545F4914F6CDD1D) ^ np.int64(key))
                for col, x in zip(cols, (np.full(n, rk), np.full(n, len(tok)), np.full(n, band), np.full(n, up), name.view(np.int64), np.ones(n))):
                    col.append(x)
                if sum(map(len, cols[0])) > 200_000:
                    yield _prefix_batch(cols)
                    cols = [[] for _ in range(6)]
            if cols[0]:
                yield _prefix_batch(cols)

    return members.join(low.select("rk", "low"), "rk").mapInArrow(run, "rk long, sz long, band int, up boolean, tok long, p long")


def _prefix_batch(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c), t) for c, t in zip(cols, types)], ["rk", "sz", "band", "up", "tok", "p"])


# earlier texts each text is compared with per round
FANOUT = 1000
# and in the first round, which takes the near-copies out of large groups
SWEEP = 16


# rows of one group a single task ranks when picking its first members
SALT_ROWS = 100_000


def first_members(rows: DataFrame, n: int, group=("band", "tok"), order: str = "rk",
                  rows_per_task: int = SALT_ROWS) -> DataFrame:
    """The ``n`` smallest ``order`` values of every group, without sending a
    hot group to one task.

    Group sizes come from a partial aggregate; a group of ``m`` rows is cut
    into ``ceil(m / rows_per_task)`` salted slices, each slice keeps its first
    ``n`` rows, and the group's first ``n`` are taken from those survivors.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("_m") / rows_per_task)).cast("long")
    salted = rows.join(sizes, list(group)).withColumn("_salt", F.pmod(F.xxhash64(order), salts))
    salted = salted.repartition(*group, "_salt")
    w1 = Window.partitionBy(*group, "_salt").orderBy(order)
    firsts = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*group).orderBy(order)
    firsts = firsts.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n)
    return firsts.drop("_m", "_salt", "_r")


def first_wins_bounded(texts: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """D3 without all pairs of a hot group: the ``rk`` values a first-wins scan drops.

    Per round, a text is compared with its next partners: the first texts before it
    whose sketches are close to its own, ``SWEEP`` in the first round, which takes
    the clusters of near-copies out for a few comparisons each, four times as many
    in every further one, up to ``fanout``.  A text with more of them notes how far
    it got and goes on from there in the next round, among all texts that are not
    dropped: kept ones count like undecided ones.  A text without further partners
    is complete.  Only complete texts are kept (when every earlier neighbour is
    dropped); any text similar to a kept text is dropped.  Found neighbours that are
    undecided stay on the list from round to round; a text with more than ``fanout``
    of them waits.  The smallest undecided text has none, so it always goes on.
    """
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    low = written(sketch_rows(_lowered(texts)), "first-wins-texts")
    und = written(low.select("rk").where(F.col("rk").isNotNull()).distinct(), "first-wins-open")
    decided = scratch_path(spark, "first-wins")
    left, most, todo, known = und.count(), min(SWEEP, fanout), None, None
    if not left:
        return und.select("rk")
    while left:
        if todo is None:
            close, waiting = close_pairs(low, most), None
        else:
            done = spark.read.parquet(decided)
            crowded = known.groupBy("b").count().where(F.col("count") > fanout).select(F.col("b").alias("rk"))
            waiting = todo.join(crowded, "rk", "left_semi")
            close = later_pairs(low.join(done.where(~F.col("kept")), "rk", "left_anti"), todo.join(crowded, "rk", "left_anti"), most)
        close = written(close.distinct(), "first-wins-pairs")
        # of a text's partners in all tiles the first ones
        pairs = first_members(close.where(F.col("rk_a").isNotNull()), most, group=("rk_b",), order="rk_a")
        cut = close.groupBy("rk_b").agg(F.count("rk_a").alias("n"), F.count(F.lit(1)).alias("m")).where((F.col("n") > most) | (F.col("m") > F.col("n")))
        going = cut.select("rk_b") if waiting is None else cut.select("rk_b").unionByName(waiting.select(F.col("rk").alias("rk_b")))
        complete = written(und.join(going.withColumnRenamed("rk_b", "rk"), "rk", "left_anti"), "first-wins-complete")
        edges = _verified(possible(pairs.select("rk_a", "rk_b"), low), low).select(F.col("rk_a").alias("a"), F.col("rk_b").alias("b"))
        edges = written(edges, "first-wins-edges")
        if known is not None:
            # neighbours kept in an earlier round
            kept = done.where("kept").select(F.col("rk").alias("a"))
            hit = written(edges.join(kept, "a", "left_semi").select(F.col("b").alias("rk"), F.lit(False).alias("kept")).distinct(), "first-wins-new")
            hit.write.mode("append").parquet(decided)
            complete = complete.join(hit, "rk", "left_anti")
            edges = written(_undecided(edges.unionByName(known), spark.read.parquet(decided)), "first-wins-edges")
        _resolve_round(edges, complete, decided)
        done = spark.read.parquet(decided)
        und = written(und.join(done, "rk", "left_anti"), "first-wins-open")
        left = und.count()
        if left:
            todo = pairs.join(cut.select("rk_b"), "rk_b", "left_semi").groupBy(F.col("rk_b").alias("rk")).agg(F.max("rk_a").alias("after"))
            todo = written((todo if waiting is None else todo.unionByName(waiting)).join(und, "rk", "left_semi"), "first-wins-todo")
            known = written(_undecided(edges, done), "first-wins-edges")
            if todo.isEmpty():
                raise RuntimeError("a round of the first-wins scan decided nothing")
        most = min(4 * most, fanout)
    return spark.read.parquet(decided).where(~F.col("kept")).select("rk")


def _undecided(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """The edges ``(a, b)`` between two undecided texts."""
    return edges.join(decided.select(F.col("rk").alias("a")), "a", "left_anti").join(decided.select(F.col("rk").alias("b")), "b", "left_anti")


def _resolve_round(edges: DataFrame, complete: DataFrame, decided: str) -> None:
    """Keep complete texts whose earlier neighbours are all dropped and drop
    the later neighbours of kept texts, until nothing changes.  Each step
    appends what it decides, ``(rk, kept)``, to the table ``decided``."""
    live, open_ = edges, complete
    while True:
        blocked = live.select(F.col("b").alias("rk")).distinct()
        kept = written(open_.join(blocked, "rk", "left_anti"), "first-wins-kept")
        if kept.isEmpty():
            return
        dropped = live.join(kept.withColumnRenamed("rk", "a"), "a").select(F.col("b").alias("rk")).distinct()
        new = written(kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False))), "first-wins-new")
        new.write.mode("append").parquet(decided)
        gone = new.select("rk")
        open_ = written(open_.join(gone, "rk", "left_anti"), "first-wins-complete")
        # edges out of kept or dropped texts no longer block anyone
        live = written(live.join(gone.withColumnRenamed("rk", "a"), "a", "left_anti")
                       .join(gone.withColumnRenamed("rk", "b"), "b", "left_anti"), "first-wins-edges")


def kept_texts(df: DataFrame, text_col: str = "text", ord_col: str = "ord", fanout: int = FANOUT) -> DataFrame:
    """Distinct texts that survive first-wins, with ``rk`` and ``n_rows``."""
    texts = written(distinct_texts(df, text_col, ord_col), "distinct-texts")
    dropped = first_wins_bounded(texts, fanout=fanout)
    return texts.join(dropped, "rk", "left_anti")


def dedup(df: DataFrame, text_col: str = "text", ord_col: str = "ord", mode: str = "reference",
          fanout: int = FANOUT) -> DataFrame:
    """D3 + J4.  ``reference``: every row whose text is kept; ``strict``: the
    first row of each kept text."""
    kept = kept_texts(df, text_col, ord_col, fanout)
    if mode == "reference":
        return df.join(kept.select(F.col("text").alias(text_col)), text_col, "left_semi")
    if mode == "strict":
        return df.join(kept.select(F.col("text").alias(text_col), F.col("rk").alias(ord_col)), [text_col, ord_col], "left_semi")
    raise ValueError(f"unknown mode {mode!r}")


def id_first_wins(df: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """The first row (by ``ord``) of every id.

    ``row_number() = 1`` lets Spark add a group limit before the exchange, so
    an id holding a third of all rows sends one row per task (a ``min_by`` over
    a struct would plan as a sort of whole rows).
    """
    w = Window.partitionBy(id_col).orderBy(ord_col)
    return df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")
