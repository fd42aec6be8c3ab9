"""Seeded shuffle and train/validation split (L2, L3).

``seeded_order`` gives every example a draw ``u`` from its key.  The exact
split puts the first ``floor(n * 95 / 100)`` examples in ``u`` order into
train, like cutting a shuffled list.  Global positions are computed without
a single-task sort: ``u`` is uniform, so ``floor(u * B)`` cuts the rows into
``B`` buckets of similar size; the running totals of the buckets' counts give
their offsets, and a window inside each bucket numbers its rows.  Buckets are a
pure function of the key, so a re-run after an executor loss computes the
same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.rand import seeded_bits
from corpusflow.operators.prefix import running_before
from corpusflow.session import materialize

# rows per bucket the exact split aims for: a task numbers one bucket at a time
ROWS_PER_BUCKET = 20_000


def seeded_order(df: DataFrame, key: Column, seed: int = K.SEED, stream: str = "shuffle") -> DataFrame:
    """L2: adds ``u`` (32-bit draw) and ``skey`` (tie-breaker) for ordering."""
    return df.withColumn("u", seeded_bits(seed, stream, key)).withColumn("skey", key.cast("string"))


def global_position(df: DataFrame, n: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``pos`` = 0-based rank by ``(u, skey)`` (from :func:`seeded_order`)."""
    if n is None:
        n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    b = F.floor(F.col("u") * buckets / F.lit(1 << 32)).cast("int")
    with_b = df.withColumn("_b", b)
    counts = with_b.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    counts = running_before(counts, "_b", "_cnt", "_off", 0, buckets - 1).drop("_cnt")
    w = Window.partitionBy("_b").orderBy("u", "skey")
    out = with_b.join(counts, "_b")
    return out.withColumn("pos", F.col("_off") + F.row_number().over(w) - 1).drop("_b", "_off")


def train_rows(n: int, train_percent: int = K.TRAIN_PERCENT) -> int:
    """L3: how many of ``n`` examples go to train."""
    return (n * train_percent) // 100


def split_of(pos: Column, train: int) -> Column:
    """L3: the side of an example by its position."""
    return F.when(pos < train, F.lit("train")).otherwise(F.lit("val"))


def split_exact(df: DataFrame, key: Column, seed: int = K.SEED, train_percent: int = K.TRAIN_PERCENT) -> DataFrame:
    """L3 (exact): ``split`` = train for the first ``floor(n*p/100)`` rows in
    seeded order, else val.  Adds ``pos`` and ``split``."""
    # read three times below (count, bucket counts, numbering): materialise once
    ordered = materialize(seeded_order(df, key, seed))
    n = ordered.count()
    return global_position(ordered, n).withColumn("split", split_of(F.col("pos"), train_rows(n, train_percent)))


def split_hash(df: DataFrame, key: Column, seed: int = K.SEED, train_percent: int = K.TRAIN_PERCENT) -> DataFrame:
    """L3 (scalable): train when the draw is below the fraction; a pure map."""
    u = seeded_bits(seed, "split", key)
    return df.withColumn(
        "split", F.when(u * 100 < F.lit(train_percent) * F.lit(1 << 32), F.lit("train")).otherwise(F.lit("val"))
    )


def split_grouped(df: DataFrame, group_key: Column, seed: int = K.SEED, train_percent: int = K.TRAIN_PERCENT) -> DataFrame:
    """L3 by group: every row of a group (e.g. the same text) lands on the same
    side, so exact copies cannot leak from train into validation.  The draw
    depends on the group key alone, so a hot group needs no shuffle."""
    return split_hash(df, group_key, seed, train_percent)
