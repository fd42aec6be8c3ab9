"""Stage counts (A1, A3) and counts of identifiers over runs (A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """A1: ``(stage, n)`` for named frames; each count is one aggregate job
    planned together as a union of single-row aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_by(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A3: rows per value of a column (e.g. examples per split)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def observed(df: DataFrame, when: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with its row count (of the rows ``when`` holds for) as a by-product:
    the observation is complete when an action has run over the frame, and no
    scan or aggregate is planned for it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1) if when is None else F.when(when, 1)).alias("n")), seen


# the sketch's relative standard error is 1.04 / sqrt(2^SKETCH_BITS)
SKETCH_BITS = 14


def id_sketch(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A2 over runs: one row, the sketch of a run's identifiers.  Its size is fixed
    (2^SKETCH_BITS bytes at most), whatever their number."""
    return df.agg(F.hll_sketch_agg(F.col(id_col), SKETCH_BITS).alias("sketch"))


def united_count(sketches: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """``(by, estimate)``: distinct identifiers of the runs up to each run, from the
    runs' sketches alone (one row per run)."""
    upto = sketches.select(F.col(by).alias("_upto")).distinct()
    return upto.join(sketches, F.col(by) <= F.col("_upto")).groupBy(F.col("_upto").alias(by)).agg(
        F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias("estimate"))
