"""Running totals without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order values of one window.
FAN = 1 << 14


def running_before(df: DataFrame, order: str, value, name: str = "before", lo: int | None = None, hi: int | None = None,
                   fan: int = FAN) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows with a smaller ``order``.

    ``order`` is a long without repeats, from ``lo`` to ``hi`` (found if not
    given).  Its range is cut into groups of ``fan`` values; the groups' sums are
    totalled in the same way, level by level, so no window ever holds more than
    ``fan`` rows.
    """
    if lo is None or hi is None:
        lo, hi = df.agg(F.min(order), F.max(order)).first()
    value = F.col(value) if isinstance(value, str) else value
    if lo is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    placed = df.withColumns({"_o": F.col(order).cast("long") - F.lit(lo), "_v": value.cast("long")})
    return _level(placed, name, hi - lo, fan).drop("_o", "_v")


def _level(df: DataFrame, name: str, span: int, fan: int) -> DataFrame:
    group = F.floor(F.col("_o") / fan).cast("long")
    inside = Window.partitionBy("_g").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    grouped = df.withColumn("_g", group)
    own = F.coalesce(F.sum("_v").over(inside), F.lit(0))
    if span < fan:
        return grouped.withColumn(name, own).drop("_g")
    sums = grouped.groupBy("_g").agg(F.sum("_v").alias("_v")).withColumnRenamed("_g", "_o")
    above = _level(sums, "_before", span // fan, fan).select(F.col("_o").alias("_g"), F.col("_before").alias("_above"))
    return grouped.withColumn("_own", own).join(above, "_g").withColumn(name, F.col("_own") + F.col("_above")).drop("_g", "_own", "_above")
