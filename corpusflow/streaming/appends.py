"""Appending a batch once (K1, K3).

A streaming sink may be handed the same batch twice: the run died after the
rows were written and before the checkpoint said so.  Here each batch has a
folder of its own, which a repeated write replaces, and a manifest lists the
batches that are complete.  Readers take the batches of the manifest, so a
half-written one is not seen and a replayed one adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources.readers import path_exists


def committed(spark: SparkSession, table: str) -> DataFrame:
    """The identifiers of the complete batches of a table."""
    if not path_exists(spark, f"{table}/manifest"):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema("batch long").parquet(f"{table}/manifest").distinct()


def append_once(df: DataFrame, table: str, batch_id: int) -> bool:
    """K1: append ``df`` as the batch ``batch_id``; False if the table has it."""
    spark = df.sparkSession
    if not committed(spark, table).where(F.col("batch") == batch_id).isEmpty():
        return False
    df.write.mode("overwrite").parquet(f"{table}/data/batch={batch_id}")
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{table}/manifest")
    return True


def read_appended(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of the complete batches, without the batch number."""
    if not path_exists(spark, f"{table}/data/*"):
        return spark.createDataFrame([], schema)
    with_batch = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
    rows = spark.read.schema(with_batch).parquet(f"{table}/data")
    return rows.join(committed(spark, table), "batch", "left_semi").drop("batch")
