"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, as a URI."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[len("file:/"):].lstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: the lineage ends
    and a lost executor costs no earlier work.

    The shuffle files behind it are of no use then, and Spark is told to delete
    them as the write ends; by itself it would do so only once the driver happens
    to collect its garbage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart: the identifier itself,
    or, where identifiers are missing or repeat, a row number in a written copy."""
    odd = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if odd.isEmpty():
        return docs, id_col
    row = fresh(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: (node, root), root the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each is
    a minimum per node (combined before the shuffle) and a join, so a node with
    many links is never collected.  Stops when a round changes nothing.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
