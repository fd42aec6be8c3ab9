"""Readers for landed JSONL files (S1..S4) and the quarantine split.

Order matters downstream (first-wins rules), but Spark files have none, so
every row gets ``ord``.  The scan itself yields each line's place: a task sees
the lines of a split in order, so the split's start offset plus the bytes of
the lines read from it so far orders all lines of a file, in one scan without
a shuffle (``order="offset"``).  ``order="line"`` numbers the lines densely
instead, which takes one small aggregate (lines per split) more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import schemas as S

#: ``ord`` = ``file_ord * 2^LINE_BITS + line``; by offset, ``2^OFFSET_BITS``.
LINE_BITS = 40
OFFSET_BITS = 50
#: A compressed file is one split; its text may be this many times as long.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")
EXPANSION = 1024


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, block, row, place)``: every line that is not blank, the split
    it was read from, its number among those there and its place in the file.

    ``place`` grows from line to line of a file: the start of the split (and one
    more, unless it starts the file: the rest of the line before is skipped
    there) plus the bytes of the lines already read from the split, each with
    its line feed.  It is at most the true offset, which lies before the next
    split's places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, rows, size = None, 0, 0  # the split at hand, its lines and bytes so far
        for batch in batches:
            if not batch.num_rows:
                continue
            value, file, block = batch.columns
            start = block.to_numpy(zero_copy_only=False)
            code = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.append(True, (start[1:] != start[:-1]) | (code[1:] != code[:-1]))
            first = np.flatnonzero(new)
            length = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            before = np.cumsum(length) - length
            run_of = np.cumsum(new) - 1
            solid = pc.match_substring_regex(value, r"[^\x00-\x20]")
            counted = solid.to_numpy(zero_copy_only=False).astype(np.int64)
            ahead = np.cumsum(counted) - counted
            row = ahead - ahead[first][run_of]
            byte = before - before[first][run_of]
            if split == (file[0].as_py(), start[0]):
                row[run_of == 0] += rows
                byte[run_of == 0] += size
            split, rows, size = (file[-1].as_py(), start[-1]), int(row[-1] + counted[-1]), int(byte[-1] + length[-1])
            yield pa.RecordBatch.from_arrays(
                [value, file, block, pa.array(row, pa.int64()), pa.array(start + (start > 0) + byte, pa.int64())],
                ["value", "file", "block", "row", "place"]).filter(solid)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.mapInArrow(run, "value string, file string, block long, row long, place long")


def file_starts(spark: SparkSession, path: str) -> dict[str, int]:
    """Where each file of a path begins in the order of names, in bytes.

    One entry per file, like the listing that Spark keeps for the scan.
    """
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size").collect()
    out, at = {}, 0
    for name, size in sorted(map(tuple, files)):
        out[name] = at
        at += (size + 1) * (EXPANSION if name.endswith(COMPRESSED) else 1)
    return out


def ordered_lines(spark: SparkSession, path: str, file_ord: int, order: str = "line") -> DataFrame:
    """``(value, ord)``: the lines that are not blank, with their order.

    ``offset``: ``file_ord * 2^50`` plus the bytes before the line, about;
    ``line``: ``file_ord * 2^40`` plus the number of lines before it.
    """
    lines = placed_lines(spark, path)
    if order == "offset":
        starts = spark.sparkContext.broadcast(file_starts(spark, path))  # one entry per file

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column("file").dictionary_encode()
                base = np.array([starts.value[x] for x in names.dictionary.to_pylist()], dtype=np.int64)
                at = base[names.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else base
                yield pa.RecordBatch.from_arrays(
                    [batch.column("value"), pc.add(batch.column("place"), pa.array(at + (file_ord << OFFSET_BITS)))], ["value", "ord"])

        return lines.mapInArrow(run, "value string, ord long")
    if order != "line":
        raise ValueError(f"unknown order {order!r}")
    # one row per split that has lines; splits are numbered by file name and start
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(splits, ["file", "block"]).select(
        "value", (F.lit(file_ord).cast("long") * F.lit(1 << LINE_BITS) + F.col("first") + F.col("row")).alias("ord"))


def _parsed(spark: SparkSession, path: str, schema, file_ord: int, order: str | None) -> DataFrame:
    """JSON lines as columns of ``schema``; a malformed line keeps its text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}
    if order is None:
        return spark.read.schema(schema).options(**options).json(path)
    row = F.from_json("value", schema, options).alias("_j")
    return ordered_lines(spark, path, file_ord, order).select(row, "ord").select("_j.*", "ord")


def read_items(spark: SparkSession, paths: Sequence[str], order: str | None = "line") -> DataFrame:
    """S1 + U1: JSONL item files in the given order; missing files are skipped.

    Malformed lines keep their text in ``_corrupt``; blank lines are dropped.
    ``file_ord`` is the index of the path in ``paths``; ``order`` is that of
    :func:`ordered_lines`, or None for rows without ``ord``.
    """
    parts = []
    for i, p in enumerate(paths):
        if path_exists(spark, p):
            parts.append(_parsed(spark, p, S.ITEM_WITH_CORRUPT, i, order).withColumn("file_ord", F.lit(i)))
    if not parts:
        empty = spark.createDataFrame([], S.ITEM_WITH_CORRUPT)
        return empty.withColumn("file_ord", F.lit(0)).withColumn("ord", F.lit(0).cast("long"))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def item_problems() -> F.Column:
    """Why an item cannot be processed (null when it can)."""
    return (
        F.when(F.col(S.CORRUPT).isNotNull(), F.lit("malformed_json"))
        .when(F.col("type").isNull(), F.lit("missing_type"))
        .when((F.col("type") == "post") & F.col("title").isNull(), F.lit("post_without_title"))
    )


def split_quarantine(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with a ``reason``)."""
    tagged = items.withColumn("reason", item_problems())
    good = tagged.where(F.col("reason").isNull()).drop("reason", S.CORRUPT)
    bad = tagged.where(F.col("reason").isNotNull())
    return good, bad


def read_chat(spark: SparkSession, path: str, order: str | None = "line") -> DataFrame:
    """Chat-format JSONL (``{"messages": [...]}`` per line).

    A missing file gives an empty frame (the synthetic file is optional).
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.CHAT_WITH_CORRUPT).withColumn("ord", F.lit(0).cast("long"))
    return _parsed(spark, path, S.CHAT_WITH_CORRUPT, 0, order)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A whole small text file, stripped; a scalar used as a literal."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0].strip() if rows else ""
