"""Stateful exact deduplication (operator 7), with DataFrame functions only.

Rows land as a narrow table (identifier, locator, digest) in the shared folder.
A file stream over that table feeds a keyed aggregation whose state is
disk-backed (RocksDB) and never expires: per SHA-256 digest of the normalised
text it holds the number of rows, the stable identifier of the row that stays
(the largest) and its content locator.  A later run continues from the same
state.

A locator is a Parquet file and the index of a row in it.  Rows that are read
straight from Parquet files are located there, and the files have to stay as
long as the state; other rows are written to the state's own folder first.
``DedupState.fetch`` reads the texts at locators.

A hit of a digest is checked on full bytes.  Within a run, grouping by digest
*and* text (combined in each map task, so copies of a hot text shuffle once per
task) must give one text per digest; and where the state knows the digest from
earlier runs, that text must equal the one at the keeper's locator.  Digests
for which this fails are settled by the texts at the locators of all their rows.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty.  Identifiers may be of any type that has an order, the same in all runs;
null sorts first.  Rows that repeat both identifier and text count as copies:
the one with the last locator stays.  An empty table gives an empty result;
other columns are untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.store import fresh, new_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no preallocated log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII takes the built-in ``lower``."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator(docs: DataFrame) -> tuple[Column, Column]:
    """Where a row read from Parquet lies: file and index of the row in it."""
    at = docs.metadataColumn("_metadata")
    return at.getField("file_path").alias("file"), at.getField("row_index").alias("row")


def _scans_parquet(docs: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, which tell row indices."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(*_locator(docs))
    except AnalysisException:
        return False
    return True


class DedupState:
    """The keyed state in ``path``: ``add`` rows, then read ``decisions``.

    A run that dies before its rows have landed is started again with ``add``, one
    that dies later with ``resume``."""

    def __init__(self, spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, text_col: str = "text"):
        self.spark, self.path, self.digest, self.text_col = spark, path, digest, text_col

    def add(self, docs: DataFrame, id_col: str = "doc_id") -> None:
        """Check the hits of ``docs`` on bytes, land its rows and run the stream."""
        if not _scans_parquet(docs):
            own = f"{self.path}/content/{uuid.uuid4().hex}"
            docs.select(id_col, self.text_col).write.parquet(own)
            docs = self.spark.read.parquet(own)
        self._check(docs)
        text = normalised(F.col(self.text_col))
        docs.select(
            F.col(id_col).alias("doc_id"), *_locator(docs), self.digest(text).alias("digest"), sha256(text).alias("text_sha256"),
        ).write.mode("append").parquet(f"{self.path}/landed")
        self.resume()

    def resume(self) -> None:
        """Run the stream over the landed rows that it has not seen."""
        with self._state_settings():
            (
                self.spark.readStream.schema(self.landed().schema).parquet(f"{self.path}/landed")
                .groupBy("digest")
                .agg(F.count(F.lit(1)), F.max(F.struct("doc_id", "file", "row")))
                .writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", f"{self.path}/state")
                .trigger(availableNow=True).start().awaitTermination()
            )

    @contextmanager
    def _state_settings(self) -> Iterator[None]:
        old = {k: self.spark.conf.get(k, None) for k in STATE}
        try:
            for k, v in STATE.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _check(self, docs: DataFrame) -> None:
        """Note the digests that stand for several texts of ``docs``, or for another
        text than that of the row which earlier runs kept."""
        text = normalised(F.col(self.text_col))
        texts = docs.select(self.digest(text).alias("digest"), text.alias("text")).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
        differ = F.count(F.lit(1)) > 1
        if self._has_run():
            kept = self.groups().select("digest", F.col("keep_file").alias("file"), F.col("keep_row").alias("row"))
            here = docs.select(self.digest(text).alias("digest")).distinct()
            kept = self.fetch(stored(kept.join(here, "digest", "left_semi"), "exact-hits")).select("digest", F.col("text").alias("kept_text"))
            texts = texts.join(kept, "digest", "left")
            differ |= F.max(F.coalesce(F.col("text") != F.col("kept_text"), F.lit(False)))
        texts.groupBy("digest").agg(differ.alias("differ")).where("differ").select("digest").write.mode("append").parquet(f"{self.path}/collided")

    def _has_run(self) -> bool:
        try:
            self.landed()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def landed(self) -> DataFrame:
        """doc_id, file, row, digest, text_sha256 of every row so far."""
        return self.spark.read.parquet(f"{self.path}/landed")

    def collided(self) -> DataFrame:
        return self.spark.read.schema("digest string").parquet(f"{self.path}/collided").distinct()

    def fetch(self, places: DataFrame) -> DataFrame:
        """``places`` (file, row and other columns) with the normalised whole text there."""
        # names of files, which the driver lists for any scan
        files = [r.file for r in places.select("file").distinct().collect()]
        if not files:
            return places.withColumn("text", F.lit(""))
        content = self.spark.read.schema(f"`{self.text_col}` string").parquet(*files)
        return places.join(content.select(*_locator(content), normalised(F.col(self.text_col)).alias("text")), ["file", "row"])

    def groups(self) -> DataFrame:
        """A copy of the retained state: digest, rows, identifier and locator of the keeper."""
        raw = self.spark.read.format("statestore").load(f"{self.path}/state")
        rows, keeper = (F.col("value")[name] for name in raw.schema["value"].dataType.names)
        with self._state_settings():
            return stored(raw.select(
                F.col("key.digest").alias("digest"), rows.alias("group_size"),
                keeper["doc_id"].alias("keep_id"), keeper["file"].alias("keep_file"), keeper["row"].alias("keep_row"),
            ), "exact-groups")

    def decisions(self) -> DataFrame:
        """One row per landed row: doc_id, keep_id, group_size, kept, text_sha256, the
        row's locator (file, row) and the keeper's (keep_file, keep_row)."""
        out = self.landed().join(self.groups(), "digest")
        collided = self.collided()
        if not collided.isEmpty():
            out = out.join(collided, "digest", "left_anti").unionByName(self._by_text(collided))
        kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        return out.select(
            "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "file", "row", "keep_file", "keep_row")

    def _by_text(self, collided: DataFrame) -> DataFrame:
        """The rows of digests that several texts share, settled by the texts themselves."""
        rows = stored(self.fetch(stored(self.landed().join(collided, "digest", "left_semi"), "exact-collided")), "exact-texts")
        best = rows.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("k"))
        return rows.join(best, "text").select(
            "digest", "doc_id", "file", "row", "text_sha256", "group_size", F.col("k.doc_id").alias("keep_id"),
            F.col("k.file").alias("keep_file"), F.col("k.row").alias("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The decisions of one run over ``docs`` (see ``DedupState.decisions``)."""
    spark = docs.sparkSession
    state = DedupState(spark, new_folder(spark, "exact-dedup"), digest, text_col)
    state.add(docs, id_col)
    return state.decisions()


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    decided = exact_dedup(docs, id_col, text_col)
    own, sha, name = fresh(docs, "own_sha"), fresh(docs, "kept_sha"), fresh(docs, "kept_id")
    kept = decided.where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(own, sha256(normalised(F.col(text_col))))
    same = (F.col(own) == F.col(sha)) & F.col(id_col).eqNullSafe(F.col(name))
    out = keyed.join(kept, same, "left_semi")
    if not docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates([id_col, own])  # rows that repeat identifier and text
    return out.select(*docs.columns)
