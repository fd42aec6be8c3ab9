"""Incremental ingest with Structured Streaming (T1..T3).

The original resumes a collection from a JSON state file of seen ids and
finished queries.  Here a file-source stream over the landing folder does
the same with exactly-once bookkeeping: the checkpoint remembers which
files were read (T1), ``dropDuplicates`` keeps the ids already emitted in
the state store (T2), and a ``foreachBatch`` sink appends finished query
labels to a table (T3).  ``trigger(availableNow=True)`` processes what has
landed and stops, like one run of the original.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.sources.readers import path_exists


#: State on disk, so that its size is not bound by the executors' memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no preallocated log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """The session with :data:`STATE`, for the streams started inside."""
    old = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def item_stream(spark: SparkSession, landing_dir: str, fmt: str = "json", schema=S.ITEM,
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream over files landing in a folder (``glob`` filters names)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(landing_dir)


def new_ids_only(stream: DataFrame, id_col: str | list[str] = "id", event_time: str | None = None,
                 watermark: str | None = None) -> DataFrame:
    """Emit each id once across all runs.

    Without a watermark the state keeps every id ever seen (the original's
    behaviour).  With ``event_time`` and ``watermark`` the state is bounded:
    duplicates are dropped while they arrive within the watermark delay, and
    rows that arrive after it are dropped themselves.
    """
    keys = [id_col] if isinstance(id_col, str) else id_col
    if event_time and watermark:
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def run_available(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                  foreach_batch=None) -> None:
    """Process everything that has landed, then stop (one collection run)."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        q = writer.foreachBatch(foreach_batch).start()
    else:
        q = writer.format(fmt).outputMode("append").option("path", out_path).start()
    q.awaitTermination()


def completed_sink(completed_path: str, label_col: str = "label"):
    """A ``foreachBatch`` function that records finished query labels.

    Appends the batch's distinct labels that are not yet recorded; a batch
    that is retried after a failure re-checks the table, so each label is
    stored once.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        labels = batch.select(label_col).distinct()
        if path_exists(spark, completed_path):  # not in the first run
            labels = labels.join(spark.read.parquet(completed_path), label_col, "left_anti")
        labels.withColumn("epoch", F.lit(epoch_id)).write.mode("append").parquet(completed_path)

    return write
