"""Incremental ingestion with Structured Streaming.

What a checkpoint file and a status map do by hand, the stream's own checkpoint does here: files are read once, a batch
is written idempotently under its number, failures go to a dead-letter table, and a restart continues where the last
batch ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tabularium.plans.latest import latest_rows


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files below ``path``; ``files_per_batch`` bounds what one batch takes."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], force: bool = False) -> int:
    """Process what is there now and stop. Returns the number of batches of this run, counted as they are written.

    ``force`` forgets what was read before and takes everything again.
    """
    done: set[int] = set()
    if force:
        spark = stream.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def counted(df: DataFrame, batch_id: int) -> None:
        batch(df, batch_id)
        done.add(batch_id)

    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return len(done)


def append_log(target: str, ok: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Batches as partitions of a delivery log: a repeated batch replaces its own partition, so nothing is doubled.

    Rows for which ``ok`` doesn't hold go to ``<target>_failed`` with the batch number.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        good, bad = (df, None) if ok is None else (df.where(ok), df.where(~F.coalesce(ok, F.lit(False))))
        good.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{target}_failed/batch_id={batch_id}")

    return write


def current_state(spark: SparkSession, target: str, key: str, order: list[Column], row: str) -> DataFrame:
    """The upserted table: the latest row of each key in the delivery log."""
    return latest_rows(spark.read.parquet(target).drop("batch_id"), [key], order, row)


def windowed_counts(stream: DataFrame, ts: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_windows(counts: DataFrame, target: str, checkpoint: str | None = None) -> None:
    """Windowed counts in update mode: a batch writes the windows that it changed, under its number.

    State of windows behind the watermark is dropped, and rows that come later than that count no more.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint or target + "-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def window_state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last count of each window that ``run_windows`` left."""
    rows = spark.read.parquet(target)
    return rows.groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def once_by_key(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: resuming a delivery repeats nothing."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latest_status(progress: DataFrame) -> DataFrame:
    """One row of each file: its latest attempt, with counts and output of a finished and the error of a failed one.

    ``progress`` has ``filename, status, chunks, error, timestamp_text, output``. Errors are cut at 300 characters. Attempts
    of one minute: finished before failed before open, then the larger values. One aggregation with a map-side combine.
    """
    rank = F.when(F.col("status") == "done", 2).when(F.col("status") == "failed", 1).otherwise(0)
    row = F.struct(F.col("timestamp_text"), rank.alias("rank"), F.col("chunks"), F.col("error"), F.col("output"), F.col("status"))
    last = progress.groupBy("filename").agg(F.max(row).alias("m"))
    only = lambda status, c: F.when(F.col("m.status") == status, c)
    return last.select(
        "filename", F.col("m.status").alias("status"), only("done", F.col("m.chunks")).alias("chunks"), only("failed", F.substring("m.error", 1, 300)).alias("error"),
        F.col("m.timestamp_text").alias("timestamp_text"), only("done", F.col("m.output")).alias("output"),
    )


def run_counters(files: DataFrame, state: DataFrame) -> DataFrame:
    """Counters of a run over ``files`` (filename): finished ones are skipped, all others are to do."""
    known = files.join(state.select("filename", "status", "chunks"), "filename", "left")
    return known.agg(
        F.count_if(F.col("status") == "done").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.coalesce(F.col("status") == "done", F.lit(False))).alias("todo"),
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("chunks"))), F.lit(0)).alias("indexed"),
    )
