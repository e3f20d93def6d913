"""Queries that run a stream to its present end and read what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.plans.staging import discard_later, shared_dir
from tabularium.sources.tables import table
from tabularium.streaming import ingest


def _target(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tabularium-stream-{name}-{uuid.uuid4().hex}"
    discard_later(spark, path + "-offsets")
    return discard_later(spark, path)


def stream_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Chunk deliveries streamed into a log; the current state is the latest row of each chunk."""
    schema = table(spark, root, "index_chunk").select("row_no", "chunk_id", "filename", "indexed_at").schema
    at = _target(spark, "chunks")
    ingest.run_available(ingest.stream_files(spark, f"{root.rstrip('/')}/index_chunk.parquet", schema), at + "-offsets", ingest.append_log(at))
    return ingest.current_state(spark, at, "chunk_id", [F.col("indexed_at")], "row_no").select("row_no", "chunk_id", "filename")


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events counted in windows of a day by type, from a stream with a watermark."""
    rows = table(spark, root, "events")
    # the wall clock of the events taken as UTC, whatever the session's zone
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    stream = ingest.stream_files(spark, f"{root.rstrip('/')}/events.parquet", rows.schema).withColumn("ts", clock)
    counts = ingest.windowed_counts(stream, "ts", "30 days", "1 day", "event_type").select(F.col("window.start").alias("day"), "event_type", "n")
    at = _target(spark, "windows")
    ingest.run_windows(counts, at)
    out = ingest.window_state(spark, at, ["day", "event_type"])
    return out.select(F.date_from_unix_date(F.floor(F.unix_seconds("day") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n")


QUERIES = {"stream_upsert": stream_upsert, "stream_windows": stream_windows}
ORACLES = {
    "stream_upsert": "SELECT row_no, chunk_id, filename FROM index_chunk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) = 1",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
