"""Cutting lineage through files that every executor can reach.

The folder comes from ``spark.checkpoint.dir``. Only where a session leaves it unset and runs in one process (tests) is a
folder of our own chosen and set; on a cluster a missing setting is an error, so a lost executor never takes a stage with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_at_end: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set first where nothing is configured and all tasks run in the driver."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="tabularium-")
        _at_end.append((spark, path))
        spark.sparkContext.setCheckpointDir(path)
    return path


def discard_later(spark: SparkSession, path: str, at_end: bool = False) -> str:
    """Have ``path`` deleted with the staged tables, or only when the process ends."""
    (_at_end if at_end else _written).append((spark, path))
    return path


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it (columnar, with statistics)."""
    spark = df.sparkSession
    path = discard_later(spark, f"{shared_dir(spark).rstrip('/')}/tabularium-{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def discard_staged() -> None:
    """Delete the staged tables, streams' logs and offsets of this process; results that still read them must have been
    written before. Long sessions call this between queries; the end of the process calls it too."""
    while _written:
        _delete(*_written.pop())


@atexit.register
def _discard_all() -> None:
    discard_staged()
    while _at_end:
        _delete(*_at_end.pop())
