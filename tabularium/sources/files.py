"""File sources and sinks, and adapters for what needs libraries outside Spark.

An adapter is a function over one document; the engine runs it in Arrow batches with errors kept per row. The offline
defaults need nothing and return nothing, so every pipeline stays runnable.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tabularium.schemas import INDEX_CHUNK, PAGES


@dataclass(frozen=True)
class Settings:
    """Options of a deployment, taken from the environment once."""

    data_dir: str = "data"
    index_table: str = "chunks"
    database: str = ""

    @classmethod
    def from_env(cls, prefix: str = "TABULARIUM_") -> Settings:
        return cls(**{k: os.environ[prefix + k.upper()] for k in cls.__dataclass_fields__ if prefix + k.upper() in os.environ})


def documents(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """``(path, length, modified, content)`` of all non-empty files below ``root``; contents are read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.where("length > 0").select("path", "length", F.col("modificationTime").alias("modified"), "content")


def prioritised(files: DataFrame, first: str = "lois_finances") -> DataFrame:
    """Files of the preferred folder first, then by path."""
    return files.withColumn("priority", F.when(F.col("path").contains(first), 0).otherwise(1)).orderBy("priority", "path")


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def processed_json(spark: SparkSession, path: str, schema: StructType = INDEX_CHUNK, whole_files: bool = False, glob: str | None = None) -> DataFrame:
    """Chunk files, one object in a line as ``write_json`` leaves them, or with ``whole_files`` an indented array in a file.

    Damaged records come out as nulls instead of failing the job. Whole files can't be split, lines can.
    """
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", whole_files).option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).json(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def write_json(df: DataFrame, path: str, by: str = "document_id") -> None:
    """One folder for each document; null fields are left out."""
    df.write.mode("overwrite").partitionBy(by).option("ignoreNullFields", "true").json(path)


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON objects without their null fields."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built on first use. A half-written table has no success mark and is built again."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def extracted_pages(files: DataFrame, extract: Callable[[bytes], list[tuple[int, str, bool]]]) -> DataFrame:
    """Pages of each file by ``extract(bytes) -> [(page, text, is image)]``, and an ``error`` instead where it fails."""
    schema = "doc_path string, doc_name string, page_num int, text string, is_image_page boolean, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows = [(path, name, p, t, i, None) for p, t, i in extract(content.as_py())]
                except Exception as x:
                    rows = [(path, name, None, None, None, f"{type(x).__name__}: {x}"[:300])]
                if rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*PAGES.names, "error"])

    return files.select("path", "content").mapInArrow(run, schema)


def with_recognition(pages: DataFrame, recognise: Callable[[DataFrame], DataFrame], least: int = 80) -> DataFrame:
    """Pages whose text is shorter than ``least`` get their text from ``recognise(pages) -> (doc_path, page_num, text)``.

    Cheap text first: only the short remainder reaches the recogniser, by a split instead of a guarded expression,
    because Python functions inside a conditional run on every row.
    """
    short = F.coalesce(F.length(F.trim("text")) < least, F.lit(True))
    rest = pages.where(short)
    found = recognise(rest).select("doc_path", "page_num", F.col("text").alias("_text"))
    fixed = rest.join(found, ["doc_path", "page_num"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    return pages.where(~short).unionByName(fixed)


def text_embedder(text: Column, dim: int = 64) -> Column:
    """Deterministic hashing embedder, the offline stand-in for a model: signed counts of words, unit length."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed(text)


def stored_chunks(chunks: DataFrame, most: int = 5000) -> DataFrame:
    """Chunks as the graph stores them: texts of at most ``most`` characters."""
    return chunks.withColumn("text", F.substring("text", 1, most))


def filled_documents(templates: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Word-processing files with ``{{NAME}}`` tokens filled: ``(key, content, error)``.

    ``templates`` has ``(key, content)`` with zipped parts; ``values`` has ``(key, filled map<string,string>)``, already
    escaped or as runs. Every XML part is decoded as UTF-8, else as UTF-16, and written back in its own coding; other parts
    are copied. A file that is no zip, or a null one, comes out null with its error.
    """
    import io
    import zipfile

    kind = templates.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for content, filled in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    out = io.BytesIO()
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
                        for part in old.infolist():
                            data = old.read(part)
                            if part.filename.endswith(".xml"):
                                try:
                                    text, coding = data.decode("utf-8"), "utf-8"
                                except UnicodeDecodeError:
                                    text, coding = data.decode("utf-16"), "utf-16"
                                for token, value in filled or ():
                                    text = text.replace("{{" + token + "}}", value or "")
                                data = text.encode(coding)
                            new.writestr(part, data)
                    contents.append(out.getvalue())
                    errors.append(None)
                except Exception as x:
                    contents.append(None)
                    errors.append(f"{type(x).__name__}: {x}"[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["_key", "content", "error"])

    joined = templates.select(F.col(key).alias("_key"), "content").join(values.select(F.col(key).alias("_key"), "filled"), "_key", "left")
    return joined.mapInArrow(run, f"_key {kind}, content binary, error string").withColumnRenamed("_key", key)


def no_answer(prompt: str) -> str:
    """Offline stand-in for a language model."""
    return ""


def answers(prompts: DataFrame, key: str, prompt: str, model: Callable[[str], str] = no_answer) -> DataFrame:
    """``(key, answer)``; a failing call gives an empty answer."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(1).to_pylist():
                try:
                    out.append(model(p or ""))
                except Exception:
                    out.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_key", "answer"])

    return prompts.select(F.col(key).alias("_key"), prompt).mapInArrow(run, f"_key {kind}, answer string").withColumnRenamed("_key", key)
