"""Files that the pipeline reads and writes besides Parquet."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAY = T.StructType([T.StructField("tcp", T.StringType()), T.StructField("speeches", T.MapType(T.StringType(), T.StringType()))])


def read_plays(spark: SparkSession, folder: str, glob: str = "A*.json") -> DataFrame:
    """One JSON object per file with ``tcp`` and ``speeches``; the schema is given, nothing is inferred. ``file``,
    the name of its file, is the key by which files are ordered (``characters.speeches_of`` numbers speeches by it)."""
    df = spark.read.schema(PLAY).option("multiLine", True).option("pathGlobFilter", glob).json(folder)
    return df.withColumn("file", F.col("_metadata.file_name"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Writes a table that may have been read from another path; a table is never overwritten while it is read."""
    own = "/" + path.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    if any(own in f for f in df.inputFiles()):
        raise ValueError(f"{path} is an input of this table; write to a new path")
    df.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, rows_per_task: int = 20_000) -> DataFrame:
    """``(row, embedding)`` of a dense .npy matrix in a folder that all executors see; each task maps its own rows."""
    shape = np.load(path, mmap_mode="r").shape
    tasks = max(1, -(-shape[0] // rows_per_task))

    def run(batches):
        x = np.load(path, mmap_mode="r")
        for b in batches:
            ids = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.asarray(x[ids], dtype=np.float32)), pa.list_(pa.float32()))], names=["row", "embedding"])

    return spark.range(0, shape[0], 1, tasks).withColumnRenamed("id", "row").mapInArrow(run, "row bigint, embedding array<float>")


def write_matrix(vectors: DataFrame, path: str, rows_per_batch: int = 20_000) -> int:
    """Writes ``vectors(id, embedding)`` as a dense .npy matrix of 32-bit numbers in the order of ids, and returns
    its rows. Rows pass the driver in batches of a partition each; the matrix is never held in memory.

    An empty table and vectors of different lengths are an error: a matrix has a shape.
    """
    sizes = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if not sizes.n or sizes.a != sizes.b or sizes.a < 1:
        raise ValueError("a matrix needs rows of one length")
    parts = max(1, -(-sizes.n // rows_per_batch))
    out = np.lib.format.open_memmap(path, mode="w+", dtype=np.float32, shape=(sizes.n, sizes.a))
    at = 0
    for row in vectors.select("id", "embedding").repartitionByRange(parts, "id").sortWithinPartitions("id").toLocalIterator(prefetchPartitions=False):
        out[at] = row.embedding
        at += 1
    out.flush()
    return at


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A spreadsheet as strings. Needs openpyxl; where that is missing, convert the sheet to CSV or Parquet first."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl; convert the sheet to CSV or Parquet instead") from e
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Writes ``pages(path, html)`` from the executors into a folder they share."""

    def save(rows) -> None:
        for r in rows:
            target = os.path.join(folder, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(r.html)

    pages.foreachPartition(save)
