"""Rows of a table that arrives in files, each once, and counts by load time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The Parquet table as a stream, with the schema of the files that are there."""
    pattern = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(pattern).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if _is_dir(spark, pattern):
        return reader.parquet(pattern)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def first_rows(stream: DataFrame, key: str, at: str = "loaded_at", late: str = "60 days") -> DataFrame:
    """Each key once; a repeated row that comes within the watermark is dropped, and state older than it forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def loads_by_window(stream: DataFrame, at: str = "loaded_at", width: str = "1 day", late: str = "60 days") -> DataFrame:
    """``(window_start, n)``: rows loaded in each window."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "n")
