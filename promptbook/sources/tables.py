"""Parquet tables by name, and tolerant column access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def optional(df: DataFrame, name: str, kind: str, default=None) -> Column:
    """Column ``name`` of ``df``, or a typed default where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)
