"""Reading the records of the test tables, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptbook.sources.tables import table


def speeches(spark: SparkSession, folder: str) -> DataFrame:
    """``(character_id, speech_text)`` of every character with a text. Of repeated rows with different
    texts the greatest text counts; copies meet in the map-side aggregate before the shuffle."""
    df = table(spark, folder, "character_documents").where("character_id is not null and speech_text is not null")
    return df.groupBy("character_id").agg(F.max("speech_text").alias("speech_text"))


def speakers(spark: SparkSession, folder: str) -> DataFrame:
    """``(total)``: how many characters have a text, counted without moving texts."""
    df = table(spark, folder, "character_documents").where("character_id is not null and speech_text is not null")
    return df.agg(F.countDistinct("character_id").alias("total"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """``(cluster, top_words)`` of every cluster with top words; different lists of a cluster are joined by a comma."""
    df = table(spark, folder, "cluster_labels").where("top_words is not null").select("cluster", "top_words").distinct()
    return df.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("top_words")), ",").alias("top_words"))
