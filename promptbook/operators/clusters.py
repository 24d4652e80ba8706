"""Clusters of characters: summaries, class-based TF-IDF, labels and typical members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.functions.text import TERM, label_for

#: A term in more than this share of the characters is a stop word, in whatever spelling, unless a list is given.
STOP_SHARE = 0.2

#: Types that an aggregate can update in place, so that it hashes instead of sorting.
_FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def latest(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """The latest row of each key; late and repeated rows give way to it. Select the columns needed before."""
    rest = [c for c in df.columns if c not in (key, order)]
    rows = df.where(F.col(key).isNotNull()).groupBy(key)
    kinds = dict(df.dtypes)
    if all(kinds[c] in _FIXED_WIDTH for c in rest):
        return rows.agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
    return rows.agg(F.max(F.struct(order, *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in [order, *rest]])


def summary(rows: DataFrame, preset: str) -> DataFrame:
    """Counts of one clustering; ``largest_cluster_size`` counts the outliers too, ``largest_real_cluster`` doesn't."""
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    real = F.col("cluster") != -1
    out = sizes.agg(F.sum("n").alias("n_total"), F.count_if(real).alias("n_clusters"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_outliers"), F.max("n").alias("largest_cluster_size"), F.max(F.when(real, F.col("n"))).alias("largest_real_cluster"))
    return out.select(F.lit(preset).alias("preset"), "n_total", F.col("n_clusters").alias("n_clusters_excl_-1"), "n_outliers", F.round(100 * F.col("n_outliers") / F.col("n_total"), 2).alias("outliers_pct"), "largest_cluster_size", "largest_real_cluster")


def sizes(rows: DataFrame, k: int = 8) -> DataFrame:
    return rows.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(k)


def stop_words(counts: DataFrame, records: DataFrame, share: float = STOP_SHARE) -> DataFrame:
    """``(term)`` of ``counts(term, records)`` in more than ``share`` of ``records(n_records)``, one row.

    They are at most the distinct terms of an average record divided by ``share``, however large the collection.
    """
    return counts.crossJoin(F.broadcast(records)).where(F.col("records") > share * F.col("n_records")).select("term")  # records is one row


def class_tfidf(rows: DataFrame, min_df: int = 2, max_df: float = 0.95, stopwords=None, with_outliers: bool = True) -> DataFrame:
    """``(cluster, term, tf, df, tfidf)`` of ``rows(character_id, cluster, speech_text)``, a cluster being one document.

    Texts are never concatenated: terms are counted by character and then by cluster with map-side aggregation. A
    term stays if it is in at least ``min_df`` clusters and in at most ``max_df`` of them; with too few clusters
    nothing is left. The weights of a cluster have length 1. Stop words are learnt from the rows (``stop_words``),
    or a list given as ``stopwords``.
    """
    rows = rows.where("cluster is not null and speech_text is not null")
    if not with_outliers:
        rows = rows.where("cluster <> -1")
    terms = rows.select("character_id", "cluster", F.explode(F.regexp_extract_all(F.lower("speech_text"), F.lit(TERM), 1)).alias("term"))
    if stopwords is not None:
        terms = terms.where(~F.col("term").isin(*sorted(stopwords)))
    by_record = terms.groupBy("character_id", "cluster", "term").agg(F.count("*").alias("tf"))
    tf = by_record.groupBy("cluster", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("records"))
    n = rows.agg(F.countDistinct("cluster").alias("n"), F.countDistinct("character_id", "cluster").alias("n_records"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("records").alias("records"))
    if stopwords is None:
        df = df.join(F.broadcast(stop_words(df, n.select("n_records"))), "term", "left_anti")  # few terms, see stop_words
    df = df.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))  # n is one row
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weights = tf.join(df.select("term", "df", idf.alias("idf")), "term").select("cluster", "term", "tf", "df", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("cluster").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, "cluster").select("cluster", "term", "tf", "df", (F.col("w") / F.col("norm")).alias("tfidf"))


def top_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster, rank, term, tfidf)``; equal weights rank by term, descending."""
    ranked = weights.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.round("tfidf", 9)), F.desc("term"))))
    return ranked.where(F.col("rank") <= k).select("cluster", "rank", "term", "tfidf")


def _listed(order: Column, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), sep)


def top_members(rows: DataFrame, k: int = 5) -> DataFrame:
    """``(cluster, top_characters)``: names of the longest members; only k rows of a cluster are ever gathered."""
    r = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc_nulls_last("n_chars"), "character_id"))
    return rows.withColumn("r", r).where(F.col("r") <= k).groupBy("cluster").agg(_listed(F.col("r"), F.col("normalized_name"), " | ").alias("top_characters"))


def build_labels(rows: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """``(cluster, n_members, top_words, top_characters, label)`` of ``rows(character_id, cluster, ...)``."""
    joined = rows.select("character_id", F.col("cluster").cast("int").alias("cluster")).join(texts, "character_id")
    words = top_terms(class_tfidf(joined), k).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))
    counts = rows.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n_members"))
    out = counts.join(words, "cluster", "left").join(top_members(rows), "cluster", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return out.select("cluster", "n_members", F.array_join("words", ", ").alias("top_words"), "top_characters", label_for(F.col("cluster"), F.col("words")).alias("label"))


def join_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Label and top words of its cluster for each row; ``labels`` has one row per cluster."""
    return rows.drop("topic_label", "top_words").join(labels.select("cluster", F.col("label").alias("topic_label"), "top_words"), "cluster", "left")
