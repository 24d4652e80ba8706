"""How distinctive a term is per record (problem 4): log-entropy weighting in two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptbook.plans.lineage import cut_table

#: A whole run of letters, digits and underscores that consists of three or more letters a-z only.
TERM = r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"


def local_counts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, tf)``. If the records are already partitioned by their id, no shuffle is added."""
    terms = records.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), 1)).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def log_entropy(records: DataFrame, id_col: str, text_col: str, total: DataFrame | None = None) -> DataFrame:
    """``(id, term, tf, df, gf, score)`` with score = ln(1 + tf) * (1 - H / ln N).

    H is the entropy of the term's spread over records and N the number of records, so a term spread evenly
    over all scores 0 and a term of one record its full log frequency. One aggregation gives tf by record and
    term, the other gf, df and the sum of tf ln tf by term. Records must have been made unique by id. ``total``, one
    row with N in its first column, spares counting them here, which shuffles their texts once more.

    Edge cases: null texts count as no record; a text without terms counts in N; with N = 1 the entropy is 0
    and the weight 1; an empty table gives no rows.
    """
    records = records.where(F.col(text_col).isNotNull())
    tf = cut_table(local_counts(records, id_col, text_col))
    n = records.agg(F.count("*").alias("n_all")) if total is None else total.select(F.col(total.columns[0]).alias("n_all"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log(F.col("tf").cast("double"))).alias("tl"))
    entropy = F.log(F.col("gf").cast("double")) - F.col("tl") / F.col("gf")
    weight = F.when(F.col("n_all") > 1, 1 - entropy / F.log(F.col("n_all").cast("double"))).otherwise(F.lit(1.0))
    stats = stats.crossJoin(F.broadcast(n)).select("term", "df", "gf", weight.alias("weight"))  # n is one row
    return tf.join(stats, "term").select("id", "term", "tf", "df", "gf", (F.log1p(F.col("tf").cast("double")) * F.col("weight")).alias("score"))
