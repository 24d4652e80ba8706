"""Characters enriched with what is known of their plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptbook.functions.text import character_id, collapse, display_name

FRONT = "character_id tcp brit_drama_number display_name normalized_name raw_names title author year date_decade date_first_performance genre play_type theater theater_type company role_description match_score n_chars n_words".split()
DESCRIPTIVE = "title author date_decade date_first_performance genre play_type theater theater_type company".split()


def one_per_play(metadata: DataFrame) -> DataFrame:
    """One row per play: the greatest in column order, so that the join cannot fan out; repeats are near copies."""
    rest = [c for c in metadata.columns if c != "tcp"]
    return metadata.where("tcp is not null").groupBy("tcp").agg(F.max(F.struct(*rest)).alias("m")).select("tcp", *[F.col(f"m.{c}").alias(c) for c in rest])


def order_columns(df: DataFrame, last: str = "speech_text") -> DataFrame:
    """Known columns first, others after them, the text last."""
    front = [c for c in FRONT if c in df.columns]
    rest = [c for c in df.columns if c not in front and c != last]
    return df.select(*front, *rest, *([last] if last in df.columns else []))


def build_documents(characters: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on the play; clashing columns of the metadata get ``_meta``; names, ids and texts derived."""
    plays = one_per_play(metadata)
    for c in plays.columns:
        if c != "tcp" and c in characters.columns:
            plays = plays.withColumnRenamed(c, f"{c}_meta")
    joined = characters.join(plays, "tcp", "left")
    joined = joined.withColumn("display_name", display_name(F.col("normalized_name")))
    joined = joined.withColumn("character_id", character_id(F.col("tcp"), F.col("display_name")))
    for c in [*DESCRIPTIVE, "plot"]:
        if c in joined.columns:
            joined = joined.withColumn(c, collapse(F.col(c)))
    return order_columns(joined)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, n_total, n_filled, pct)`` in one pass over the table."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c_{c}").alias("n_filled")) for c in columns])).alias("p")
    return counts.select("n", pairs).select("p.field", F.col("n").alias("n_total"), "p.n_filled", F.round(100 * F.col("p.n_filled") / F.col("n"), 2).alias("pct"))
