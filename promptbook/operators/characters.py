"""From speeches under printed prefixes to one row per character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook import config
from promptbook.functions.matching import ratio
from promptbook.functions.roles import parse_roles
from promptbook.functions.text import clean_speech, n_words, normalize_for_match


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each ``key`` in a stated total order (a plain de-duplication would keep any)."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def speeches_of(plays: DataFrame) -> DataFrame:
    """``(tcp, pos, prefix, text)`` of ``plays(tcp, speeches MAP[, file])``; of a repeated prefix the last text counts, at
    the first place. A play in several files is read in the order of their names."""
    by_file = "file" in plays.columns
    rows = plays if by_file else plays.withColumn("file", F.lit(""))
    entries = rows.select("tcp", "file", F.posexplode_outer(F.map_entries(F.coalesce("speeches", F.create_map().cast("map<string,string>")))).alias("pos", "e"))
    said = entries.where("e is not null").select("tcp", F.struct("file", "pos").alias("at"), F.col("e.key").alias("prefix"), F.coalesce("e.value", F.lit("")).alias("text"))
    once = said.groupBy("tcp", "prefix").agg(F.min("at").alias("at"), F.max_by("text", "at").alias("text"))
    pos = F.row_number().over(W.partitionBy("tcp").orderBy("at")) - 1 if by_file else F.col("at.pos")  # the prefixes of one play
    return once.select("tcp", pos.alias("pos"), "prefix", "text")


def known_plays(rows: DataFrame, catalogue: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(catalogue.select("tcp").distinct(), "tcp", how)


def listed_roles(catalogue: DataFrame) -> DataFrame:
    """``(tcp, role_pos, role, description, role_norm)`` of the first catalogue row of each play."""
    once = first_by(catalogue.where("tcp is not null"), "tcp", "roles")
    parsed = once.select("tcp", F.posexplode(parse_roles("roles")).alias("role_pos", "r"))
    return parsed.select("tcp", "role_pos", F.col("r.name").alias("role"), F.col("r.description").alias("description"), normalize_for_match(F.col("r.name")).alias("role_norm"))


def best_matches(prefixes: DataFrame, roles: DataFrame) -> DataFrame:
    """``(tcp, norm, role, description, score)``: the best role of the play for each normalised prefix.

    Each prefix of a play is scored once against the roles of its own play, by an equi-join on the play; ties
    go to the role printed first; scores are cut to whole numbers before they are compared with thresholds.
    """
    pairs = prefixes.select("tcp", "norm").distinct().join(roles, "tcp").withColumn("score", F.floor(ratio("norm", "role_norm")).cast("int"))
    best = pairs.groupBy("tcp", "norm").agg(F.max_by(F.struct("role", "description"), F.struct("score", -F.col("role_pos"))).alias("r"), F.max("score").alias("score"))
    return best.select("tcp", "norm", "r.role", "r.description", "score")


def resolve(speeches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``speeches(tcp, pos, prefix, text)`` with ``norm, resolved, role_description, match_score, route``.

    Routes: ``crowd`` for generic labels (score 100), ``merge`` from 92, ``review`` from 70, else ``raw``.
    """
    named = speeches.withColumn("norm", normalize_for_match(F.col("prefix"))).where("norm <> ''")
    best = best_matches(named.where(~F.col("norm").isin(*config.GENERIC_LABELS)), listed_roles(catalogue))
    rows = named.join(best, ["tcp", "norm"], "left")
    crowd = F.col("norm").isin(*config.GENERIC_LABELS)
    score = F.when(crowd, 100).otherwise(F.coalesce("score", F.lit(0)))
    route = F.when(crowd, "crowd").when(score >= config.AUTO_MERGE, "merge").when(score >= config.REVIEW, "review").otherwise("raw")
    rows = rows.withColumn("match_score", score).withColumn("route", route)
    rows = rows.withColumn("resolved", F.when(F.col("route") == "crowd", config.CROWD).when(F.col("route") == "merge", F.col("role")).otherwise(F.col("prefix")))
    return rows.withColumn("role_description", F.when(F.col("route").isin("merge", "review"), F.coalesce("description", F.lit(""))).otherwise(F.lit(""))).withColumn("suggested", F.col("role")).drop("role", "description", "score")


def review_rows(resolved: DataFrame) -> DataFrame:
    """Names to look at by hand: ``(tcp, raw_name, suggested_match, score)``."""
    return resolved.where("route = 'review'").select("tcp", F.col("prefix").alias("raw_name"), F.col("suggested").alias("suggested_match"), F.col("match_score").alias("score")).distinct()


def rollup(resolved: DataFrame) -> DataFrame:
    """One row per play and resolved name: texts joined in order and then cleaned, prefixes joined in code-point
    order, the score of the first prefix, the longest description."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prefix", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ")
    about = F.coalesce("role_description", F.lit(""))
    got = resolved.groupBy("tcp", F.col("resolved").alias("normalized_name")).agg(
        F.array_join(F.array_sort(F.collect_set("prefix")), " | ").alias("raw_names"),
        F.max_by(about, F.struct(F.length(about), -F.col("pos"))).alias("role_description"),
        F.min_by("match_score", "pos").alias("match_score"),
        ordered.alias("joined"),
    )
    got = got.withColumn("speech_text", clean_speech(F.col("joined"))).drop("joined")
    return got.withColumn("n_chars", F.length("speech_text").cast("long")).withColumn("n_words", n_words(F.col("speech_text")))


def is_kept(name: str = "normalized_name", chars: str = "n_chars"):
    return (F.col(chars) >= config.MIN_SPEECH_CHARS) & (F.col(name) != config.CROWD)


def split_short(characters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Characters that are kept, and those too short or no person."""
    return characters.where(is_kept()), characters.where(~is_kept())
