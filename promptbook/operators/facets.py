"""What the interactive figure and the reports show of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.functions.text import blank_to, decade_rank, label_rank, strip

#: Columns by which points can be highlighted, with their captions: fixed values.
AXES = (("date_decade", "Decade"), ("genre", "Genre"), ("author", "Author"), ("title", "Title"), ("play_type", "Play type"), ("theater", "Theater"))
#: Colours of clusters in turn: the public qualitative palettes Plotly, Set3 and Dark24, and grey for outliers.
PALETTE = (
    "#636EFA #EF553B #00CC96 #AB63FA #FFA15A #19D3F3 #FF6692 #B6E880 #FF97FF #FECB52 "
    "rgb(141,211,199) rgb(255,255,179) rgb(190,186,218) rgb(251,128,114) rgb(128,177,211) rgb(253,180,98) rgb(179,222,105) rgb(252,205,229) rgb(217,217,217) rgb(188,128,189) rgb(204,235,197) rgb(255,237,111) "
    "#2E91E5 #E15F99 #1CA71C #FB0D0D #DA16FF #222A2A #B68100 #750D86 #EB663B #511CFB #00A08B #FB00D1 #FC0080 #B2828D #6C7C32 #778AAE #862A16 #A777F1 #620042 #1616A7 #DA60CA #6C4516 #0D2A63 #AF0038"
).split()
OUTLIER_COLOUR, OUTLIER_LABEL = "lightgrey", "-1: outliers"
TAGS, BAR = 18, 220


def author_key(c: Column) -> Column:
    return strip(F.split(F.coalesce(c, F.lit("(unknown)")), ",")[0])


def author_histogram(rows: DataFrame) -> DataFrame:
    """``(cluster, author, n)`` by surname."""
    return rows.groupBy("cluster", author_key(F.col("author")).alias("author")).agg(F.count("*").alias("n"))


def author_tags(histogram: DataFrame, limit: int = TAGS) -> DataFrame:
    """``(cluster, tags, more)``: the commonest authors with counts, and how many more there are."""
    ranked = histogram.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "author"))).withColumn("all", F.count("*").over(W.partitionBy("cluster")))
    shown = F.when(strip(F.col("author")) == "", F.lit("(unknown)")).otherwise(F.col("author"))
    top = ranked.where(F.col("r") <= limit).withColumn("tag", F.concat_ws(" ", shown, F.col("n").cast("string")))
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda s: s["tag"]), "; ").alias("tags"), F.greatest(F.max("all") - limit, F.lit(0)).alias("more"))


def decade_bars(rows: DataFrame) -> DataFrame:
    """``(cluster, decade, n, width, place)``: width in proportion to the cluster's highest bar, half to even, at least 1."""
    counts = rows.groupBy("cluster", F.coalesce("date_decade", F.lit("Unknown")).alias("decade")).agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy("cluster"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy(*decade_rank(F.col("decade"))))
    return counts.withColumn("width", F.greatest(F.lit(1), F.bround(F.lit(float(BAR)) * F.col("n") / most, 0).cast("int"))).withColumn("place", place)


def year_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("tcp").alias("n_plays"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.expr("cast(median(year) as int)").alias("median_year"))


def facet_values(rows: DataFrame, axes=AXES) -> DataFrame:
    """``(axis, value, place)``: the values to choose from, in one pass over the table."""
    present = [(c, n) for c, n in axes if c in rows.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.lit(c == "date_decade").alias("dated"), F.col(c).cast("string").alias("value")) for c, n in present])).alias("p")
    values = rows.select(pairs).select("p.*").where(F.col("value").isNotNull() & (strip(F.col("value")) != "") & (F.lower("value") != "unknown")).distinct()
    keys = [F.when(F.col("dated"), k) for k in decade_rank(F.col("value"))[:2]]
    return values.withColumn("place", F.row_number().over(W.partitionBy("axis").orderBy(*keys, "value"))).drop("dated")


def facet_mask(rows: DataFrame, column: str, value: str) -> DataFrame:
    """How the points look while one value is highlighted."""
    hit = F.coalesce(F.col(column) == value, F.lit(False))
    pick = lambda a, b: F.when(hit, F.lit(a)).otherwise(F.lit(b))
    return rows.select("character_id", hit.alias("hit"), pick(10, 3).alias("size"), pick(0.95, 0.20).alias("opacity"), pick(1.5, 0.0).alias("line_width"), pick("black", "rgba(0,0,0,0)").alias("line_color"))


def _shown(c: Column) -> Column:
    v = strip(c.cast("string"))
    return F.when((v != "") & ~F.lower(v).isin("nan", "none", "unknown"), v)


def hover_text() -> Column:
    """Twelve captioned lines, those without a value left out; the printed prefixes under the character if they differ."""
    name = blank_to(F.col("display_name"), F.col("normalized_name"))
    raw = strip(F.coalesce("raw_names", F.lit("")))
    shown = _shown(name)
    under = F.when(shown.isNotNull() & (raw != "") & (raw != strip(name)), F.concat(F.lit("  (raw: "), raw, F.lit(")")))
    date = blank_to(F.col("date_first_performance"), F.col("year").cast("string"))
    fields = [("Play", F.col("title")), ("Author", F.col("author")), ("Date", date), ("Decade", F.col("date_decade")), ("Genre", F.col("genre")), ("Play type", F.col("play_type")), ("Theater", F.col("theater")), ("Company", F.col("company")), ("Character", name), ("Role", F.col("role_description")), ("Cluster", F.coalesce("topic_label", F.lit(OUTLIER_LABEL))), ("Top words", F.col("top_words"))]
    parts = []
    for caption, c in fields:
        parts.append(F.concat(F.lit(f"{caption}: "), _shown(c)))
        if caption == "Character":
            parts.append(under)
    return F.concat_ws("<br>", *parts)


def colours(rows: DataFrame) -> DataFrame:
    """``(topic_label, place, colour)`` for each label, in the order of their numbers."""
    labels = rows.select(F.coalesce("topic_label", F.lit(OUTLIER_LABEL)).alias("topic_label")).distinct()
    place = F.row_number().over(W.orderBy(label_rank(F.col("topic_label")), "topic_label")) - 1  # one row per cluster
    palette = F.array(*[F.lit(c) for c in PALETTE])
    chosen = F.element_at(palette, (F.col("place") % len(PALETTE) + 1).cast("int"))
    return labels.withColumn("place", place).withColumn("colour", F.when(F.col("topic_label") == OUTLIER_LABEL, OUTLIER_COLOUR).otherwise(chosen))


def plays_of(rows: DataFrame) -> DataFrame:
    """One row per cluster and play, that of the play's longest character, in the order of years."""
    r = F.row_number().over(W.partitionBy("cluster", "tcp").orderBy(F.desc_nulls_last("n_words"), "character_id"))
    once = rows.withColumn("r", r).where("r = 1").drop("r")
    return once.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(F.asc_nulls_last("year"), "tcp")))


def longest(rows: DataFrame, k: int = 40) -> DataFrame:
    r = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc_nulls_last("n_words"), "character_id"))
    return rows.withColumn("place", r).where(F.col("place") <= k)
