"""Pages about clusters and characters, as columns ``(path, html)``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.functions.text import blank_to, highlight, html_escape, meta_line, page_name, slugify, strip, top_words, truncate
from promptbook.operators import excerpts, facets


#: How much of a plot the pages show.
PLOT_ON_CLUSTER_PAGE, PLOT_ON_CHARACTER_PAGE = 1500, 2500
#: Points of one piece of a trace of the figure.
TRACE_POINTS = 5000


def _tag(name: str, body: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), F.coalesce(body, F.lit("")), F.lit(f"</{name}>"))


def _page(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), html_escape(title), F.lit("</title></head><body>"), body, F.lit("</body></html>"))


def cluster_label(rows: DataFrame) -> DataFrame:
    """``(cluster, label)``: a label the rows carry, or the cluster's number."""
    got = rows.groupBy("cluster").agg(F.min("topic_label").alias("l"))
    return got.select("cluster", F.coalesce("l", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label"))


def _passages(n: int) -> Column:
    found = excerpts.excerpts(n)(F.coalesce("speech_text", F.lit("")), F.col("keywords"))
    return F.transform(found, lambda e: F.concat(F.lit('<div class="excerpt">'), highlight(e["passage"], e["hits"]), F.lit("</div>")))


def _meta() -> Column:
    return meta_line(F.col("author"), F.col("year"), F.col("genre"), F.col("company"), F.col("theater"))


def unique_slugs(rows: DataFrame) -> DataFrame:
    """``slug`` of each character; ids that give the same file name get a number behind it, in the order of ids.

    Only ids are numbered; the rows with their texts are joined to them.
    """
    ids = rows.select("character_id").distinct().withColumn("slug", slugify(F.col("character_id")))
    place = F.row_number().over(W.partitionBy(F.lower("slug")).orderBy("character_id"))
    ids = ids.withColumn("_n", place).select("character_id", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("_n").cast("string"))).alias("slug"))
    return rows.join(ids, "character_id")


def _plot(n: int) -> Column:
    """The play's plot, clipped; empty where it is unknown or the rows carry none."""
    text = truncate(F.col("plot"), n)
    return F.when(text != "", F.concat(F.lit('<div class="plot"><div class="title">'), html_escape(F.col("title")), F.lit('</div><div class="meta">'), _meta(), F.lit('</div><div class="body">'), html_escape(text), F.lit("</div></div>"))).otherwise(F.lit(""))


def _with_plot(rows: DataFrame) -> DataFrame:
    return rows if "plot" in rows.columns else rows.withColumn("plot", F.lit(None).cast("string"))


def character_pages(rows: DataFrame) -> DataFrame:
    """A page for each character that is no outlier: facts, passages with its cluster's words, the whole speech, the plot
    of its play where ``rows`` have a ``plot``."""
    rows = unique_slugs(_with_plot(rows).where("cluster <> -1")).withColumn("keywords", top_words(F.col("top_words")))
    name = blank_to(F.col("display_name"), F.col("normalized_name"))
    facts = [("Play", F.col("title")), ("Author", F.col("author")), ("Year", F.col("year").cast("string")), ("Decade", F.col("date_decade")), ("Genre", F.col("genre")), ("Play type", F.col("play_type")), ("Theater", F.col("theater")), ("Company", F.col("company")), ("Role", F.col("role_description")), ("Speech prefixes", F.col("raw_names")), ("Words", F.col("n_words").cast("string")), ("Characters", F.col("n_chars").cast("string")), ("BritDrama no.", F.col("brit_drama_number").cast("string"))]
    listed = F.concat(*[F.coalesce(F.when(strip(v) != "", F.concat(F.lit(f"<tr><th>{k}</th><td>"), html_escape(v), F.lit("</td></tr>"))), F.lit("")) for k, v in facts])
    body = F.concat(
        _tag("h1", html_escape(name)),
        F.concat(F.lit('<p><a href="../'), page_name(F.col("cluster")), F.lit('.html">'), html_escape(F.coalesce("topic_label", F.lit(""))), F.lit("</a></p>")),
        _tag("table", listed),
        F.array_join(_passages(excerpts.PER_CHARACTER_PAGE), ""),
        _tag("div", html_escape(F.coalesce("speech_text", F.lit(""))), ' class="speech"'),
        _plot(PLOT_ON_CHARACTER_PAGE),
    )
    return rows.select(F.concat(F.lit("characters/"), F.col("slug"), F.lit(".html")).alias("path"), _page(name, body).alias("html"))


def cluster_pages(rows: DataFrame) -> DataFrame:
    """A page for each cluster: its top words, authors, decades, its longest characters with passages, its plays in the
    order of years, with their plots where ``rows`` have a ``plot``."""
    rows = _with_plot(rows).where("cluster <> -1").withColumn("keywords", top_words(F.col("top_words")))
    row_name = html_escape(blank_to(F.col("display_name"), F.col("normalized_name")))
    shown = unique_slugs(facets.longest(rows))
    block = F.concat(F.lit('<div class="character"><a href="characters/'), F.col("slug"), F.lit('.html">'), row_name, F.lit("</a> in <em>"), html_escape(F.col("title")), F.lit("</em><br>"), _meta(), F.lit("<br>"), F.coalesce(F.col("n_words").cast("string"), F.lit("")), F.lit(" words"), F.coalesce(F.when(strip(F.col("role_description")) != "", _tag("p", F.concat(F.lit("Role: "), html_escape(truncate(F.col("role_description"), 240))))), F.lit("")), F.array_join(_passages(excerpts.PER_CLUSTER_PAGE), ""), F.lit("</div>"))
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"]), "")
    blocks = shown.groupBy("cluster").agg(joined("place", block).alias("blocks"))  # at most 40 rows a cluster
    play = F.concat(F.lit("<li>"), html_escape(F.col("title")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")), F.lit("</li>"))
    plays = facets.plays_of(rows.drop("speech_text", "keywords")).groupBy("cluster").agg(joined("place", play).alias("plays"), joined("place", _plot(PLOT_ON_CLUSTER_PAGE)).alias("plots"))  # one row for each play of a cluster
    tags = facets.author_tags(facets.author_histogram(rows))
    bars = facets.decade_bars(rows)
    bar = F.concat(F.lit('<div class="bar" style="width:'), F.col("width").cast("string"), F.lit('px">'), html_escape(F.col("decade")), F.lit(" "), F.col("n").cast("string"), F.lit("</div>"))
    bars = bars.groupBy("cluster").agg(joined("place", bar).alias("bars"))
    words = rows.groupBy("cluster").agg(F.max("top_words").alias("words"))
    stats = facets.year_stats(rows)
    label = cluster_label(rows)
    page = stats.join(label, "cluster").join(words, "cluster").join(blocks, "cluster", "left").join(tags, "cluster", "left").join(bars, "cluster", "left").join(plays, "cluster", "left")
    title = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(" — "), F.col("label"))
    more = F.when(F.col("more") > 0, F.concat(F.lit(" +"), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    or_blank = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(
        _tag("h1", html_escape(title)),
        _tag("p", html_escape(or_blank("words")), ' class="words"'),
        _tag("p", F.concat(F.col("n").cast("string"), F.lit(" characters, "), F.col("n_plays").cast("string"), F.lit(" plays"))),
        _tag("p", F.concat(html_escape(or_blank("tags")), more)),
        or_blank("bars"),
        or_blank("blocks"),
        _tag("ul", or_blank("plays"), ' class="plays"'),
        or_blank("plots"),
    )
    return page.select(F.concat(page_name(F.col("cluster")), F.lit(".html")).alias("path"), _page(title, body).alias("html"))


def index_cards(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One card per cluster: ``(cluster, label, top_words, n, n_plays, first_year, last_year, median_year, authors)``."""
    real = rows.where("cluster <> -1")
    words = labels.groupBy("cluster").agg(F.max("top_words").alias("top_words"))
    out = facets.year_stats(real).join(cluster_label(real), "cluster").join(words, "cluster", "left").join(facets.author_tags(facets.author_histogram(real), 6), "cluster", "left")
    return out.select("cluster", "label", F.coalesce("top_words", F.lit("")).alias("top_words"), "n", "n_plays", "first_year", "last_year", "median_year", F.col("tags").alias("authors"))


def index_page(cards: DataFrame) -> DataFrame:
    """The master index; one short row per cluster is gathered."""
    line = F.concat(F.lit('<li><a href="'), page_name(F.col("cluster")), F.lit('.html">'), html_escape(F.col("label")), F.lit("</a> "), F.col("n").cast("string"), F.lit(" characters</li>"))
    rows = cards.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", line.alias("v")))), lambda s: s["v"]), "").alias("items"))
    return rows.select(F.lit("index.html").alias("path"), _page(F.lit("Clusters"), _tag("ul", F.col("items"))).alias("html"))


def figure_points(rows: DataFrame) -> DataFrame:
    """``(character_id, x, y, colour, hover)`` of the figure; labels of clusters are few and joined by a small table."""
    shown = rows.where("cluster <> -1")
    look = facets.colours(shown)
    return shown.withColumn("topic_label", F.coalesce("topic_label", F.lit(facets.OUTLIER_LABEL))).withColumn("hover", facets.hover_text()).join(look, "topic_label", "left").select("character_id", "x", "y", "colour", "hover")


def figure_traces(rows: DataFrame, points: int = TRACE_POINTS) -> DataFrame:
    """``(place, piece, topic_label, trace)``: the figure's points by label as JSON traces, in pieces of about ``points``,
    so that no label, however large, is gathered into one row. Points without a place on the map are left out."""
    dots = figure_points(rows).join(rows.select("character_id", F.coalesce("topic_label", F.lit(facets.OUTLIER_LABEL)).alias("topic_label")), "character_id")
    dots = dots.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    sizes = dots.groupBy("topic_label").agg(F.ceil(F.count("*") / points).alias("pieces"))
    dots = dots.join(sizes, "topic_label").withColumn("piece", F.pmod(F.xxhash64("character_id"), F.col("pieces")))
    got = dots.groupBy("topic_label", "piece").agg(F.min("colour").alias("colour"), F.array_sort(F.collect_list(F.struct("character_id", "x", "y", "hover"))).alias("p"))
    trace = F.struct(
        F.lit("scattergl").alias("type"), F.lit("markers").alias("mode"), F.col("topic_label").alias("name"), F.col("topic_label").alias("legendgroup"), (F.col("piece") == 0).alias("showlegend"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.hover").alias("text"), F.col("p.character_id").alias("ids"), F.lit("text").alias("hoverinfo"), F.struct(F.col("colour").alias("color"), F.lit(6).alias("size")).alias("marker"),
    )
    order = facets.colours(rows.where("cluster <> -1")).select("topic_label", "place")
    return got.join(order, "topic_label").select("place", "piece", "topic_label", F.to_json(trace).alias("trace"))


def figure_menus(rows: DataFrame) -> DataFrame:
    """``(axis, values)``: the entries of the drop-down lists by which points are highlighted, as JSON."""
    values = facets.facet_values(rows.where("cluster <> -1"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"])
    return values.groupBy("axis").agg(F.to_json(listed).alias("values"))


def figure_keys(rows: DataFrame, points: int = TRACE_POINTS) -> DataFrame:
    """``(piece, keys)``: what each point can be highlighted by, as JSON objects of about ``points`` characters each."""
    shown = rows.where("cluster <> -1")
    pieces = max(1, -(-shown.count() // points))
    axes = F.create_map(*[x for c, n in facets.AXES if c in rows.columns for x in (F.lit(n), F.col(c).cast("string"))])
    keyed = shown.dropDuplicates(["character_id"]).select("character_id", axes.alias("axes"), F.pmod(F.xxhash64("character_id"), F.lit(pieces)).alias("piece"))
    return keyed.groupBy("piece").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("character_id", "axes")))).alias("keys"))


def write_figure(rows: DataFrame, path: str, library: str = "https://cdn.plot.ly/plotly-2.35.2.min.js") -> None:
    """Writes the interactive figure of ``rows`` as one HTML file: a trace for each label and a drop-down list for each
    axis. Traces pass the driver one piece at a time."""
    name = lambda v: v.replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><html><head><meta charset="utf-8"><title>Characters</title><script src="{library}"></script></head><body><div id="menus"></div><div id="figure"></div><script>const traces = [], keys = {{}}, menus = {{}};\n')
        for r in figure_traces(rows).orderBy("place", "piece").toLocalIterator():
            f.write(f"traces.push({name(r.trace)});\n")
        for r in figure_keys(rows).toLocalIterator():
            f.write(f"Object.assign(keys, {name(r['keys'])});\n")
        for r in figure_menus(rows).orderBy("axis").toLocalIterator():
            f.write(f"menus[{name(json.dumps(r.axis))}] = {name(r['values'])};\n")
        f.write(_SCRIPT)
        f.write("</script></body></html>")


_SCRIPT = """
const figure = document.getElementById("figure");
Plotly.newPlot(figure, traces, {hovermode: "closest", height: 900});
for (const [axis, values] of Object.entries(menus)) {
  const list = document.createElement("select");
  list.append(new Option(axis + ": all", ""), ...values.map(v => new Option(v)));
  list.onchange = () => {
    const hit = t => t.ids.map(id => (keys[id] || {})[axis] === list.value), every = list.selectedIndex === 0;
    Plotly.restyle(figure, {
      "marker.size": traces.map(t => every ? 6 : hit(t).map(h => h ? 10 : 3)),
      "marker.opacity": traces.map(t => every ? 0.8 : hit(t).map(h => h ? 0.95 : 0.2)),
      "marker.line.width": traces.map(t => every ? 0 : hit(t).map(h => h ? 1.5 : 0)),
    });
  };
  document.getElementById("menus").append(list);
}
"""
