"""The queries of the training-data operators, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptbook.llm import containers, density_groups, name_variants, records, scan_repair, source_mix, spam_pages, term_census, term_weights, text_pieces, tokens, vector_neighbors
from promptbook.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = density_groups.touching_groups(table(spark, d, "cluster_xy"), "character_id", "x", "y")
    return found.select("group_key", F.col("member").alias("character_id"))


SQL["p1_found"] = """
WITH RECURSIVE pts AS (SELECT DISTINCT character_id AS id, x, y FROM cluster_xy WHERE character_id IS NOT NULL AND isfinite(x) AND isfinite(y)),
edges AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
reach(id, other) AS (SELECT id, id FROM pts UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
best AS (SELECT id, min(other) AS group_key, count(*) AS n FROM reach GROUP BY id)
SELECT group_key, id AS character_id FROM best WHERE n >= 20
"""


_GROUPS = SQL["p1_found"].replace("SELECT group_key, id AS character_id FROM best WHERE n >= 20", "")


@query
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return density_groups.describe_groups(density_groups.touching_groups(table(spark, d, "cluster_xy"), "character_id", "x", "y"))


# A cell is 0.35 wide, so the five densest cells of a group and the members nearest to its centre in each follow from the groups
SQL["p1_groups"] = _GROUPS + """,
m AS (SELECT b.group_key, b.n, p.id, p.x, p.y, floor(p.x / 0.35)::BIGINT AS cx, floor(p.y / 0.35)::BIGINT AS cy FROM best b JOIN pts p USING (id) WHERE b.n >= 20),
centre AS (SELECT group_key, avg(x) AS mx, avg(y) AS my FROM m GROUP BY 1),
cells AS (SELECT group_key, cx, cy, row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, cx, cy) AS r FROM m GROUP BY 1, 2, 3),
near AS (SELECT m.group_key, m.id, r, row_number() OVER (PARTITION BY m.group_key, m.cx, m.cy ORDER BY (x - mx) * (x - mx) + (y - my) * (y - my), id) AS w FROM m JOIN cells USING (group_key, cx, cy) JOIN centre USING (group_key) WHERE r <= 5),
top AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY r, w) AS o FROM near WHERE w <= 5),
typical AS (SELECT group_key, string_agg(id, ' | ' ORDER BY o) AS typical FROM top WHERE o <= 5 GROUP BY 1)
SELECT group_key, max(n) AS n_members, any_value(typical) AS typical FROM best JOIN typical USING (group_key) WHERE n >= 20 GROUP BY 1
"""


def _census(spark: SparkSession, d: str, **kw) -> DataFrame:
    speech, top = records.speeches(spark, d), records.labels(spark, d)
    counts = term_census.term_census({"speech_text": (speech.select("speech_text"), "words"), "top_words": (top.select("top_words"), "entries")}, **kw)
    chars = records.speakers(spark, d)
    clusters = table(spark, d, "cluster_labels").where("top_words is not null").agg(F.countDistinct("cluster").alias("total"))
    totals = chars.select(F.lit("speech_text").alias("field"), "total").unionByName(clusters.select(F.lit("top_words").alias("field"), "total"))
    return term_census.mark_terms(counts, totals)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _census(spark, d).where("mark is not null").select("field", "term", "mark")


@query
def p2_census(spark: SparkSession, d: str) -> DataFrame:
    return _census(spark, d).select("field", "term", "n_total", "n_records", "total", "mark")


@query
def p2_census_tight(spark: SparkSession, d: str) -> DataFrame:
    """The same with a budget for executors with next to no memory, so that it spills at any size."""
    return _census(spark, d, budget=4096).select("field", "term", "n_total", "n_records", "total", "mark")


_TERMS = r"""
docs AS (SELECT character_id AS id, max(speech_text) AS t FROM character_documents WHERE speech_text IS NOT NULL AND character_id IS NOT NULL GROUP BY 1),
words AS (SELECT id, term FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS term FROM docs) WHERE regexp_full_match(term, '[a-z]{3,}'))"""
_CENSUS = f"""
WITH {_TERMS},
entries AS (SELECT cluster AS id, trim(lower(e), chr(32) || chr(9) || chr(10) || chr(13)) AS term FROM (SELECT DISTINCT cluster, unnest(string_split(top_words, ',')) AS e FROM cluster_labels) WHERE trim(e, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
counts AS (SELECT 'speech_text' AS field, term, count(*) AS n_total, count(DISTINCT id) AS n_records, (SELECT count(*) FROM docs) AS total FROM words GROUP BY term
  UNION ALL SELECT 'top_words', term, count(*), count(DISTINCT id), (SELECT count(DISTINCT cluster) FROM cluster_labels WHERE top_words IS NOT NULL) FROM entries GROUP BY term),
marked AS (SELECT *, 'rare' AS mark FROM counts WHERE n_records <= 2 UNION ALL SELECT *, 'common' FROM counts WHERE n_records * 100 > total * 56)
"""
SQL["p2_found"] = _CENSUS + "SELECT field, term, mark FROM marked"
SQL["p2_census"] = SQL["p2_census_tight"] = _CENSUS + "SELECT c.*, m.mark FROM counts c LEFT JOIN (SELECT field, term, mark FROM marked) m USING (field, term)"


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored = term_weights.log_entropy(records.speeches(spark, d), "character_id", "speech_text", records.speakers(spark, d))
    return scored.where("tf >= 4 and df <= 5").select(F.col("id").alias("character_id"), "term")


SQL["p4_found"] = f"""
WITH {_TERMS},
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT id AS character_id, term FROM tf JOIN df USING (term) WHERE tf >= 4 AND df <= 5
"""


@query
def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = term_weights.log_entropy(records.speeches(spark, d), "character_id", "speech_text", records.speakers(spark, d))
    return scored.select(F.col("id").alias("character_id"), "term", "tf", "df", F.round("score", 6).alias("score"))


SQL["p4_scores"] = f"""
WITH {_TERMS},
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS gf, sum(tf * ln(tf)) AS tl FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM docs)
SELECT id AS character_id, term, tf, df, round(ln(1 + tf) * (1 - (ln(gf) - tl / gf) / ln(n)), 6) AS score FROM tf JOIN st USING (term) CROSS JOIN n
"""


def _limit(spark: SparkSession, d: str, task: str) -> tuple[int, int]:
    """Limit and overlap of a task: one row of a fixed table."""
    row = table(spark, d, "size_limits").where(F.col("task") == task).agg(F.max("max_size").alias("m"), F.max("overlap").alias("o")).first()
    return row.m, row.o or 0


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "speech_pieces")
    return text_pieces.pieces(records.speeches(spark, d), "character_id", "speech_text", limit, overlap)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select(F.col("id").alias("character_id"))


SQL["p7_found"] = "SELECT DISTINCT character_id FROM character_documents WHERE length(speech_text) > (SELECT max(max_size) FROM size_limits WHERE task = 'speech_pieces')"


@query
def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("id", "character_id")


def _dim(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings_metadata").agg(F.max("dim")).first()[0]


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbors.nearest(table(spark, d, "character_vectors"), "character_id", "embedding", _dim(spark, d), 5, 0.85)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


_NEAREST = """
WITH v AS (SELECT character_id AS id, max(embedding) AS e FROM character_vectors WHERE len(embedding) = (SELECT max(dim) FROM embeddings_metadata)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
u AS (SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM v),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM u a JOIN u b ON a.id <> b.id),
best AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c WHERE s >= 0.85) WHERE r <= 5)
"""
SQL["p5_found"] = _NEAREST + "SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best"


@query
def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = vector_neighbors.exact_cosines(_neighbours(spark, d), table(spark, d, "character_vectors"), "character_id", "embedding", _dim(spark, d))
    return near.select(F.col("id").alias("character_id"), "neighbour", F.round("cosine", 6).alias("cosine"))


SQL["p5_neighbours"] = _NEAREST.replace("AS (SELECT a, b FROM (SELECT a, b, row", "AS (SELECT a, b, s FROM (SELECT a, b, s, row") + "SELECT a AS character_id, b AS neighbour, round(s, 6) AS cosine FROM best"


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_pages(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


@query
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_shares(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id").withColumn("spam_share", F.round("spam_share", 6))


#: Segments and loss-bearing tokens that a container of problem 8 holds at most; its tokens come from size_limits. The
#: table has no prompts: the first sentence or line of a text stands for one and bears no loss (``tokens.PROMPT``).
MAX_SEGMENTS, MAX_LOSS_SHARE = 24, 63 / 64


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limit(spark, d, "containers")
    sizes = tokens.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return containers.fill_containers(sizes, capacity, MAX_SEGMENTS, int(capacity * MAX_LOSS_SHARE)).withColumnRenamed("id", "doc_id")


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limit(spark, d, "containers")
    used = p8_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("segments"), F.sum("n_loss").alias("loss"), F.bool_or("over_loss").alias("over"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("segments").alias("most_segments"), F.max("n").alias("most_tokens"), F.max(F.when(~F.col("over"), F.col("loss"))).alias("most_loss"), F.count_if("over").alias("n_over_loss"), F.round(F.avg(F.col("n") / capacity), 4).alias("fill"))


def _draws(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    listed = F.broadcast(targets.select(F.lower(F.trim("source")).alias("s")).distinct())  # one row per listed source
    docs = table(spark, d, "documents").join(listed, F.lower(F.trim("source")) == F.col("s"), "left_semi")
    keyed = docs.select(F.struct("doc_id", "source", source_mix.text_key("text").alias("key")).alias("row"), "text")
    sized = tokens.token_sizes(keyed, "row", "text").select(F.col("id.doc_id").alias("id"), "id.source", "id.key", "n_tokens")
    return source_mix.mix_sources(sized, targets)


@query
def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).withColumnRenamed("id", "doc_id")


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.shares(_draws(spark, d), table(spark, d, "mix_targets"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(name_variants.link_names(table(spark, d, "character_table"), table(spark, d, "catalogue")))


@query
def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.link_names(table(spark, d, "character_table"), table(spark, d, "catalogue"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.find_repairs(table(spark, d, "character_table"), table(spark, d, "character_documents"), table(spark, d, "metadata"))
