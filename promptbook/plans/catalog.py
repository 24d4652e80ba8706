"""The queries of the engine's own operators, and the SQL that says the same.

Every query reads whole tables. The SQL is written for an engine with RE2 expressions, lambda lists and
``string_agg``; columns have the same names on both sides.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptbook import config
from promptbook.functions import text as T
from promptbook.functions.matching import ratio
from promptbook.functions.roles import parse_roles
from promptbook.operators import characters, clusters, density, documents, embedding, excerpts, facets, pipeline, reduction, reports, vectors
from promptbook.plans.lineage import cut, cut_table
from promptbook.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- tables, each record once
DOC = "character_id tcp brit_drama_number display_name normalized_name raw_names title author year date_decade date_first_performance genre play_type theater theater_type company role_description match_score n_chars n_words".split()


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Characters without repeated rows, with the columns asked for (all but the text by default)."""
    wanted = dict.fromkeys(["character_id", *(columns or DOC)])
    return table(spark, d, "character_documents").where("character_id is not null").select(*wanted).distinct()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "character_documents").where("character_id is not null and speech_text is not null")
    return rows.groupBy("character_id").agg(F.max("speech_text").alias("speech_text"))


def _xy(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Map positions, each character at its latest load, with just the columns asked for."""
    return clusters.latest(table(spark, d, "cluster_xy").select("character_id", "loaded_at", *columns), "character_id")


def _members(spark: SparkSession, d: str, *columns: str, place: tuple[str, ...] = ("x", "y", "cluster", "topic_label", "top_words")) -> DataFrame:
    """Characters with the columns asked for and what ``place`` names of their map position."""
    at = _xy(spark, d, *place).drop("loaded_at").where("cluster is not null")
    return _docs(spark, d, *columns).join(at, "character_id")


def _speeches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of character_table as speeches under a prefix, each row once."""
    rows = table(spark, d, "character_table").where("row_id is not null and tcp is not null and normalized_name is not null")
    return rows.groupBy("row_id").agg(F.max(F.struct("tcp", "normalized_name", "speech_text")).alias("r")).select("r.tcp", F.col("row_id").alias("pos"), F.col("r.normalized_name").alias("prefix"), F.coalesce("r.speech_text", F.lit("")).alias("text"))


def _raw_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "character_table").select("tcp", F.explode(F.split("raw_names", r" \| ")).alias("raw"))
    return names.where("tcp is not null").distinct()


_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_collapse = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"
_strip = lambda c: f"regexp_replace(regexp_replace({c}, '^{_WS}', ''), '{_WS}$', '')"
_clean = lambda c: _collapse(f"replace(coalesce({c}, ''), '•', ' ')")
_words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{_WS}'), lambda t: t <> ''))"
_escape = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_NORM = lambda c: f"lower({_collapse(f'''regexp_replace(replace(replace({c}, 'ſ', 's'), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', ' ', 'g')''')})"
_DOCS_SQL = f"docs AS (SELECT DISTINCT {', '.join(DOC)} FROM character_documents WHERE character_id IS NOT NULL)"
_TEXTS_SQL = "texts AS (SELECT character_id, max(speech_text) AS speech_text FROM character_documents WHERE character_id IS NOT NULL AND speech_text IS NOT NULL GROUP BY 1)"
_XY_SQL = "xy AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY loaded_at DESC) AS r FROM cluster_xy WHERE character_id IS NOT NULL) WHERE r = 1)"
_MEMBERS_SQL = f"{_DOCS_SQL}, {_XY_SQL}, m AS (SELECT docs.*, xy.x, xy.y, xy.cluster, xy.topic_label, xy.top_words FROM docs JOIN xy USING (character_id) WHERE xy.cluster IS NOT NULL)"
_SPEECH_SQL = "sp AS (SELECT row_id AS pos, any_value(tcp) AS tcp, any_value(normalized_name) AS prefix, coalesce(max(speech_text), '') AS text FROM character_table WHERE row_id IS NOT NULL AND tcp IS NOT NULL AND normalized_name IS NOT NULL GROUP BY row_id)"


# ---------------------------------------------------------------- text and derived columns
@query(f"WITH {_SPEECH_SQL} SELECT pos AS row_id, length({_clean('text')}) AS n_chars, {_words(_clean('text'))} AS n_words, md5({_clean('text')}) AS digest FROM sp")
def clean_text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.clean_speech(F.col("text"))
    return _speeches(spark, d).select(F.col("pos").alias("row_id"), F.length(t).cast("long").alias("n_chars"), T.n_words(t).alias("n_words"), F.md5(t).alias("digest"))


@query(f"SELECT DISTINCT normalized_name, {_NORM('normalized_name')} AS norm FROM character_table WHERE normalized_name IS NOT NULL")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "character_table").select("normalized_name").where("normalized_name is not null").distinct()
    return names.select("normalized_name", T.normalize_for_match(F.col("normalized_name")).alias("norm"))


@query(f"SELECT DISTINCT tcp, title, {_collapse('title')} AS title_clean, {_collapse('plot')} AS plot_clean FROM metadata")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata").select("tcp", "title", T.collapse(F.col("title")).alias("title_clean"), T.collapse(F.col("plot")).alias("plot_clean")).distinct()


@query(f"SELECT DISTINCT tcp, normalized_name, CASE WHEN normalized_name = '__crowd__' THEN '[crowd]' ELSE {_strip('upper(normalized_name)')} END AS display_name, tcp || '::' || CASE WHEN normalized_name = '__crowd__' THEN '[crowd]' ELSE {_strip('upper(normalized_name)')} END AS character_id FROM character_table WHERE normalized_name IS NOT NULL")
def display_name_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "character_table").select("tcp", "normalized_name").where("normalized_name is not null").distinct()
    rows = rows.withColumn("display_name", T.display_name(F.col("normalized_name")))
    return rows.withColumn("character_id", T.character_id(F.col("tcp"), F.col("display_name")))


@query(f"SELECT character_id, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 240), ' [^ ]*$', '') || '…' END AS short FROM (SELECT character_id, {_collapse('max(speech_text)')} AS t FROM character_documents WHERE character_id IS NOT NULL AND speech_text IS NOT NULL GROUP BY 1)")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("character_id", T.truncate(F.col("speech_text"), 240).alias("short"))


@query(f"SELECT DISTINCT tcp, {_escape('title')} AS title, {_escape('plot')} AS plot FROM metadata")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata").select("tcp", T.html_escape(F.col("title")).alias("title"), T.html_escape(F.col("plot")).alias("plot")).distinct()


_shown = lambda c: f"CASE WHEN {_strip(c)} <> '' THEN {_escape(c)} END"


@query(f"WITH {_DOCS_SQL} SELECT character_id, concat_ws(' · ', {_shown('author')}, year::VARCHAR, {_shown('genre')}, {_shown('company')}, {_shown('theater')}) AS meta FROM docs")
def meta_line(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _docs(spark, d, "author", "year", "genre", "company", "theater").select("character_id", T.meta_line(c("author"), c("year"), c("genre"), c("company"), c("theater")).alias("meta"))


@query(f"SELECT DISTINCT cluster, list_transform(list_filter(list_transform(string_split(coalesce(top_words, ''), ','), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: x) AS words FROM cluster_labels")
def top_word_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cluster_labels").select("cluster", T.top_words(F.col("top_words")).alias("words")).distinct()


_ROLE = r"\b[A-Za-z]*[A-Z]{3,}[A-Za-z''.\-]*(?:\s+[A-Za-z]*[A-Z]{3,}[A-Za-z''.\-]*)*\b"
_DESCRIPTION = _strip(f"ltrim({_strip('part')}, ',;')")


def _roles_sql(rows: str) -> str:
    """CTEs down to ``roles_read(tcp, role_pos, name, description)`` from ``rows``, a query of (tcp, roles)."""
    return f"""given AS ({rows}), cut AS (SELECT tcp, roles, regexp_extract_all(roles, '{_ROLE}') AS names, regexp_split_to_array(roles, '{_ROLE}') AS parts FROM given WHERE roles IS NOT NULL),
numbered AS (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM cut),
single AS (SELECT tcp, roles, i, {_strip('names[i]')} AS name, parts[i + 1] AS part FROM numbered),
real AS (SELECT tcp, roles, i, name, {_DESCRIPTION} AS d FROM single WHERE NOT regexp_full_match(replace(name, ' ', ''), '[IVXLCM]+') AND replace(name, ' ', '') NOT IN ('ACT', 'SCENE', 'PAGE')),
roles_read AS (SELECT tcp, row_number() OVER (PARTITION BY tcp, roles ORDER BY i) - 1 AS role_pos, name, CASE WHEN length(d) <= 400 THEN d ELSE regexp_replace(left(d, 400), ' [^ ]*$', '') || '…' END AS description FROM real)"""


_SLUG = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(character_id, '::', '__'), 'ſ', 's'), '[^\p{L}\p{N}_\-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"WITH s AS (SELECT DISTINCT character_id, {_SLUG} AS slug FROM character_documents WHERE character_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY lower(slug) ORDER BY character_id) AS n FROM s) SELECT character_id, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS slug FROM n")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return reports.unique_slugs(_docs(spark, d, "character_id")).select("character_id", "slug")


@query(f"WITH {_roles_sql('SELECT DISTINCT tcp, roles FROM catalogue')} SELECT DISTINCT tcp, role_pos, name, description FROM roles_read")
def roles_parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "catalogue").select("tcp", "roles").distinct()
    return rows.select("tcp", F.posexplode(parse_roles("roles")).alias("role_pos", "r")).select("tcp", "role_pos", "r.name", "r.description").distinct()


# ---------------------------------------------------------------- from speeches to characters
_GENERIC = ", ".join(f"'{g}'" for g in config.GENERIC_LABELS)


@query(f"SELECT tcp, raw, {_NORM('raw')} IN ({_GENERIC}) AS is_group FROM (SELECT DISTINCT tcp, unnest(string_split(raw_names, ' | ')) AS raw FROM character_table WHERE tcp IS NOT NULL) WHERE {_NORM('raw')} <> ''")
def generic_label_route(spark: SparkSession, d: str) -> DataFrame:
    norm = T.normalize_for_match(F.col("raw"))
    return _raw_names(spark, d).withColumn("norm", norm).where("norm <> ''").select("tcp", "raw", F.col("norm").isin(*config.GENERIC_LABELS).alias("is_group"))


@query("SELECT CASE WHEN match_score >= 92 THEN 'merge' WHEN match_score >= 70 THEN 'review' ELSE 'raw' END AS route, count(*) AS n, min(match_score) AS lowest, max(match_score) AS highest FROM (SELECT DISTINCT row_id, match_score FROM character_table) GROUP BY 1")
def score_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "character_table").select("row_id", "match_score").distinct()
    route = F.when(F.col("match_score") >= config.AUTO_MERGE, "merge").when(F.col("match_score") >= config.REVIEW, "review").otherwise("raw")
    return rows.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.min("match_score").alias("lowest"), F.max("match_score").alias("highest"))


@query(f"WITH {_SPEECH_SQL}, j AS (SELECT tcp, prefix AS normalized_name, {_clean('string_agg(text, chr(32) ORDER BY pos)')} AS t, count(*) AS n_parts FROM sp GROUP BY 1, 2) SELECT tcp, normalized_name, n_parts, length(t) AS n_chars, {_words('t')} AS n_words, md5(t) AS digest FROM j")
def speech_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _speeches(spark, d).select("tcp", "pos", "prefix", "text", F.col("prefix").alias("resolved"), F.lit("").alias("role_description"), F.lit(0).alias("match_score"))
    parts = rows.groupBy("tcp", F.col("resolved").alias("normalized_name")).agg(F.count("*").alias("n_parts"))
    return characters.rollup(rows).join(parts, ["tcp", "normalized_name"]).select("tcp", "normalized_name", "n_parts", "n_chars", "n_words", F.md5("speech_text").alias("digest"))


@query(f"WITH {_SPEECH_SQL}, j AS (SELECT tcp, prefix AS normalized_name, {_clean('string_agg(text, chr(32) ORDER BY pos)')} AS t FROM sp GROUP BY 1, 2) SELECT tcp, count(*) FILTER (length(t) >= 200) AS n_kept, count(*) FILTER (length(t) < 200) AS n_dropped FROM j GROUP BY 1")
def min_length_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _speeches(spark, d).select("tcp", "pos", "prefix", "text", F.col("prefix").alias("resolved"), F.lit("").alias("role_description"), F.lit(0).alias("match_score"))
    return characters.rollup(rows).groupBy("tcp").agg(F.count_if(characters.is_kept()).alias("n_kept"), F.count_if(~characters.is_kept()).alias("n_dropped"))


@query("SELECT count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown FROM (SELECT tcp, tcp IN (SELECT tcp FROM catalogue WHERE tcp IS NOT NULL) AS known FROM (SELECT DISTINCT tcp FROM character_table WHERE tcp IS NOT NULL))")
def semi_anti_known_plays(spark: SparkSession, d: str) -> DataFrame:
    plays = table(spark, d, "character_table").select("tcp").where("tcp is not null").distinct()
    catalogue = table(spark, d, "catalogue").where("tcp is not null")
    known = characters.known_plays(plays, catalogue).select(F.lit(1).alias("k"))
    unknown = characters.known_plays(plays, catalogue, "left_anti").select(F.lit(0).alias("k"))
    return known.unionByName(unknown).agg(F.count_if(F.col("k") == 1).alias("n_known"), F.count_if(F.col("k") == 0).alias("n_unknown"))


@query("SELECT tcp, roles FROM (SELECT tcp, roles, row_number() OVER (PARTITION BY tcp ORDER BY roles NULLS FIRST) AS r FROM catalogue WHERE tcp IS NOT NULL) WHERE r = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return characters.first_by(table(spark, d, "catalogue").select("tcp", "roles").where("tcp is not null"), "tcp", "roles")


_FIRST_ROLES = "SELECT tcp, roles FROM (SELECT tcp, roles, row_number() OVER (PARTITION BY tcp ORDER BY roles NULLS FIRST) AS r FROM catalogue WHERE tcp IS NOT NULL) WHERE r = 1"
_LCS = """list_reduce(list_transform(string_split(sa, ''), lambda c: list_transform(string_split(sb, ''), lambda e: (c = e)::BIGINT)),
    lambda row, m: list_transform(range(1, len(m) + 1), lambda j: greatest(row[j], list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 ELSE row[k - 1] END + m[k])))),
    list_transform(string_split(sb, ''), lambda e: 0::BIGINT))[-1]"""
_RAW_PREFIXES = f"SELECT DISTINCT tcp, {_NORM('raw')} AS norm FROM (SELECT DISTINCT tcp, unnest(string_split(raw_names, ' | ')) AS raw FROM character_table WHERE tcp IS NOT NULL) WHERE {_NORM('raw')} <> ''"


def _ratio_sql(prefixes: str) -> str:
    """CTEs down to ``ratios``, the set-of-words ratio of every normalised prefix with every role of its play (longest
    common subsequences row by row), and ``best``, the best role of each prefix."""
    return f"""{_roles_sql(_FIRST_ROLES)},
roles_norm AS (SELECT tcp, role_pos, name AS role, description, {_NORM('name')} AS role_norm FROM roles_read),
prefixes AS ({prefixes}),
pairs AS (SELECT DISTINCT norm, role_norm, list_distinct(string_split(norm, ' ')) AS x, list_distinct(string_split(role_norm, ' ')) AS y FROM prefixes JOIN roles_norm USING (tcp)),
sets AS (SELECT *, list_filter(x, lambda t: list_contains(y, t)) AS shared, list_filter(x, lambda t: NOT list_contains(y, t)) AS ox, list_filter(y, lambda t: NOT list_contains(x, t)) AS oy FROM pairs),
joined AS (SELECT *, array_to_string(list_sort(ox), ' ') AS sa, array_to_string(list_sort(oy), ' ') AS sb, length(array_to_string(shared, ' ')) AS l, (len(shared) > 0)::INT AS gap FROM sets),
common AS (SELECT sa, sb, {_LCS} AS lcs FROM (SELECT DISTINCT sa, sb FROM joined WHERE sa <> '' AND sb <> '')),
ratios AS (SELECT norm, role_norm, CASE WHEN role_norm = '' THEN 0.0::DOUBLE WHEN gap = 1 AND (sa = '' OR sb = '') THEN 100.0::DOUBLE
    WHEN gap = 0 THEN 100 * (1 - (length(sa) + length(sb) - 2 * lcs)::DOUBLE / (length(sa) + length(sb)))
    ELSE greatest(100 * (1 - (length(sa) + length(sb) - 2 * lcs)::DOUBLE / (2 * l + 2 + length(sa) + length(sb))), 100 * (1 - (1 + length(sa))::DOUBLE / (2 * l + 1 + length(sa))), 100 * (1 - (1 + length(sb))::DOUBLE / (2 * l + 1 + length(sb)))) END AS score
    FROM joined LEFT JOIN common USING (sa, sb)),
ranked AS (SELECT tcp, norm, role, description, floor(score)::INT AS score, row_number() OVER (PARTITION BY tcp, norm ORDER BY floor(score) DESC, role_pos) AS r FROM prefixes JOIN roles_norm USING (tcp) JOIN ratios USING (norm, role_norm)),
best AS (SELECT tcp, norm, role, description, score FROM ranked WHERE r = 1)"""


_RATIO_SQL = _ratio_sql(_RAW_PREFIXES)

@query(f"WITH {_RATIO_SQL} SELECT DISTINCT tcp, norm, role_norm, round(score, 6) AS score FROM prefixes JOIN roles_norm USING (tcp) JOIN ratios USING (norm, role_norm)")
def token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    names = _raw_names(spark, d).select("tcp", T.normalize_for_match(F.col("raw")).alias("norm")).where("norm <> ''").distinct()
    pairs = names.join(characters.listed_roles(table(spark, d, "catalogue")), "tcp")
    return pairs.select("tcp", "norm", "role_norm", F.round(ratio("norm", "role_norm"), 6).alias("score")).distinct()


@query(f"WITH {_RATIO_SQL} SELECT * FROM best")
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    names = _raw_names(spark, d).select("tcp", T.normalize_for_match(F.col("raw")).alias("norm")).where("norm <> ''")
    return characters.best_matches(names, characters.listed_roles(table(spark, d, "catalogue")))


def _resolved_sql(speeches: str) -> str:
    """CTEs down to ``rolled``, one row per play and resolved name of ``speeches``, a query of (tcp, pos, prefix, text)."""
    return f"""{_SPEECH_SQL}, said AS ({speeches}), named AS (SELECT *, norm IN ({_GENERIC}) AS crowd FROM (SELECT tcp, pos, prefix, text, {_NORM('prefix')} AS norm FROM said) WHERE norm <> ''),
{_ratio_sql("SELECT DISTINCT tcp, norm FROM named WHERE NOT crowd")},
scored AS (SELECT named.*, CASE WHEN crowd THEN 100 ELSE coalesce(score, 0) END AS match_score, role, description FROM named LEFT JOIN best USING (tcp, norm)),
resolved AS (SELECT *, CASE WHEN crowd THEN '{config.CROWD}' WHEN match_score >= {config.AUTO_MERGE} THEN role ELSE prefix END AS normalized_name, CASE WHEN NOT crowd AND match_score >= {config.REVIEW} THEN coalesce(description, '') ELSE '' END AS about FROM scored),
rolled AS (SELECT tcp, normalized_name, string_agg(DISTINCT prefix, ' | ' ORDER BY prefix) AS raw_names, first(about ORDER BY length(about) DESC, pos) AS role_description, first(match_score ORDER BY pos) AS match_score, {_clean("string_agg(text, ' ' ORDER BY pos)")} AS speech_text FROM resolved GROUP BY 1, 2)"""


_COUNTS_SQL = f"length(speech_text) AS n_chars, {_words('speech_text')} AS n_words"


@query(f"WITH {_resolved_sql('SELECT * FROM sp')} SELECT * EXCLUDE (speech_text), {_COUNTS_SQL} FROM rolled")
def resolved_characters(spark: SparkSession, d: str) -> DataFrame:
    resolved = characters.resolve(_speeches(spark, d), table(spark, d, "catalogue"))
    return characters.rollup(resolved).drop("speech_text")


@query(f"WITH {_resolved_sql('SELECT * FROM sp')} SELECT DISTINCT tcp, prefix AS raw_name, role AS suggested_match, match_score AS score FROM resolved WHERE NOT crowd AND match_score BETWEEN {config.REVIEW} AND {config.AUTO_MERGE - 1}")
def name_review(spark: SparkSession, d: str) -> DataFrame:
    return characters.review_rows(characters.resolve(_speeches(spark, d), table(spark, d, "catalogue")))


_META_ROW = "brit_drama_number title author year date_decade date_first_performance genre play_type theater theater_type company plot".split()
_ONE_PLAY = f"play AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY tcp ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _META_ROW)}) AS r FROM metadata WHERE tcp IS NOT NULL) WHERE r = 1)"
_FLAT = ", ".join(f"{_collapse(c)} AS {c}" for c in [*documents.DESCRIPTIVE, "plot"])
_KNOWN_SPEECHES = "SELECT * FROM sp WHERE tcp IN (SELECT tcp FROM catalogue WHERE tcp IS NOT NULL)"


@query(f"WITH {_resolved_sql(_KNOWN_SPEECHES)}, {_ONE_PLAY}, named_docs AS (SELECT *, CASE WHEN normalized_name = '{config.CROWD}' THEN '[crowd]' ELSE {_strip('upper(normalized_name)')} END AS display_name FROM rolled WHERE length(speech_text) >= {config.MIN_SPEECH_CHARS} AND normalized_name <> '{config.CROWD}') SELECT tcp || '::' || display_name AS character_id, named_docs.*, {_COUNTS_SQL}, brit_drama_number, year, {_FLAT} FROM named_docs LEFT JOIN play USING (tcp)")
def play_documents(spark: SparkSession, d: str) -> DataFrame:
    built, _, _ = pipeline.speeches_to_documents(_speeches(spark, d), table(spark, d, "catalogue"), table(spark, d, "metadata"))
    return built


# ---------------------------------------------------------------- enrichment
_META = "title author year date_decade genre".split()


@query(f"WITH {_DOCS_SQL}, meta AS (SELECT tcp, {', '.join(f'max({c}) AS {c}_meta' for c in _META)} FROM metadata WHERE tcp IS NOT NULL GROUP BY 1) SELECT character_id, {', '.join(f'{c}_meta' for c in _META)} FROM docs LEFT JOIN meta USING (tcp)")
def metadata_left_join(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "metadata").where("tcp is not null").groupBy("tcp").agg(*[F.max(c).alias(f"{c}_meta") for c in _META])
    return _docs(spark, d, "tcp").join(meta, "tcp", "left").select("character_id", *[f"{c}_meta" for c in _META])


_COVERED = "title author year genre play_type theater company role_description".split()


@query(f"WITH {_DOCS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_total, count({c}) AS n_filled, round(100 * count({c}) / count(*), 2) AS pct FROM docs" for c in _COVERED))
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return documents.coverage(_docs(spark, d, *_COVERED), _COVERED)


@query("SELECT count(*) FILTER (a.tcp IS NOT NULL AND b.tcp IS NOT NULL) AS n_both, count(*) FILTER (b.tcp IS NULL) AS n_left_only, count(*) FILTER (a.tcp IS NULL) AS n_right_only FROM (SELECT DISTINCT character_id AS tcp FROM character_documents) a FULL JOIN (SELECT DISTINCT character_id AS tcp FROM character_vectors) b ON a.tcp = b.tcp")
def row_alignment(spark: SparkSession, d: str) -> DataFrame:
    return vectors.alignment(table(spark, d, "character_documents"), table(spark, d, "character_vectors"), "character_id")


@query("SELECT m.tcp, m.brit_drama_number, max(m.title) AS title, count(DISTINCT c.character_id) AS n_characters FROM (SELECT DISTINCT tcp, brit_drama_number, title FROM metadata) m LEFT JOIN (SELECT DISTINCT character_id, brit_drama_number FROM character_documents) c ON m.brit_drama_number = c.brit_drama_number GROUP BY 1, 2")
def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    plays = table(spark, d, "metadata").select("tcp", "brit_drama_number", "title").distinct()
    roles = table(spark, d, "character_documents").select("character_id", "brit_drama_number").distinct()
    return plays.join(roles, "brit_drama_number", "left").groupBy("tcp", "brit_drama_number").agg(F.max("title").alias("title"), F.countDistinct("character_id").alias("n_characters"))


# ---------------------------------------------------------------- clusters
@query(f"WITH {_XY_SQL}, s AS (SELECT cluster, count(*) AS n FROM xy WHERE cluster IS NOT NULL GROUP BY 1) SELECT 'earlier_run' AS preset, sum(n)::BIGINT AS n_total, count(*) FILTER (cluster <> -1) AS \"n_clusters_excl_-1\", coalesce(sum(n) FILTER (cluster = -1), 0)::BIGINT AS n_outliers, round(100 * coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 2) AS outliers_pct, max(n) AS largest_cluster_size, max(n) FILTER (cluster <> -1) AS largest_real_cluster FROM s")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return clusters.summary(_xy(spark, d, "cluster").where("cluster is not null"), "earlier_run")


@query(f"WITH {_XY_SQL} SELECT cluster, count(*) AS n FROM xy WHERE cluster IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def cluster_sizes_top8(spark: SparkSession, d: str) -> DataFrame:
    return clusters.sizes(_xy(spark, d, "cluster").where("cluster is not null"))


_TFIDF_SQL = rf"""
{_TEXTS_SQL}, {_XY_SQL},
t AS (SELECT character_id, xy.cluster, texts.speech_text FROM xy JOIN texts USING (character_id) WHERE xy.cluster IS NOT NULL),
w AS (SELECT character_id, cluster, term FROM (SELECT character_id, cluster, unnest(regexp_extract_all(lower(speech_text), '[\p{{L}}\p{{N}}_]+')) AS term FROM t) WHERE regexp_full_match(term, '[a-z]{{3,}}')),
common AS (SELECT term FROM w GROUP BY 1 HAVING count(DISTINCT character_id) > 0.2 * (SELECT count(*) FROM t)),
tf AS (SELECT cluster, term, count(*) AS tf FROM w WHERE term NOT IN (SELECT term FROM common) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT cluster) AS n FROM t),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT cluster, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n WHERE df >= 2 AND df <= 0.95 * n),
weights AS (SELECT cluster, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS tfidf FROM raw),
top AS (SELECT * FROM (SELECT cluster, term, tfidf, row_number() OVER (PARTITION BY cluster ORDER BY round(tfidf, 9) DESC, term DESC) AS rank FROM weights) WHERE rank <= 10)"""


def _clustered_texts(spark: SparkSession, d: str) -> DataFrame:
    return _xy(spark, d, "cluster").where("cluster is not null").select("character_id", "cluster").join(_texts(spark, d), "character_id")


@query(f"WITH {_TFIDF_SQL} SELECT cluster, term, tf, df, round(tfidf, 6) AS tfidf FROM weights")
def ctfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return clusters.class_tfidf(_clustered_texts(spark, d)).withColumn("tfidf", F.round("tfidf", 6))


@query(f"WITH {_TFIDF_SQL} SELECT cluster, rank, term, round(tfidf, 6) AS tfidf FROM top")
def ctfidf_top_words(spark: SparkSession, d: str) -> DataFrame:
    return clusters.top_terms(clusters.class_tfidf(_clustered_texts(spark, d))).withColumn("tfidf", F.round("tfidf", 6))


_MEMBERS5 = "five AS (SELECT cluster, string_agg(normalized_name, ' | ' ORDER BY r) AS top_characters FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n_chars DESC NULLS LAST, character_id) AS r FROM xy2) WHERE r <= 5 GROUP BY 1)"
_LABELS_SQL = f"{_TFIDF_SQL}, xy2 AS (SELECT * FROM xy WHERE cluster IS NOT NULL), {_MEMBERS5}, words AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS top_words, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS three FROM top GROUP BY 1), c AS (SELECT cluster, count(*) AS n_members FROM xy2 GROUP BY 1), built AS (SELECT cluster, n_members, coalesce(top_words, '') AS top_words, top_characters, CASE WHEN cluster = -1 THEN '-1: outliers' ELSE regexp_replace(cluster || ': ' || coalesce(three, ''), '[: ]+$', '') END AS label FROM c LEFT JOIN words USING (cluster) LEFT JOIN five USING (cluster))"


@query(f"WITH {_LABELS_SQL} SELECT * FROM built")
def cluster_labels_built(spark: SparkSession, d: str) -> DataFrame:
    return clusters.build_labels(_xy(spark, d, "cluster", "n_chars", "normalized_name").where("cluster is not null"), _texts(spark, d))


@query(f"WITH {_XY_SQL}, xy2 AS (SELECT * FROM xy WHERE cluster IS NOT NULL), {_MEMBERS5} SELECT * FROM five")
def top_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.top_members(_xy(spark, d, "cluster", "n_chars", "normalized_name").where("cluster is not null"))


@query(f"WITH {_LABELS_SQL} SELECT xy2.character_id, xy2.cluster, built.label AS topic_label, built.top_words FROM xy2 LEFT JOIN built USING (cluster)")
def label_back_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _xy(spark, d, "cluster", "n_chars", "normalized_name").where("cluster is not null")
    return clusters.join_labels(rows.select("character_id", "cluster"), clusters.build_labels(rows, _texts(spark, d)))


# ---------------------------------------------------------------- facets and histograms
_AUTHOR = f"{_strip('string_split(coalesce(author, ' + chr(39) + '(unknown)' + chr(39) + '), ' + chr(39) + ',' + chr(39) + ')[1]')}"


@query(f"WITH {_MEMBERS_SQL} SELECT cluster, {_AUTHOR} AS author, count(*) AS n FROM m GROUP BY 1, 2")
def author_histogram(spark: SparkSession, d: str) -> DataFrame:
    return facets.author_histogram(_members(spark, d, "author", place=("cluster",)))


@query(f"WITH {_MEMBERS_SQL}, h AS (SELECT cluster, {_AUTHOR} AS author, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, author) AS r, count(*) OVER (PARTITION BY cluster) AS a FROM h) SELECT cluster, string_agg(concat_ws(' ', CASE WHEN {_strip('author')} = '' THEN '(unknown)' ELSE author END, n::VARCHAR), '; ' ORDER BY r) AS tags, greatest(max(a) - 18, 0) AS more FROM r WHERE r <= 18 GROUP BY 1")
def author_tags_topn(spark: SparkSession, d: str) -> DataFrame:
    return facets.author_tags(facets.author_histogram(_members(spark, d, "author", place=("cluster",))))


_DECADE_ORDER = "(lower(decade) = 'unknown'), CASE WHEN regexp_full_match(regexp_replace(decade, 's+$', ''), '[0-9]{1,9}') THEN regexp_replace(decade, 's+$', '')::BIGINT ELSE 1000000000 END, decade"


@query(f"WITH {_MEMBERS_SQL}, h AS (SELECT cluster, coalesce(date_decade, 'Unknown') AS decade, count(*) AS n FROM m GROUP BY 1, 2) SELECT cluster, decade, n, greatest(1, round_even(220.0 * n / max(n) OVER (PARTITION BY cluster), 0)::INT) AS width, row_number() OVER (PARTITION BY cluster ORDER BY {_DECADE_ORDER}) AS place FROM h")
def decade_bars(spark: SparkSession, d: str) -> DataFrame:
    return facets.decade_bars(_members(spark, d, "date_decade", place=("cluster",)))


@query(f"WITH {_MEMBERS_SQL} SELECT cluster, count(*) AS n, count(DISTINCT tcp) AS n_plays, min(year) AS first_year, max(year) AS last_year, trunc(median(year))::INT AS median_year FROM m GROUP BY 1")
def year_stats(spark: SparkSession, d: str) -> DataFrame:
    return facets.year_stats(_members(spark, d, "tcp", "year", place=("cluster",)))


_AXES_SQL = " UNION ".join(f"SELECT '{n}' AS axis, {'1' if c == 'date_decade' else '0'} AS dated, {c} AS decade FROM m" for c, n in facets.AXES)


@query(f"WITH {_MEMBERS_SQL}, v AS ({_AXES_SQL}), k AS (SELECT * FROM v WHERE decade IS NOT NULL AND {_strip('decade')} <> '' AND lower(decade) <> 'unknown') SELECT axis, decade AS value, row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN dated = 1 AND regexp_full_match(regexp_replace(decade, 's+$', ''), '[0-9]{{1,9}}') THEN regexp_replace(decade, 's+$', '')::BIGINT WHEN dated = 1 THEN 1000000000 END, decade) AS place FROM k")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_values(_members(spark, d, *[c for c, _ in facets.AXES], place=("cluster",)))


@query(f"WITH {_MEMBERS_SQL}, h AS (SELECT character_id, coalesce(genre = 'Tragedy', false) AS hit FROM m) SELECT character_id, hit, CASE WHEN hit THEN 10 ELSE 3 END AS size, CASE WHEN hit THEN 0.95::DOUBLE ELSE 0.20::DOUBLE END AS opacity, CASE WHEN hit THEN 1.5::DOUBLE ELSE 0::DOUBLE END AS line_width, CASE WHEN hit THEN 'black' ELSE 'rgba(0,0,0,0)' END AS line_color FROM h")
def facet_mask(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_mask(_members(spark, d, "genre", place=("cluster",)), "genre", "Tragedy")


_seen = lambda c: f"CASE WHEN {_strip(c)} <> '' AND lower({_strip(c)}) NOT IN ('nan', 'none', 'unknown') THEN {_strip(c)} END"
_NAME = f"coalesce(CASE WHEN {_strip('display_name')} <> '' THEN display_name END, normalized_name)"
_DATE = f"coalesce(CASE WHEN {_strip('date_first_performance')} <> '' THEN date_first_performance END, year::VARCHAR)"
_HOVER = ", ".join(
    [f"'{k}: ' || {_seen(c)}" for k, c in (("Play", "title"), ("Author", "author"), ("Date", _DATE), ("Decade", "date_decade"), ("Genre", "genre"), ("Play type", "play_type"), ("Theater", "theater"), ("Company", "company"), ("Character", _NAME))]
    + [f"CASE WHEN {_seen(_NAME)} IS NOT NULL AND {_strip('coalesce(raw_names, ' + chr(39) * 2 + ')')} NOT IN ('', {_strip(_NAME)}) THEN '  (raw: ' || {_strip('raw_names')} || ')' END"]
    + [f"'{k}: ' || {_seen(c)}" for k, c in (("Role", "role_description"), ("Cluster", "coalesce(topic_label, '-1: outliers')"), ("Top words", "top_words"))]
)


@query(f"WITH {_MEMBERS_SQL} SELECT character_id, concat_ws('<br>', {_HOVER}) AS hover FROM m")
def hover_text(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("character_id", facets.hover_text().alias("hover"))


_PALETTE_SQL = "[" + ", ".join(f"'{c}'" for c in facets.PALETTE) + "]"


@query(f"WITH {_MEMBERS_SQL}, l AS (SELECT DISTINCT coalesce(topic_label, '-1: outliers') AS topic_label FROM m), p AS (SELECT topic_label, row_number() OVER (ORDER BY coalesce(try_cast({_strip('string_split(topic_label, ' + chr(39) + ':' + chr(39) + ')[1]')} AS BIGINT), 1000000000), topic_label) - 1 AS place FROM l) SELECT topic_label, place, CASE WHEN topic_label = '-1: outliers' THEN 'lightgrey' ELSE {_PALETTE_SQL}[place % {len(facets.PALETTE)} + 1] END AS colour FROM p")
def color_assignment(spark: SparkSession, d: str) -> DataFrame:
    return facets.colours(_members(spark, d, "character_id", place=("cluster", "topic_label")))


@query(f"WITH {_MEMBERS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY cluster, tcp ORDER BY n_words DESC NULLS LAST, character_id) AS r FROM m) SELECT cluster, tcp, character_id, year, row_number() OVER (PARTITION BY cluster ORDER BY year NULLS LAST, tcp) AS place FROM o WHERE r = 1")
def plays_in_cluster(spark: SparkSession, d: str) -> DataFrame:
    return facets.plays_of(_members(spark, d, "tcp", "n_words", "year", place=("cluster",))).select("cluster", "tcp", "character_id", "year", "place")


@query(f"WITH {_MEMBERS_SQL} SELECT cluster, character_id, n_words, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n_words DESC NULLS LAST, character_id) AS place FROM m) WHERE place <= 40")
def longest_40(spark: SparkSession, d: str) -> DataFrame:
    return facets.longest(_members(spark, d, "n_words", place=("cluster",))).select("cluster", "character_id", "n_words", "place")


# ---------------------------------------------------------------- vectors
_VEC_SQL = "v AS (SELECT character_id AS id, max(embedding) AS e FROM character_vectors WHERE character_id IS NOT NULL AND len(embedding) = (SELECT max(dim) FROM embeddings_metadata) AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1), u AS (SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM v)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "embeddings_metadata").agg(F.max("dim")).first()[0]
    return vectors.valid(table(spark, d, "character_vectors"), "character_id", "embedding", dim)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return vectors.valid(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("id", F.col("id").cast("string"))


@query(f"WITH {_VEC_SQL} SELECT id, list_transform(e, lambda x: round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6)) AS unit FROM u")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", F.transform(vectors.l2_normalize(F.col("v")), lambda x: F.round(x, 6)).alias("unit"))


_KNN_SQL = "u AS (SELECT vec_id::VARCHAR AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), k AS (SELECT id, neighbour, distance, rank FROM (SELECT a.id, b.id AS neighbour, greatest(0, 1 - list_cosine_similarity(a.e, b.e)) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(greatest(0, 1 - list_cosine_similarity(a.e, b.e)), 9), b.id) AS rank FROM u a JOIN u b ON a.id <> b.id) WHERE rank <= 15)"


@query(f"WITH {_KNN_SQL} SELECT id, neighbour, round(distance, 6) AS distance, rank FROM k")
def cosine_knn15(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(_stored(spark, d), 15).select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_KNN_SQL} SELECT id, round(max(distance), 6) AS core FROM k WHERE rank <= 10 GROUP BY 1")
def core_distance(spark: SparkSession, d: str) -> DataFrame:
    return vectors.core_distances(vectors.knn(_stored(spark, d), 15), 10).select("id", F.round("core", 6).alias("core"))


@query(f"WITH {_KNN_SQL}, c AS (SELECT id, max(distance) AS core FROM k WHERE rank <= 10 GROUP BY 1), e AS (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, min(distance) AS d FROM k GROUP BY 1, 2) SELECT a, b, round(greatest(d, ca.core, cb.core), 6) AS weight FROM e JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b")
def mutual_reachability(spark: SparkSession, d: str) -> DataFrame:
    near = cut(vectors.knn(_stored(spark, d), 15))
    return vectors.mutual_reachability(near, vectors.core_distances(near, 10)).withColumn("weight", F.round("weight", 6))


_CHARACTER_KNN_SQL = _VEC_SQL + ", k AS" + _KNN_SQL.split(", k AS", 1)[1]


@query(f"WITH {_CHARACTER_KNN_SQL} SELECT id, neighbour, round(distance, 6) AS distance, rank FROM k")
def character_knn15(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(_vectors(spark, d), 15).select("id", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_CHARACTER_KNN_SQL} SELECT id, round(max(distance), 6) AS core FROM k WHERE rank <= 10 GROUP BY 1")
def character_core_distance(spark: SparkSession, d: str) -> DataFrame:
    return vectors.core_distances(vectors.knn(_vectors(spark, d), 15), 10).select("id", F.round("core", 6).alias("core"))


@query(f"WITH {_CHARACTER_KNN_SQL}, c AS (SELECT id, max(distance) AS core FROM k WHERE rank <= 10 GROUP BY 1), e AS (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, min(distance) AS d FROM k GROUP BY 1, 2) SELECT a, b, round(greatest(d, ca.core, cb.core), 6) AS weight FROM e JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b")
def character_mutual_reachability(spark: SparkSession, d: str) -> DataFrame:
    near = cut_table(vectors.knn_lists(_vectors(spark, d), 15))
    return vectors.reachability_of_lists(near, 10).withColumn("weight", F.round("weight", 6))


def _planar(spark: SparkSession, d: str) -> DataFrame:
    """The stored map positions, as points to cluster."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return _xy(spark, d, "x", "y").where(ok("x") & ok("y")).select(F.col("character_id").alias("id"), F.array("x", "y").alias("position"))


@query()
def mst_edges(spark: SparkSession, d: str) -> DataFrame:
    return density.mst_edges(_planar(spark, d), 20)


_MR = lambda i: f"greatest(sqrt((xs[{i}] - xs[j]) * (xs[{i}] - xs[j]) + (ys[{i}] - ys[j]) * (ys[{i}] - ys[j])), cs[{i}], cs[j])"


# Prim's algorithm, one row for each step, with the nearest distance to the tree of every row outside of it
@query(f"""WITH RECURSIVE {_XY_SQL}, p AS (SELECT character_id AS id, x, y FROM xy WHERE isfinite(x) AND isfinite(y)),
core AS (SELECT id, max(d) AS c FROM (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM p a JOIN p b ON a.id <> b.id) WHERE r <= 20 GROUP BY 1),
l AS (SELECT list(x ORDER BY id) AS xs, list(y ORDER BY id) AS ys, list(c ORDER BY id) AS cs, range(1, count(*) + 1) AS js FROM p JOIN core USING (id)),
prim(step, w, best) AS (SELECT 1, NULL::DOUBLE, list_transform(js, lambda j: CASE WHEN j > 1 THEN {_MR(1)} END) FROM l
  UNION ALL SELECT step + 1, m, list_transform(js, lambda j: CASE WHEN j <> i AND best[j] IS NOT NULL THEN least(best[j], {_MR('i')}) END) FROM (SELECT step, best, list_min(best) AS m, list_position(best, list_min(best)) AS i FROM prim WHERE list_min(best) IS NOT NULL), l)
SELECT round(w, 6) AS weight, count(*) AS n FROM prim WHERE w IS NOT NULL GROUP BY 1""")
def mst_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights of the tree, which all least spanning trees of the rows share."""
    return mst_edges(spark, d).groupBy(F.round("weight", 6).alias("weight")).agg(F.count("*").alias("n"))


@query()
def hdbscan_labels(spark: SparkSession, d: str) -> DataFrame:
    return density.hdbscan(_planar(spark, d), config.PRESETS[0].min_cluster_size)


def _graph(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, d)
    return rows.select("id"), reduction.graph_of_lists(vectors.knn_lists(rows, k), k)


@query()
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, 15)[1].withColumn("weight", F.round("weight", 6))


@query()
def umap_5d(spark: SparkSession, d: str) -> DataFrame:
    ids, graph = _graph(spark, d, 15)
    return reduction.reduce(ids, graph, 5, 0.05)


@query()
def umap_2d(spark: SparkSession, d: str) -> DataFrame:
    ids, graph = _graph(spark, d, 15)
    return reduction.reduce(ids, graph, 2, 0.0)


@query()
def preset_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_vectors(spark, d))
    near = cut_table(vectors.knn_lists(rows, max(p.n_neighbors for p in config.PRESETS)))
    with ThreadPoolExecutor(len(config.PRESETS)) as pool:  # a layout keeps one core busy
        runs = list(pool.map(lambda p: cut(pipeline.cluster_vectors(rows, p, near=near)), config.PRESETS))
    return pipeline.summarise({p.name: run for p, run in zip(config.PRESETS, runs)})


@query()
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return embedding.embed(_texts(spark, d), "character_id", "speech_text")


@query(f"WITH {_TEXTS_SQL} SELECT 'hashing' AS model, 64 AS dim, count(*) AS n_rows, {config.EMBED_MAX_TOKENS} AS max_tokens, count(*) FILTER ({_words('speech_text')} + {len(config.EMBED_INSTRUCTION.split()) + 2} > {config.EMBED_MAX_TOKENS}) AS truncated_count, '{config.EMBED_INSTRUCTION}' AS instruction FROM texts")
def embed_metadata(spark: SparkSession, d: str) -> DataFrame:
    return embedding.run_metadata(embed_text(spark, d), "hashing", 64)


# ---------------------------------------------------------------- reports
def _shown_rows(spark: SparkSession, d: str) -> DataFrame:
    plots = documents.one_per_play(table(spark, d, "metadata").select("tcp", "plot"))
    return _members(spark, d).join(_texts(spark, d), "character_id", "left").join(plots, "tcp", "left")


@query()
def keyword_excerpts(spark: SparkSession, d: str) -> DataFrame:
    rows = _shown_rows(spark, d).where("cluster <> -1").withColumn("keywords", T.top_words(F.col("top_words")))
    found = rows.select("character_id", F.posexplode(excerpts.excerpts(excerpts.PER_CHARACTER_PAGE)(F.coalesce("speech_text", F.lit("")), F.col("keywords"))).alias("place", "e"))
    return found.select("character_id", "place", "e.passage", "e.hits")


_KEYWORDS = f"list_filter(list_transform(string_split(coalesce(top_words, ''), ','), lambda x: lower({_strip('x')})), lambda x: x <> '')"
_RUNS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"


# keywords are single words, so a speech is taken apart into runs of word characters and of others
@query(f"WITH {_MEMBERS_SQL}, {_TEXTS_SQL} SELECT character_id, coalesce(array_to_string(list_transform(regexp_extract_all(speech_text, {_RUNS}), lambda w: CASE WHEN list_contains({_KEYWORDS}, lower(w)) THEN '<mark>' || {_escape('w')} || '</mark>' ELSE {_escape('w')} END), ''), '') AS html FROM m JOIN texts USING (character_id) WHERE cluster <> -1")
def highlighted(spark: SparkSession, d: str) -> DataFrame:
    rows = _shown_rows(spark, d).where("cluster <> -1 and speech_text is not null")
    return rows.select("character_id", T.highlight(F.col("speech_text"), T.top_words(F.col("top_words"))).alias("html"))


@query()
def character_pages(spark: SparkSession, d: str) -> DataFrame:
    return reports.character_pages(_shown_rows(spark, d))


@query()
def cluster_pages(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_pages(_shown_rows(spark, d))


_STATS_SQL = "SELECT cluster, count(*) AS n, count(DISTINCT tcp) AS n_plays, min(year) AS first_year, max(year) AS last_year, trunc(median(year))::INT AS median_year, coalesce(min(topic_label), 'Cluster ' || cluster) AS label FROM m WHERE cluster <> -1 GROUP BY 1"


@query(f"WITH {_MEMBERS_SQL}, s AS ({_STATS_SQL}), w AS (SELECT cluster, max(top_words) AS top_words FROM cluster_labels GROUP BY 1), h AS (SELECT cluster, {_AUTHOR} AS author, count(*) AS n FROM m WHERE cluster <> -1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, author) AS r FROM h), t AS (SELECT cluster, string_agg(concat_ws(' ', CASE WHEN {_strip('author')} = '' THEN '(unknown)' ELSE author END, n::VARCHAR), '; ' ORDER BY r) AS authors FROM r WHERE r <= 6 GROUP BY 1) SELECT s.cluster, label, coalesce(w.top_words, '') AS top_words, n, n_plays, first_year, last_year, median_year, authors FROM s LEFT JOIN w USING (cluster) LEFT JOIN t USING (cluster)")
def master_index(spark: SparkSession, d: str) -> DataFrame:
    return reports.index_cards(_members(spark, d, "tcp", "year", "author", place=("cluster", "topic_label")), table(spark, d, "cluster_labels"))


@query(f"WITH {_MEMBERS_SQL}, s AS ({_STATS_SQL}) SELECT 'index.html' AS path, '<!doctype html><html><head><meta charset=\"utf-8\"><title>Clusters</title></head><body><ul>' || string_agg('<li><a href=\"cluster_' || (CASE WHEN cluster BETWEEN 0 AND 9 THEN '0' ELSE '' END || cluster) || '.html\">' || {_escape('label')} || '</a> ' || n || ' characters</li>', '' ORDER BY cluster) || '</ul></body></html>' AS html FROM s")
def index_page(spark: SparkSession, d: str) -> DataFrame:
    return reports.index_page(master_index(spark, d))


@query(f"WITH {_MEMBERS_SQL}, f AS (SELECT *, coalesce(topic_label, '-1: outliers') AS shown FROM m WHERE cluster <> -1), l AS (SELECT DISTINCT shown FROM f), p AS (SELECT shown, row_number() OVER (ORDER BY coalesce(try_cast({_strip('string_split(shown, ' + chr(39) + ':' + chr(39) + ')[1]')} AS BIGINT), 1000000000), shown) - 1 AS place FROM l) SELECT character_id, x, y, CASE WHEN shown = '-1: outliers' THEN 'lightgrey' ELSE {_PALETTE_SQL}[place % {len(facets.PALETTE)} + 1] END AS colour, concat_ws('<br>', {_HOVER}) AS hover FROM f JOIN p USING (shown)")
def figure_points(spark: SparkSession, d: str) -> DataFrame:
    return reports.figure_points(_members(spark, d))


@query(f"WITH {_MEMBERS_SQL}, f AS (SELECT *, coalesce(topic_label, '-1: outliers') AS shown FROM m WHERE cluster <> -1) SELECT shown AS topic_label, count(*) AS n_points, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM f WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY 1")
def figure_traces(spark: SparkSession, d: str) -> DataFrame:
    """The traces of the figure, read back from their JSON."""
    traces = reports.figure_traces(_members(spark, d)).select("topic_label", F.from_json("trace", "x array<double>, y array<double>").alias("t"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return traces.groupBy("topic_label").agg(F.sum(F.size("t.x")).alias("n_points"), F.round(F.sum(total("t.x")), 4).alias("sum_x"), F.round(F.sum(total("t.y")), 4).alias("sum_y"))


@query(f"WITH {_MEMBERS_SQL}, f AS (SELECT * FROM m WHERE cluster <> -1), v AS ({_AXES_SQL.replace('FROM m', 'FROM f')}), k AS (SELECT * FROM v WHERE decade IS NOT NULL AND {_strip('decade')} <> '' AND lower(decade) <> 'unknown') SELECT axis, count(*) AS n_values FROM k GROUP BY 1")
def figure_menus(spark: SparkSession, d: str) -> DataFrame:
    return reports.figure_menus(_members(spark, d)).select("axis", F.size(F.from_json("values", "array<string>")).cast("long").alias("n_values"))
