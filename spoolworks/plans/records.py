"""Queries on nested records and on the quality of loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions.text import strip
from spoolworks.operators import profile, shred
from spoolworks.plans.guesser import sql_strip
from spoolworks.sources.tables import table

JSON_FIELDS = ("alternative_titles", "genres", "studios")
NAME = ("name", "text", "title")
TITLES = shred.Tagged("type", {"en": "en", "ja": "ja", "synonym": "synonyms", "synonyms": "synonyms"}, unique=("en", "ja"))
ENTITIES = (
    *(shred.Entity("alternative_titles", label, {"name": NAME}) for label in ("en", "ja", "synonyms")),
    shred.Entity("genres", "genres", {"name": NAME}),
    *(shred.Entity("studios", label, {"name": NAME, "role": ("role",)}) for label in ("studios", "units", "leads")),
)


def discovery_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, genres, studios, units and leads of the raw records as flat rows with parent and place."""
    edges = shred.shred(table(spark, folder, "discovery"), "line_no", JSON_FIELDS, tagged={"alternative_titles": TITLES})
    return shred.entities(edges, "line_no", ENTITIES)


def p1_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entity tables: every titled, genre, studio, unit and lead object with its node, the node above it and its place."""
    rows = discovery_entities(spark, folder)
    return rows.select("line_no", "field", "label", "node", "parent", F.array_join("ordinals", ".").alias("place"), "kind", "name", "role")


def p1_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency table itself."""
    edges = shred.shred(table(spark, folder, "discovery"), "line_no", JSON_FIELDS, tagged={"alternative_titles": TITLES})
    return edges.select("line_no", "field", "node", "parent", "label", F.array_join("ordinals", ".").alias("place"), "kind", "scalar")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """line_no, child_path, child_name of every named entry of the three JSON fields."""
    place = lambda i: F.element_at("ordinals", i).cast("string")
    depth, label = F.size("ordinals"), F.col("label")
    path = (
        F.when(label.isin("en", "ja") & (depth == 2), F.concat(F.lit("alternative_titles."), label))
        .when((label == "synonyms") & (depth == 2), F.concat(F.lit("alternative_titles.synonyms["), place(2), F.lit("]")))
        .when((label == "genres") & (depth == 1), F.concat(F.lit("genres["), place(1), F.lit("]")))
        .when((label == "studios") & (depth == 1), F.concat(F.lit("studios["), place(1), F.lit("]")))
        .when((label == "units") & (depth == 2), F.concat(F.lit("studios["), place(1), F.lit("].units["), place(2), F.lit("]")))
        .when((label == "leads") & (depth == 3), F.concat(F.lit("studios["), place(1), F.lit("].units["), place(2), F.lit("].leads["), place(3), F.lit("]")))
    )
    rows = discovery_entities(spark, folder).select("line_no", path.alias("child_path"), strip(F.col("name")).alias("child_name"))
    return rows.where(F.col("child_path").isNotNull() & (F.col("child_name") != ""))


LOAD_RULES = {
    "runtime": profile.Rule(1, 1000),
    "num_episodes": profile.Rule(1, 5000),
    "release_year": profile.Rule(1890, 2030, moved=8, relative=False),
}
PROFILED = ("runtime", "num_episodes", "release_year", "release_date", "media_type", "original_language", "status")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """load_id, column_name, issue of every load whose figures have gone wrong or have moved."""
    return profile.load_issues(table(spark, folder, "development_entities"), "feed_id", "load_id", LOAD_RULES)


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_histogram(table(spark, folder, "development_entities"), ["feed_id", "load_id"], PROFILED)


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of seven columns of every load."""
    rows = profile.column_profile(_histogram(spark, folder), ["feed_id", "load_id"])
    return rows.withColumns({c: F.round(c, 6) for c in ("null_rate", "dominant_share")})


def p2_rare_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Values of rare form, by load, column and mask."""
    return profile.rare_masks(_histogram(spark, folder), ["feed_id", "load_id"])


def p2_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the masks of each load are from those of the feed's preceding load."""
    return profile.mask_divergence(_histogram(spark, folder), "feed_id", "load_id").withColumn("divergence", F.round("divergence", 6))


def _whole_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "development_entities")
    return profile.value_histogram(rows, ["feed_id", "load_id"], [c for c in rows.columns if c not in ("feed_id", "load_id")])


def p2_profile_all(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of every column but the load keys of every load."""
    rows = profile.column_profile(_whole_histogram(spark, folder), ["feed_id", "load_id"])
    return rows.withColumns({c: F.round(c, 6) for c in ("null_rate", "dominant_share")})


def p2_rare_masks_all(spark: SparkSession, folder: str) -> DataFrame:
    """Values of rare form of every column, by load, column and mask."""
    return profile.rare_masks(_whole_histogram(spark, folder), ["feed_id", "load_id"])


def p2_divergence_all(spark: SparkSession, folder: str) -> DataFrame:
    """How far the masks of every column of each load are from those of the feed's preceding load."""
    return profile.mask_divergence(_whole_histogram(spark, folder), "feed_id", "load_id").withColumn("divergence", F.round("divergence", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p1_edges, p2_found, p2_profile, p2_rare_masks, p2_divergence, p2_profile_all, p2_rare_masks_all, p2_divergence_all)}

def _sql_number(name: str) -> str:
    """The SQL text of a number, as ``profile.number_text`` writes it."""
    return f"CASE WHEN {name} IS NULL OR isnan({name}) THEN NULL WHEN {name} = floor({name}) AND abs({name}) < 1e15 THEN CAST(CAST({name} AS BIGINT) AS VARCHAR) ELSE CAST({name} AS VARCHAR) END"


SQL_MASK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '\p{Ll}+', 'a', 'g'), '[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]+', 'A', 'g'), '\p{Nd}+', '9', 'g'), '[\s\x{85}\p{Z}]+', ' ', 'g')"
# The columns of the loads by kind.
_NUMBERS = ("release_year", "runtime", "num_episodes", "rating", "popularity")
_LISTS = (
    "alternative_titles", "genres", "origin_country", "studios", "production_companies", "production_countries", "discovered_from", "source_presence", "keywords", "themes", "demographics", "relations",
)
_OTHERS = (
    "loaded_at", "task_key", "source", "source_id", "title", "original_title", "media_type", "source_media_type", "release_date", "end_date", "original_language", "overview", "vote_count", "rank", "favorites",
    "num_list_users", "status", "source_material", "tmdb_id", "mal_id", "entity_id", "match_confidence",
)


def _sql_text(name: str) -> str:
    if name in _NUMBERS:
        return _sql_number(name)
    return f"array_to_string({name}, ',')" if name in _LISTS else f"CAST({name} AS VARCHAR)"


def _sql_masks(columns: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT feed_id, load_id, '{c}' AS column_name, {_sql_text(c)} AS value FROM development_entities" for c in columns)
    return f"long AS ({long}), masked AS (SELECT *, {SQL_MASK} AS mask FROM long)"


_P2_VALUES = " UNION ALL ".join(
    f"SELECT feed_id, load_id, '{c}' AS column_name, CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS v, {r.low} AS low, {r.high} AS high FROM development_entities"
    for c, r in LOAD_RULES.items()
)
SQL = {
    "p2_found": f"""
WITH v AS ({_P2_VALUES}),
tops AS (SELECT load_id, column_name, max(n) AS top FROM (SELECT load_id, column_name, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
f AS (SELECT feed_id, load_id, column_name, count(*) AS r, count(*) - count(v) AS m, count(v) AS p,
        count(*) FILTER (v < low OR v > high) AS o, count(*) FILTER (v <> floor(v)) AS w,
        quantile_cont(v, 0.5) FILTER (v BETWEEN low AND high AND v = floor(v)) AS med FROM v GROUP BY ALL),
s AS (SELECT f.*, top, lag(r) OVER win AS lr, lag(m) OVER win AS lm, lag(med) OVER win AS lmed
      FROM f LEFT JOIN tops USING (load_id, column_name) WINDOW win AS (PARTITION BY feed_id, column_name ORDER BY load_id))
SELECT load_id, column_name, 'range' AS issue FROM s WHERE o * 50 > p
UNION ALL SELECT load_id, column_name, 'pattern' FROM s WHERE w * 50 > p
UNION ALL SELECT load_id, column_name, 'constant' FROM s WHERE top * 2 > p
UNION ALL SELECT load_id, column_name, 'null_rate' FROM s WHERE abs(m * lr - lm * r) * 100 > r * lr * 15
UNION ALL SELECT load_id, column_name, 'shift' FROM s WHERE abs(med - lmed) > CASE WHEN column_name = 'release_year' THEN 8 ELSE abs(lmed) / 4 END
""",
}


def _sql_profiles(suffix: str, masks: str) -> dict[str, str]:
    """The SQL of the profile, of the rare masks and of the divergence."""
    return {
        f"p2_profile{suffix}": f"""
WITH {masks},
g AS (SELECT feed_id, load_id, column_name, count(*) AS rows, count(value) AS present, count(DISTINCT value) AS distinct_values,
        count(DISTINCT CASE WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN value END) AS numbers,
        min(TRY_CAST(value AS DOUBLE)) AS low, max(TRY_CAST(value AS DOUBLE)) AS high, min(value) AS first_text, max(value) AS last_text FROM masked GROUP BY ALL),
m AS (SELECT feed_id, load_id, column_name, mask, count(*) AS n FROM masked WHERE mask IS NOT NULL GROUP BY ALL),
t AS (SELECT feed_id, load_id, column_name, arg_max(mask, (n, mask)) AS dominant_mask, max(n) AS top, count(*) AS masks FROM m GROUP BY ALL)
SELECT feed_id, load_id, column_name, rows, round((rows - present) / rows, 6) AS null_rate, distinct_values,
  CASE WHEN numbers = distinct_values AND numbers > 0 THEN {_sql_number('low')} ELSE first_text END AS least,
  CASE WHEN numbers = distinct_values AND numbers > 0 THEN {_sql_number('high')} ELSE last_text END AS greatest,
  coalesce(masks, 0) AS masks, dominant_mask, round(top / present, 6) AS dominant_share
FROM g LEFT JOIN t USING (feed_id, load_id, column_name)""",
        f"p2_rare_masks{suffix}": f"""
WITH {masks},
a AS (SELECT column_name, mask, count(*) AS n FROM masked WHERE mask IS NOT NULL GROUP BY ALL),
r AS (SELECT column_name, mask FROM (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total, max(n) OVER (PARTITION BY column_name) AS most FROM a) WHERE n < total * 0.02 AND n < most)
SELECT feed_id, load_id, column_name, mask, count(*) AS n FROM masked JOIN r USING (column_name, mask) GROUP BY ALL""",
        f"p2_divergence{suffix}": f"""
WITH {masks},
m AS (SELECT feed_id, load_id, column_name, coalesce(mask, '<missing>') AS mask, count(*) AS n FROM masked GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY feed_id, load_id, column_name) AS share FROM m),
o AS (SELECT feed_id, load_id, lag(load_id) OVER (PARTITION BY feed_id ORDER BY load_id) AS prev FROM (SELECT DISTINCT feed_id, load_id FROM m)),
u AS (SELECT s.feed_id, s.load_id, column_name, mask, share AS p, 0.0 AS q FROM s JOIN o USING (feed_id, load_id) WHERE prev IS NOT NULL
      UNION ALL SELECT o.feed_id, o.load_id, column_name, mask, 0.0, share FROM s JOIN o ON s.feed_id = o.feed_id AND s.load_id = o.prev),
b AS (SELECT feed_id, load_id, column_name, mask, sum(p) AS p, sum(q) AS q FROM u GROUP BY ALL)
SELECT feed_id, load_id, column_name, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS divergence
FROM b GROUP BY ALL""",
    }


SQL |= _sql_profiles("", _sql_masks(PROFILED)) | _sql_profiles("_all", _sql_masks((*_NUMBERS, *_LISTS, *_OTHERS)))

# --- nested records in SQL: DuckDB's JSON parser is strict, too; three quotations are undone, which the tables do not exceed


def _sql_unquoted(x: str) -> str:
    inner = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) <> 'VARCHAR' THEN {x} WHEN json_valid({inner}) THEN CAST({inner} AS JSON) WHEN left(ltrim({inner}), 1) IN ('{{', '[') THEN NULL ELSE {x} END"


def _sql_listed(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _sql_scalar(x: str, more: str = "") -> str:
    return f"CASE WHEN json_type({x}) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE'{more}) THEN {x} ->> '$' END"


def _sql_child(key: str) -> str:
    """The first scalar of a child of the object ``e``."""
    present = f"list_filter({_sql_listed(f"(e -> '{key}')")}, lambda c: json_type(c) NOT IN ('NULL', 'OBJECT', 'ARRAY'))[1]"
    return _sql_scalar(present, ", 'BOOLEAN'")


def _sql_entries(source: str, columns: str, child: str, place: str) -> str:
    """The entries ``e`` of a JSON value with their places, without wrappers; a single one has place 0."""
    size = f"CAST(CASE json_type({child}) WHEN 'ARRAY' THEN json_array_length({child}) ELSE 1 END AS BIGINT)"
    rows = f"SELECT {columns}, unnest({_sql_listed(child)}) AS e, unnest(range({size})) AS {place} FROM {source} WHERE {child} IS NOT NULL"
    return f"SELECT {columns}, {place}, CASE WHEN json_type(e) = 'OBJECT' AND json_keys(e) = ['node'] THEN e -> 'node' ELSE e END AS e FROM ({rows})"


def _sql_objects(source: str) -> str:
    return f"(SELECT * FROM {source} {'AND' if 'WHERE' in source else 'WHERE'} json_type(e) = 'OBJECT')"


_PLAIN_TITLES = _sql_objects("top ANTI JOIN tagged USING (line_no, f) WHERE f = 'alternative_titles'")
_TAGS = " ".join(f"WHEN '{tag}' THEN '{label}'" for tag, label in TITLES.labels.items())
_BY_LABEL = " UNION ALL ".join(f"SELECT line_no, '{label}' AS label, k, e FROM ({_sql_entries(_PLAIN_TITLES, 'line_no', f"(e -> '{label}')", 'k')})" for label in ("en", "ja", "synonyms"))
_NAMED = f"CASE WHEN json_type(e) = 'OBJECT' THEN coalesce({', '.join(map(_sql_child, NAME))}) ELSE {_sql_scalar('e')} END"
SQL["p1_found"] = f"""
WITH raw AS (SELECT line_no, unnest({list(JSON_FIELDS)}) AS f, unnest([{', '.join(JSON_FIELDS)}]) AS t FROM discovery),
j0 AS (SELECT line_no, f, CAST(t AS JSON) AS j FROM raw WHERE json_valid(t)),
{', '.join(f"j{i} AS (SELECT line_no, f, {_sql_unquoted('j')} AS j FROM j{i - 1})" for i in (1, 2, 3))},
top AS ({_sql_entries('j3', 'line_no, f', 'j', 'i')}),
tagged AS (SELECT DISTINCT line_no, f FROM top SEMI JOIN (SELECT * FROM j3 WHERE json_type(j) = 'ARRAY') USING (line_no, f)
  WHERE f = 'alternative_titles' AND json_type(e) = 'OBJECT' AND list_contains(json_keys(e), '{TITLES.tag}')),
by_tag AS (SELECT line_no, CASE lower(trim(e ->> '$.{TITLES.tag}')) {_TAGS} END AS label, i, e FROM top SEMI JOIN tagged USING (line_no, f)),
titles AS (SELECT line_no, label, row_number() OVER (PARTITION BY line_no, label ORDER BY i) - 1 AS k, e FROM by_tag WHERE label IS NOT NULL UNION ALL {_BY_LABEL}),
units AS ({_sql_entries(_sql_objects("top WHERE f = 'studios'"), 'line_no, i', "(e -> 'units')", 'j')}),
leads AS ({_sql_entries(_sql_objects('units'), 'line_no, i, j', "(e -> 'leads')", 'k')}),
found AS (SELECT line_no, 'alternative_titles.' || label || CASE WHEN label = 'synonyms' THEN '[' || k || ']' ELSE '' END AS child_path, e FROM titles
  UNION ALL SELECT line_no, f || '[' || i || ']', e FROM top WHERE f <> 'alternative_titles'
  UNION ALL SELECT line_no, 'studios[' || i || '].units[' || j || ']', e FROM units
  UNION ALL SELECT line_no, 'studios[' || i || '].units[' || j || '].leads[' || k || ']', e FROM leads)
SELECT DISTINCT line_no, child_path, {sql_strip('n')} AS child_name FROM (SELECT line_no, child_path, {_NAMED} AS n FROM found) WHERE {sql_strip('n')} <> ''"""
