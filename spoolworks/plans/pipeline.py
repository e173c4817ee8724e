"""Queries on ingest, normalisation, linking, the canonical table, sampling, views and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.operators import audit, normalize, resolve, strata
from spoolworks.plans.guesser import U, sql_fold, sql_strip
from spoolworks.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def canonical_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical entities, one row for each entity_id."""
    return table(spark, folder, "canonical_entities").where(F.col("entity_id").isNotNull()).dropDuplicates(["entity_id"])


# --- raw records ----------------------------------------------------------------------------------------------------


@query("SELECT id, line_no, title, _strategy AS strategy FROM discovery WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) = 1")
def dedup_first_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each id."""
    raw = table(spark, folder, "discovery").select("id", "line_no", "title", F.col("_strategy").alias("strategy"))
    return normalize.keep_first(raw, ["id"], ["line_no"])


@query("""SELECT id, string_agg(s, '+' ORDER BY met) AS strategies FROM
(SELECT id, _strategy AS s, min(line_no) AS met FROM discovery WHERE id IS NOT NULL AND _strategy IS NOT NULL GROUP BY ALL) GROUP BY id""")
def strategies_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The strategies that found each id, in order."""
    merged = normalize.merge_in_order(table(spark, folder, "discovery"), "id", "_strategy", "line_no")
    return merged.select("id", F.array_join("values", "+").alias("strategies"))


@query("SELECT count(*) AS lines, count(DISTINCT id) AS unique_ids, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) - count(id) AS null_ids FROM discovery")
def raw_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, unique, repeated and null ids of the raw records."""
    return audit.raw_profile(table(spark, folder, "discovery"), "id")


@query("""WITH d AS (SELECT DISTINCT id, _strategy AS strategy FROM discovery WHERE id IS NOT NULL AND _strategy IS NOT NULL),
x AS (SELECT id FROM d GROUP BY id HAVING count(*) = 1), t AS (SELECT _strategy AS strategy, count(*) AS total FROM discovery WHERE id IS NOT NULL AND _strategy IS NOT NULL GROUP BY 1)
SELECT strategy, total, count(*) AS unique_ids, count(x.id) AS exclusive_ids FROM d LEFT JOIN x USING (id) JOIN t USING (strategy) GROUP BY ALL""")
def strategy_contribution(spark: SparkSession, folder: str) -> DataFrame:
    """Records, ids and exclusive ids of each strategy."""
    return audit.contribution(table(spark, folder, "discovery"), "id", "_strategy")


@query("SELECT _query AS query, count(*) AS hits FROM discovery WHERE _query IS NOT NULL GROUP BY 1 ORDER BY hits DESC, query LIMIT 20")
def top_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 queries with most records."""
    counts = table(spark, folder, "discovery").where(F.col("_query").isNotNull()).groupBy(F.col("_query").alias("query")).agg(F.count(F.lit(1)).alias("hits"))
    return counts.orderBy(F.desc("hits"), "query").limit(20)


@query("SELECT DISTINCT id FROM discovery WHERE id IS NOT NULL AND id NOT IN (SELECT source_id FROM mal_normalized WHERE source_id IS NOT NULL)")
def unseen_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of raw records that are not staged yet."""
    ids = table(spark, folder, "discovery").select("id").where(F.col("id").isNotNull()).distinct()
    return ids.join(table(spark, folder, "mal_normalized").select(F.col("source_id").alias("id")), "id", "left_anti")


@query("""SELECT line_no, CASE media_type WHEN 'tv' THEN 'anime_tv' WHEN 'movie' THEN 'anime_movie' ELSE coalesce(media_type, 'unknown') END AS media_type,
CASE WHEN length(start_date) >= 4 THEN TRY_CAST(substr(start_date, 1, 4) AS INT) END AS release_year, nullif(end_date, '') AS end_date FROM discovery""")
def stage_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Recoded media type, year and end date of the raw records."""
    return table(spark, folder, "discovery").select(
        "line_no", normalize.recode_media(F.col("media_type")).alias("media_type"), normalize.year_of(F.col("start_date")).alias("release_year"),
        normalize.blank_to_null(F.col("end_date")).alias("end_date"),
    )


@query("""SELECT split_part(task_key, ':', 1) AS strategy, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM development_entities WHERE task_key IS NOT NULL GROUP BY 1""")
def crawl_status(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and entities by crawl strategy."""
    rows = table(spark, folder, "development_entities").where(F.col("task_key").isNotNull())
    return rows.groupBy(F.split_part("task_key", F.lit(":"), F.lit(1)).alias("strategy")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"))


@query("SELECT t.task_key, t.strategy, count(d.entity_id) AS rows FROM crawl_tasks t LEFT JOIN development_entities d USING (task_key) GROUP BY ALL")
def task_yield(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each crawl task gave; tasks without rows are kept."""
    counts = table(spark, folder, "development_entities").groupBy("task_key").agg(F.count("entity_id").alias("rows"))
    return table(spark, folder, "crawl_tasks").select("task_key", "strategy").join(counts, "task_key", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query("SELECT 'year:' || y || ':' || m AS task_key, CAST(y AS INT) AS task_year, m AS task_media FROM range(1900, 2027) t(y) CROSS JOIN (VALUES ('movie'), ('tv')) v(m)")
def year_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl tasks of the year strategy."""
    return audit.year_tasks(spark, 1900, 2026)


@query("""WITH busy AS (SELECT task_year, task_media FROM (SELECT t.task_year, t.task_media, count(*) AS n FROM development_entities d JOIN crawl_tasks t USING (task_key) WHERE t.strategy = 'year' GROUP BY ALL) WHERE n >= 15)
SELECT 'language:' || task_year || ':' || l AS task_key, task_year, l AS task_language FROM (SELECT DISTINCT task_year FROM busy) CROSS JOIN (VALUES ('en'), ('ja'), ('ko'), ('es'), ('fr')) v(l)""")
def language_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks by language for the years whose year tasks gave most rows."""
    given = table(spark, folder, "development_entities").select("task_key").join(table(spark, folder, "crawl_tasks").where("strategy = 'year'"), "task_key")
    busy = given.groupBy("task_year", "task_media").count().where("count >= 15").select("task_year").distinct()
    return audit.language_tasks(busy, ["en", "ja", "ko", "es", "fr"])


# --- projections ----------------------------------------------------------------------------------------------------

_PARTS = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in normalize.GENRE_PARTS.items()) + "}"


@query(f"""WITH {U}, g AS (SELECT entity_id, unnest(range(len(genres))) AS i, {sql_strip('unnest(genres)')} AS g FROM u),
p AS (SELECT entity_id, i, unnest(coalesce({_PARTS}[g], [g])) AS part, unnest(range(len(coalesce({_PARTS}[g], [g])))) AS j FROM g WHERE g <> ''),
f AS (SELECT entity_id, part, min((i, j)) AS met FROM p GROUP BY ALL), j AS (SELECT entity_id, string_agg(part, '|' ORDER BY met) AS genres FROM f GROUP BY 1)
SELECT entity_id, coalesce(j.genres, '') AS genres FROM u LEFT JOIN j USING (entity_id)""")
def genre_unify(spark: SparkSession, folder: str) -> DataFrame:
    """Genres in the unified taxonomy."""
    return canonical_rows(spark, folder).select("entity_id", F.array_join(normalize.unify_genres(F.col("genres")), "|").alias("genres"))


_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + chr(0x3000) + chr(0xA0)
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + "  "


def _sql_title(x: str) -> str:
    """A normalised title; DuckDB has no NFKC, full-width forms and wide blanks are mapped and the rest is composed."""
    return rf"coalesce(trim(regexp_replace(regexp_replace(lower(nfc_normalize(translate({x}, '{_WIDE}', '{_NARROW}'))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), '')"


_TITLES = f"SELECT source_id, source, {_sql_title('title')} AS normal FROM (SELECT * FROM tmdb_normalized UNION ALL SELECT * FROM mal_normalized)"


def _both(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tmdb_normalized").unionByName(table(spark, folder, "mal_normalized"))


@query(_TITLES)
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised titles of both staging tables."""
    return _both(spark, folder).select("source_id", "source", normalize.normalize_title(F.col("title")).alias("normal"))


def _sql_tags(pattern: str, tag: str) -> str:
    return rf"list_transform(regexp_extract_all(normal, '{pattern}', 1), lambda x: '{tag}' || x)"


@query(f"""SELECT source_id, source, normal, array_to_string(list_sort(list_distinct(list_concat({', '.join(_sql_tags(p, t) for p, t in normalize.MODIFIERS)},
{', '.join(f"CASE WHEN regexp_matches(normal, '{chr(92)}b{w}{chr(92)}b') THEN ['{w}'] ELSE [] END" for w in normalize.MODIFIER_WORDS)}))), ',') AS modifiers FROM ({_TITLES})""")
def title_modifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Season, part, number and kind tags of all titles."""
    return normalize_text(spark, folder).withColumn("modifiers", F.array_join(normalize.title_modifiers(F.col("normal")), ","))


_DECADE = "CASE WHEN release_year IS NULL THEN 'Unknown' WHEN release_year < 1900 THEN 'Pre-1900' ELSE CAST(release_year // 10 * 10 AS VARCHAR) || 's' END"
_MEDIA = "CASE WHEN media_type IN ('anime_tv', 'anime_movie', 'ova', 'ona', 'special', 'music') THEN 'anime' WHEN media_type IN ('tv', 'movie') THEN media_type ELSE 'other' END"
_AUDIT = "CASE WHEN source = 'mal' OR contains(lower(coalesce(media_type, '')), 'anime') THEN 'anime' WHEN lower(media_type) IN ('tv', 'movie') THEN lower(media_type) ELSE 'other' END"
_LANGUAGE = f"CASE WHEN original_language IS NULL OR original_language = '' THEN 'other' WHEN {sql_fold('original_language')} IN ({', '.join(repr(x) for x in normalize.MAJOR_LANGUAGES)}) THEN {sql_fold('original_language')} ELSE 'other_lang' END"
_BIN = "CASE " + " ".join(f"WHEN release_year >{'=' if i == 0 else ''} {lo} AND release_year <= {hi} THEN '{label}'" for i, (lo, hi, label) in enumerate(normalize.YEAR_BINS)) + " END"


@query(f"WITH {U} SELECT entity_id, {_DECADE} AS decade, {_MEDIA} AS media_group, {_AUDIT} AS audit_group, {_LANGUAGE} AS lang_group, {_BIN} AS year_bin FROM u")
def groupings(spark: SparkSession, folder: str) -> DataFrame:
    """Decade, both media groups, language group and year bin of every entity."""
    return canonical_rows(spark, folder).select(
        "entity_id", normalize.decade_label(F.col("release_year")).alias("decade"), normalize.media_group(F.col("media_type")).alias("media_group"),
        normalize.audit_media_group(F.col("source"), F.col("media_type")).alias("audit_group"), normalize.language_group(F.col("original_language")).alias("lang_group"),
        normalize.year_bin(F.col("release_year")).alias("year_bin"),
    )


@query(f"WITH {U} SELECT entity_id, g AS genre FROM u LEFT JOIN LATERAL (SELECT unnest(genres) AS g) ON true")
def explode_genres(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each genre; entities without genres keep one."""
    return canonical_rows(spark, folder).select("entity_id", F.explode_outer("genres").alias("genre"))


# --- linking --------------------------------------------------------------------------------------------------------

_SIDES = f"""one_t AS (SELECT * FROM tmdb_normalized WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY popularity, title) = 1),
one_m AS (SELECT * FROM mal_normalized WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY popularity, title) = 1),
anim AS (SELECT * FROM one_t WHERE coalesce(list_contains(genres, 'Animation'), false) OR coalesce(lower(original_language) = 'ja', false) OR coalesce(list_contains(origin_country, 'JP'), false)),
every AS (SELECT 'l' AS side, source_id AS id, release_year AS year, media_type AS media, title AS main, list_filter(list_concat([title, original_title], coalesce(alternative_titles, [])), lambda x: x IS NOT NULL AND {sql_strip('x')} <> '') AS titles FROM anim
  UNION ALL SELECT 'r', source_id, release_year, media_type, title, list_filter(list_concat([title, original_title], coalesce(alternative_titles, [])), lambda x: x IS NOT NULL AND {sql_strip('x')} <> '') FROM one_m),
mods AS (SELECT *, {_sql_title('main')} AS normal FROM every),
tagged AS (SELECT *, list_sort(list_distinct(list_concat({', '.join(_sql_tags(p, t) for p, t in normalize.MODIFIERS)},
{', '.join(f"CASE WHEN regexp_matches(normal, '{chr(92)}b{w}{chr(92)}b') THEN ['{w}'] ELSE [] END" for w in normalize.MODIFIER_WORDS)}))) AS tags FROM mods),
flat AS (SELECT side, id, year, media, tags, unnest(range(len(titles))) AS place, {_sql_title('unnest(titles)')} AS title FROM tagged),
lt AS (SELECT * FROM flat WHERE side = 'l' AND title <> ''), rt AS (SELECT * FROM flat WHERE side = 'r' AND title <> '')"""
_COMPATIBLE = " OR ".join(f"(lt.media = '{a}' AND rt.media = '{b}')" for a, b in resolve.COMPATIBLE)
_EDGES = f"""{_SIDES},
pairs AS (SELECT lt.id AS l, rt.id AS r, lt.place, CASE WHEN coalesce(abs(lt.year - rt.year) <= 1, false) AND lt.tags = rt.tags THEN CASE WHEN {_COMPATIBLE} THEN 3 ELSE 2 END ELSE 1 END AS rank FROM lt JOIN rt USING (title)),
edges AS (SELECT l, r, max(rank) AS rank, min(place) AS place FROM pairs GROUP BY ALL)"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return resolve.sides(table(spark, folder, "tmdb_normalized"), table(spark, folder, "mal_normalized"))


@query(f"WITH {_EDGES} SELECT l, r, rank, place FROM edges")
def link_candidates_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records with an equal title."""
    return resolve.exact_edges(*_sides(spark, folder)).select("l", "r", "rank", "place")


@query(f"WITH {_EDGES} SELECT l, r, rank FROM edges QUALIFY row_number() OVER (PARTITION BY l ORDER BY rank DESC, place, r) = 1")
def link_best_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The best exact match of each record of the first source."""
    return resolve.best_edges(resolve.exact_edges(*_sides(spark, folder))).select("l", "r", "rank")


@query(f"""WITH {_SIDES},
lb AS (SELECT DISTINCT id AS l, substr(title, 1, 3) AS block, year AS y FROM lt WHERE length(title) >= 3 AND year IS NOT NULL),
rb AS (SELECT DISTINCT id AS r, substr(title, 1, 3) AS block, unnest([year - 1, year, year + 1]) AS y FROM rt WHERE length(title) >= 3 AND year IS NOT NULL),
p AS (SELECT DISTINCT l, r FROM lb JOIN rb USING (block, y))
SELECT l, r, lt.title AS lt, rt.title AS rt FROM p JOIN lt ON lt.id = l JOIN rt ON rt.id = r WHERE abs(length(lt.title) - length(rt.title)) <= 5""")
def link_blocks_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Title pairs that the fuzzy comparison looks at."""
    return resolve.fuzzy_blocks(*_sides(spark, folder)).select("l", "r", "lt", "rt")


@query()
def link_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """One-to-one links, exact ones before fuzzy ones."""
    return resolve.link_tables(table(spark, folder, "tmdb_normalized"), table(spark, folder, "mal_normalized"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """High exact links that are the only one of both records."""
    edges = resolve.exact_edges(*_sides(spark, folder)).where("rank = 3")
    once = lambda side: edges.groupBy(side).count().where("count = 1").select(side)
    return edges.join(once("l"), "l").join(once("r"), "r").select("l", "r", F.lit("high").alias("match_confidence"))


_CANONICAL = f"""{_EDGES}, high AS (SELECT l, r FROM edges WHERE rank = 3),
links AS (SELECT l, r FROM high WHERE l IN (SELECT l FROM high GROUP BY l HAVING count(*) = 1) AND r IN (SELECT r FROM high GROUP BY r HAVING count(*) = 1)),
canon AS (SELECT 'tmdb_' || l || '_mal_' || r AS entity_id, 'tmdb+mal' AS source, coalesce(nullif(m.media_type, ''), t.media_type) AS media_type, t.title, 'high' AS match_confidence FROM links JOIN one_t t ON t.source_id = l JOIN one_m m ON m.source_id = r
  UNION ALL SELECT 'tmdb_' || source_id, source, media_type, title, 'unmatched' FROM one_t WHERE source_id NOT IN (SELECT l FROM links)
  UNION ALL SELECT 'mal_' || source_id, source, media_type, title, 'unmatched' FROM one_m WHERE source_id NOT IN (SELECT r FROM links))"""


@query(f"WITH {_CANONICAL} SELECT * FROM canon")
def canonical_union(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical table of both staging tables."""
    rows = resolve.canonical(table(spark, folder, "tmdb_normalized"), table(spark, folder, "mal_normalized"), _links(spark, folder))
    return rows.select("entity_id", "source", "media_type", "title", "match_confidence")


@query(f"WITH {_CANONICAL} SELECT count(*) AS entities, (SELECT count(*) FROM one_t) + (SELECT count(*) FROM one_m) - (SELECT count(*) FROM links) AS expected FROM canon")
def canonical_count_invariant(spark: SparkSession, folder: str) -> DataFrame:
    """The number of canonical rows, and what it should be."""
    links = _links(spark, folder)
    ids = lambda n: table(spark, folder, n).agg(F.count_distinct("source_id").alias("n"))
    expected = ids("tmdb_normalized").scalar() + ids("mal_normalized").scalar() - links.agg(F.count(F.lit(1))).scalar()
    return canonical_union(spark, folder).agg(F.count(F.lit(1)).alias("entities")).select("entities", expected.alias("expected"))


@query(f"""WITH {U} SELECT d.load_id, d.entity_id, count(*) AS rows, coalesce(any_value(array_to_string(u.keywords, ',')), '') AS keywords
FROM development_entities d LEFT JOIN u ON d.entity_id = u.entity_id GROUP BY ALL""")
def enrich_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the loads with the canonical keywords attached; no row is multiplied."""
    rows = table(spark, folder, "development_entities").select("load_id", "entity_id")
    joined = resolve.enrich(rows, canonical_rows(spark, folder).select("entity_id", "keywords"), "entity_id", ("keywords",))
    return joined.groupBy("load_id", "entity_id").agg(F.count(F.lit(1)).alias("rows"), F.first(F.array_join("keywords", ",")).alias("keywords"))


@query(f"WITH {_EDGES} SELECT source_id FROM one_m WHERE source_id NOT IN (SELECT r FROM edges)")
def unlinked_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the second source that share no title with the first."""
    edges = resolve.exact_edges(*_sides(spark, folder)).select(F.col("r").alias("source_id"))
    return table(spark, folder, "mal_normalized").select("source_id").where(F.col("source_id").isNotNull()).distinct().join(edges, "source_id", "left_anti")


# --- sampling -------------------------------------------------------------------------------------------------------

_QUOTAS = f"""{U}, s AS (SELECT *, {_MEDIA} AS media_group, {_DECADE} AS decade, {_LANGUAGE} AS lang_group FROM u), n AS (SELECT count(*) // 4 AS target FROM u),
qb AS (SELECT v.k, v.g AS media_group, least(coalesce(c.n, 0), CAST(trunc(target * v.p::DOUBLE) AS BIGINT)) AS base, coalesce(c.n, 0) AS available, target
  FROM (VALUES (0, 'movie', 0.4), (1, 'tv', 0.25), (2, 'anime', 0.3), (3, 'other', 0.05)) v(k, g, p) CROSS JOIN n LEFT JOIN (SELECT media_group, count(*) AS n FROM s GROUP BY 1) c ON c.media_group = v.g),
q AS (SELECT media_group, base + CAST(available > base AND row_number() OVER (ORDER BY available <= base, k) <= target - sum(base) OVER () AS BIGINT) AS quota FROM qb),
z AS (SELECT media_group, decade, lang_group, count(*) AS size FROM s GROUP BY ALL),
w AS (SELECT z.*, quota, sum(size) OVER g AS everyone, CAST(trunc(sqrt(size) / sum(sqrt(size)) OVER g * quota) AS BIGINT) AS part FROM z JOIN q USING (media_group) WINDOW g AS (PARTITION BY media_group)),
t AS (SELECT media_group, decade, lang_group, size, CASE WHEN everyone <= quota THEN size ELSE part + CAST(row_number() OVER (PARTITION BY media_group ORDER BY size DESC, decade, lang_group) <= quota - sum(part) OVER (PARTITION BY media_group) AS BIGINT) END AS target FROM w)"""


def quarter(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The canonical rows, and a quarter of their number."""
    rows = canonical_rows(spark, folder)
    return rows, rows.count() // 4


@query(f"WITH {_QUOTAS} SELECT media_group, quota FROM q")
def sample_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Quotas of the media groups of a sample of a quarter."""
    rows, target = quarter(spark, folder)
    return spark.createDataFrame(list(strata.quotas(strata.group_counts(rows), target).items()), "media_group string, quota bigint")


@query(f"WITH {_QUOTAS} SELECT * FROM t")
def sample_stratum_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of the strata of a sample of a quarter."""
    rows, target = quarter(spark, folder)
    return strata.stratum_targets(rows, strata.quotas(strata.group_counts(rows), target))


_SAMPLE = f"{_QUOTAS}, sample AS (SELECT s.* FROM s JOIN t USING (media_group, decade, lang_group) QUALIFY row_number() OVER (PARTITION BY media_group, decade, lang_group ORDER BY md5(entity_id || ':42'), entity_id) <= any_value(t.target) OVER (PARTITION BY media_group, decade, lang_group))"


@query(f"WITH {_SAMPLE} SELECT entity_id, media_group, decade, lang_group FROM sample")
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a sample of a quarter."""
    rows, target = quarter(spark, folder)
    return strata.sample_diverse(rows.select("entity_id", "media_type", "release_year", "original_language"), target).select("entity_id", "media_group", "decade", "lang_group")


# --- views and validation -------------------------------------------------------------------------------------------


@query(f"""WITH {U} SELECT 'all' AS view, count(*) AS rows FROM u UNION ALL SELECT 'first', count(*) FROM u WHERE source IN ('tmdb', 'tmdb+mal')
UNION ALL SELECT 'second', count(*) FROM u WHERE source IN ('mal', 'tmdb+mal') UNION ALL SELECT 'shared', count(*) FROM u WHERE source = 'tmdb+mal'""")
def views_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the four analytic views."""
    return audit.view_counts(canonical_rows(spark, folder))


def _sql_checks(dev: str, sample: str, canonical: str, expected: dict[str, int]) -> str:
    """The twelve checks over the views of ``dev``, stated one by one."""
    ids = lambda t: f"(SELECT entity_id FROM {t} WHERE entity_id IS NOT NULL)"
    unique = lambda c, t: f"(SELECT count({c}) = count(DISTINCT {c}) FROM {t})"
    rows = lambda t: f"(SELECT count(*) FROM {t})"
    checks = {
        "rows_equal_sample": f"{rows('dev')} = {rows('sample')}", "ids_in_canonical": f"NOT EXISTS {ids('dev')[:-1]} AND entity_id NOT IN {ids('canonical')})",
        "ids_unique": unique("entity_id", "dev"), "first_ids_unique": unique("entity_id", "a"), "second_ids_unique": unique("entity_id", "b"),
        "shared_count": f"{rows('x')} = {expected['shared']}",
        "shared_in_both": f"NOT EXISTS {ids('x')[:-1]} AND (entity_id NOT IN {ids('a')} OR entity_id NOT IN {ids('b')}))",
        "tmdb_id_unique": unique("tmdb_id", "a"), "mal_id_unique": unique("mal_id", "b"), "null_dates": f"(SELECT count(*) FROM dev WHERE release_date IS NULL) = {expected['null_dates']}",
        "inclusion": f"{rows('a')} + {rows('b')} - {rows('x')} = {rows('dev')}", "canonical_count": f"{rows('canonical')} = {expected['canonical']}",
    }
    views = "a AS (SELECT * FROM dev WHERE source IN ('tmdb', 'tmdb+mal')), b AS (SELECT * FROM dev WHERE source IN ('mal', 'tmdb+mal')), x AS (SELECT * FROM dev WHERE source = 'tmdb+mal')"
    return f"dev AS ({dev}), sample AS ({sample}), canonical AS ({canonical}), {views} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {c} AS passed" for n, c in checks.items())


#: Figures that the checks expect; those of the smallest shared view, of rows without a date and of the canonical table.
EXPECTED = {"shared": 100, "null_dates": 0, "canonical": 1500}


@query(f"WITH {U}, {_sql_checks('SELECT * FROM u', 'SELECT * FROM u', 'SELECT * FROM canonical_entities', EXPECTED)}")
def validator_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve checks of the canonical entities' views against the canonical table."""
    rows = canonical_rows(spark, folder)
    return audit.validate(audit.views(rows), rows, table(spark, folder, "canonical_entities"), EXPECTED).select("name", "passed")


@query(f"WITH {U}, {_sql_checks('SELECT * FROM development_entities', 'SELECT * FROM u', 'SELECT * FROM u WHERE media_type IS NOT NULL', EXPECTED)}")
def validator_checks_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve checks of all loads against the entities that have a media type; most of them fail."""
    rows = canonical_rows(spark, folder)
    return audit.validate(audit.views(table(spark, folder, "development_entities")), rows, rows.where(F.col("media_type").isNotNull()), EXPECTED).select("name", "passed")
