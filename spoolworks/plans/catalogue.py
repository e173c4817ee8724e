"""Queries on lists in any container, staging of raw records, quality and report tables, and figures of known games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions.text import strip
from spoolworks.operators import audit, lists, normalize, resolve, shred, simulate, stats
from spoolworks.plans import guesser, records
from spoolworks.plans.figures import _CLEAN as _CLEAN_VALUES
from spoolworks.plans.figures import _WEIGHTS, _with_sample
from spoolworks.plans.guesser import U, sql_strip
from spoolworks.plans.pipeline import _AUDIT, _DECADE, _SAMPLE, canonical_rows
from spoolworks.sources import crawl
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


# --- lists in any container -------------------------------------------------------------------------------------------

_CLEAN = f"list_filter(list_transform(coalesce(genres, []), lambda x: {sql_strip('x')}), lambda x: x IS NOT NULL AND x <> '')"


@query(f"""WITH {U} SELECT entity_id, array_to_string({_CLEAN}, '|') AS from_list, array_to_string({_CLEAN}, '|') AS from_json, coalesce({sql_strip('original_language')}, '') AS from_text FROM u""")
def list_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The same clean lists out of list columns, of their JSON texts and of single texts."""
    rows = canonical_rows(spark, folder).withColumn("json", F.to_json("genres"))
    joined = lambda c: F.array_join(lists.as_list(F.col(c), rows.schema[c].dataType), "|")
    return rows.select("entity_id", joined("genres").alias("from_list"), joined("json").alias("from_json"), joined("original_language").alias("from_text"))


@query(f"""WITH {U} SELECT entity_id, len(genres) AS genres, len(origin_country) AS countries, list_contains(genres, 'Drama') AS drama FROM u""")
def entities_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Entities whose lists were stored as JSON texts, loaded again: lengths of the lists, and membership as in a list."""
    stored = canonical_rows(spark, folder).select("entity_id", *[F.to_json(c).alias(c) for c in ("genres", "origin_country")])
    loaded = lists.load_entities(stored)
    return loaded.select("entity_id", F.size("genres").cast("bigint").alias("genres"), F.size("origin_country").cast("bigint").alias("countries"), F.when(F.col("genres").isNotNull(), F.coalesce(F.array_contains("genres", "Drama"), F.lit(False))).alias("drama"))


# --- raw records --------------------------------------------------------------------------------------------------------


def staged_discovery_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The raw records of the second source in the staging schema: first record of each id, strategies merged, JSON shredded."""
    raw = table(spark, folder, "discovery")
    first = normalize.keep_first(raw.select("id", "line_no", *[c for c in raw.columns if c not in ("id", "line_no")]), ["id"], ["line_no"])
    tagged = {"alternative_titles": records.TITLES}
    edges = shred.shred(first, "line_no", (*records.JSON_FIELDS, "start_season"), tagged=tagged)
    named = shred.entities(edges, "line_no", (*records.ENTITIES, shred.Entity("start_season", "start_season", {"year": ("year",)})))
    kept = named.where(F.col("label").isin("en", "ja", "synonyms", "genres", "studios", "start_season"))
    each = F.struct("ordinals", F.col("label"), strip(F.col("name")).alias("name"), "year")
    lists_ = kept.groupBy("line_no").agg(F.array_sort(F.collect_list(each)).alias("of"))  # the entries of one record
    only = lambda label: F.filter("of", lambda x: x["label"] == label)
    texts = lambda label: F.filter(F.transform(only(label), lambda x: x["name"]), lambda x: x != "")
    one = lambda label, column: F.try_element_at(F.transform(only(label), lambda x: x[column]), F.lit(1))
    objects = lambda label: F.transform(texts(label), lambda x: F.struct(x.alias("name")))
    nested = lists_.select(
        "line_no", F.struct(one("en", "name").alias("en"), one("ja", "name").alias("ja"), texts("synonyms").alias("synonyms")).alias("alternative_titles"),
        objects("genres").alias("genres"), objects("studios").alias("studios"), F.struct(one("start_season", "year").alias("year")).alias("start_season"),
    )
    found = normalize.merge_in_order(raw.withColumn("_strategy", F.coalesce("_strategy", F.lit("unknown"))), "id", "_strategy", "line_no")
    joined = first.drop("alternative_titles", "genres", "studios", "start_season").join(nested, "line_no", "left").join(found, "id", "left")
    return normalize.stage_second(joined).withColumn("_id", F.col("source_id")).join(found.withColumnRenamed("id", "_id"), "_id", "left").withColumn("discovered_from", F.col("values")).drop("_id", "values")


@query()
def staged_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """The staging rows of the raw records, lists joined."""
    rows = staged_discovery_rows(spark, folder)
    return rows.select(
        "source", "source_id", "title", "original_title", "media_type", "release_date", "release_year", "rating", "vote_count",
        *[F.array_join(c, "|").alias(c) for c in ("alternative_titles", "genres", "studios", "discovered_from")],
    )


@query("""WITH f AS (SELECT * FROM discovery WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no) = 1),
s AS (SELECT id, string_agg(s, '|' ORDER BY met) AS found FROM (SELECT id, coalesce(_strategy, 'unknown') AS s, min(line_no) AS met FROM discovery WHERE id IS NOT NULL GROUP BY ALL) GROUP BY id)
SELECT id AS source_id, title, CASE media_type WHEN 'tv' THEN 'anime_tv' WHEN 'movie' THEN 'anime_movie' ELSE coalesce(media_type, 'unknown') END AS media_type,
nullif(start_date, '') AS release_date, coalesce(synopsis, '') AS overview, mean AS rating, num_scoring_users AS vote_count, num_episodes, found AS discovered_from FROM f JOIN s USING (id)""")
def staged_discovery_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of the staging rows that need no JSON."""
    rows = staged_discovery_rows(spark, folder)
    return rows.select("source_id", "title", "media_type", "release_date", "overview", "rating", "vote_count", "num_episodes", F.array_join("discovered_from", "|").alias("discovered_from"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(lower(title), ' ')) AS w FROM discovery) WHERE length(w) >= 3")
def search_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The words of titles that are long enough to be searched for."""
    return table(spark, folder, "discovery").select(F.explode(F.split(F.lower("title"), " ")).alias("word")).where(F.length("word") >= 3).distinct()


@query("SELECT source_id, TRY_CAST(release_date AS DATE) AS day, CAST(year(TRY_CAST(release_date AS DATE)) AS INT) AS year FROM (SELECT source_id, CASE WHEN length(release_date) = 10 THEN release_date END AS release_date FROM tmdb_normalized)")
def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Release dates as dates; partial ones and those that are none are null."""
    whole = F.when(F.length("release_date") == 10, F.col("release_date"))
    return table(spark, folder, "tmdb_normalized").select("source_id", F.try_to_date(whole, "yyyy-MM-dd").alias("day")).withColumn("year", F.year("day"))


@query("SELECT 'genre:' || g || ':' || d || ':' || m AS task_key, CAST(g AS INT) AS genre_id, CAST(d AS INT) AS decade, m AS task_media FROM (VALUES (16), (18), (35)) a(g) CROSS JOIN (VALUES (1990), (2000), (2010)) b(d) CROSS JOIN (VALUES ('movie'), ('tv')) c(m)")
def genre_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl tasks of three genres in three decades."""
    return audit.genre_tasks(spark, [16, 18, 35], [1990, 2000, 2010])


@query("""SELECT 'low:' || y || ':' || m AS task_key, 'low_popularity' AS strategy, m AS endpoint, '{"sort_by": "vote_count.asc", "vote_count.gte": 1, "year": ' || y || '}' AS params
FROM range(1990, 2027) t(y) CROSS JOIN (VALUES ('movie'), ('tv')) v(m)""")
def low_popularity_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl tasks of the sweep of records with few votes."""
    return crawl.low_popularity_tasks(spark, range(1990, 2027))


@query()
def canonical_table(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical table that the process job makes: all links of high and medium confidence, exact and fuzzy, one to one."""
    first, second = table(spark, folder, "tmdb_normalized"), table(spark, folder, "mal_normalized")
    links = resolve.link_tables(first, second).where("match_confidence IN ('high', 'medium')")
    return resolve.canonical(first, second, links).select("entity_id", "source", "media_type", "title", "match_confidence", F.array_join("genres", "|").alias("genres"))


# --- quality and reports ------------------------------------------------------------------------------------------------

# The fields of the quality table.
QUALITY_FIELDS = ("title", "original_title", "release_date", "release_year", "genres", "original_language", "overview", "rating", "vote_count", "popularity", "media_type", "status")


def _sql_missing(field: str) -> str:
    return f"{field} IS NULL OR len({field}) = 0" if field in ("genres", "alternative_titles") else f"{field} IS NULL"


@query(f"WITH {U} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS total, count(*) FILTER (NOT ({_sql_missing(f)})) AS present, count(*) FILTER ({_sql_missing(f)}) AS missing, round(count(*) FILTER ({_sql_missing(f)}) * 100 / count(*), 4) AS missing_percent FROM u" for f in QUALITY_FIELDS))
def quality_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Present and missing values of the twelve fields of the quality report."""
    return audit.field_quality(canonical_rows(spark, folder), QUALITY_FIELDS)


@query(f"""WITH {U} SELECT media_type, count(*) AS entities, CAST(sum(vote_count) AS DOUBLE) AS votes, round(avg(CASE WHEN isnan(rating) THEN NULL ELSE rating END), 6) AS mean_rating FROM u GROUP BY 1""")
def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Count, sum and mean by media type."""
    rating = F.nanvl("rating", F.lit(None).cast("double"))
    return canonical_rows(spark, folder).groupBy("media_type").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("vote_count").cast("double").alias("votes"), F.round(F.avg(rating), 6).alias("mean_rating")
    )


@query(f"""WITH {_WEIGHTS}, ww AS (SELECT s.popularity AS v, coalesce(weight, 1.0) AS w FROM (SELECT *, {_AUDIT} AS stratum FROM sample) s LEFT JOIN dw USING (stratum) WHERE s.popularity IS NOT NULL AND NOT isnan(s.popularity))
SELECT round((SELECT avg(popularity) FROM u WHERE popularity IS NOT NULL AND NOT isnan(popularity)), 6) AS population, round(avg(v), 6) AS sample, round(sum(v * w) / sum(w), 6) AS reweighted FROM ww""")
def reweighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean popularity of all entities, of the sample, and of the sample weighted by its design."""
    rows, sample = _with_sample(spark, folder)
    group = normalize.audit_media_group(F.col("source"), F.col("media_type"))
    weights = F.broadcast(stats.design_weights(rows, sample, group).select("stratum", "weight"))  # four strata
    weighted = sample.withColumn("stratum", group).join(weights, "stratum", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    population = rows.agg(F.avg(F.nanvl("popularity", F.lit(None).cast("double"))).alias("population"))
    means = stats.weighted_mean(weighted, "popularity", "weight")
    return population.crossJoin(means).select(*[F.round(c, 6).alias(c) for c in ("population", "sample", "reweighted")])  # one row each


@query(f"""WITH {_SAMPLE}, c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT v, 1 AS a, 0 AS b FROM {_CLEAN_VALUES.format('u')} UNION ALL SELECT v, 0, 1 FROM {_CLEAN_VALUES.format('sample')}) GROUP BY v),
k AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM c),
d AS (SELECT max(abs(fa - fb)) AS d, CAST(any_value(n) AS DOUBLE) AS n, CAST(any_value(m) AS DOUBLE) AS m FROM k), x AS (SELECT d, (sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * d AS x FROM d)
SELECT round(d, 6) AS ks, round(CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * x * x))))) END, 6) AS p_value FROM x""")
def ks_test(spark: SparkSession, folder: str) -> DataFrame:
    """The Kolmogorov-Smirnov statistic of popularity between table and sample, and its p-value."""
    rows, sample = _with_sample(spark, folder)
    n, m = (stats.moments(df, "popularity").select(F.col("n").alias(name)) for df, name in ((rows, "n"), (sample, "m")))
    one = stats.distances(rows, sample, "popularity").crossJoin(n).crossJoin(m)  # one row each
    return one.withColumn("p_value", F.round(stats.p_value(F.col("ks"), F.col("n"), F.col("m")), 6)).select(F.round("ks", 6).alias("ks"), "p_value")


@query(f"WITH {U} SELECT source AS source, format('{{:,}}', count(*) * 1000) AS thousands, printf('%.1f%%', count(*) * 100.0 / (SELECT count(*) FROM u)) AS percent FROM u GROUP BY source")
def formatted_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers as a report writes them: with thousands separators, and shares in per cent."""
    rows = canonical_rows(spark, folder)
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.format_number(F.col("n") * 1000, 0).alias("thousands"), F.format_string("%.1f%%", F.col("n") * 100.0 / total).alias("percent"))


_SECTIONS = {
    "media_group": _AUDIT, "decade": _DECADE, "language": "original_language", "status": "status", "source": "source", "confidence": "match_confidence",
    "genre": "unnest(genres)", "country": "unnest(origin_country)", "studio": "unnest(studios)", "keyword": "unnest(keywords)",
}
TOP = 20


@query(f"WITH {U}, r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS section, CAST(v AS VARCHAR) AS item, count(*) AS n FROM (SELECT {e} AS v FROM u) WHERE v IS NOT NULL GROUP BY ALL" for n, e in _SECTIONS.items()) + f""")
SELECT section, item, n, round(n * 100 / sum(n) OVER (PARTITION BY section), 4) AS percent, row_number() OVER (PARTITION BY section ORDER BY n DESC, item) AS place FROM r QUALIFY row_number() OVER (PARTITION BY section ORDER BY n DESC, item) <= {TOP}""")
def development_report(spark: SparkSession, folder: str) -> DataFrame:
    """The counted sections of the development report, the commonest items of each."""
    values = {
        "media_group": normalize.audit_media_group(F.col("source"), F.col("media_type")), "decade": normalize.decade_label(F.col("release_year")),
        "language": F.col("original_language"), "status": F.col("status"), "source": F.col("source"), "confidence": F.col("match_confidence"),
    }
    many = {"genre": "genres", "country": "origin_country", "studio": "studios", "keyword": "keywords"}
    rows = audit.sections(canonical_rows(spark, folder), values, many, TOP)
    return rows.withColumn("percent", F.round("percent", 4))


@query(f"WITH {guesser.SQL_QUESTIONS} SELECT question_family, count(*) AS questions, min(pos) AS first, string_agg(question_id, ',' ORDER BY pos) AS ids FROM q GROUP BY 1")
def catalogue_families(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of each family, in catalogue order."""
    frame = guesser.question_catalogue(spark, folder)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question_id"))), lambda x: x["question_id"]), ",")
    return frame.groupBy("question_family").agg(F.count(F.lit(1)).alias("questions"), F.min("pos").alias("first"), ids.alias("ids"))


# --- figures of known games -----------------------------------------------------------------------------------------------

_KNOWN = f"""{U}, k AS (SELECT entity_id, CASE WHEN length(entity_id) % 2 = 0 THEN 'even' ELSE 'odd' END AS policy, CAST(1 + ascii(right(entity_id, 1)) % 3 AS INT) AS seed,
  1 + (length(title) * 7 + ascii(right(entity_id, 1))) % 25 AS asked, (length(title) + ascii(right(entity_id, 1))) % 5 AS left_over FROM u WHERE title IS NOT NULL AND length(entity_id) > 0),
g AS (SELECT *, CASE WHEN left_over = 1 THEN 'single_candidate' WHEN left_over = 0 THEN 'empty_candidate_set' ELSE 'max_questions_reached' END AS reason, left_over = 1 AS correct FROM k),
h AS (SELECT g.*, s AS step, CASE WHEN s = asked THEN left_over ELSE 1000 // CAST(s + 1 AS BIGINT) + 5 END AS remaining, CASE s % 3 WHEN 0 THEN 'media' WHEN 1 THEN 'genre' ELSE 'time' END AS family
  FROM g, LATERAL (SELECT unnest(range(1, asked + 1)) AS s))"""


def known_games(spark: SparkSession, folder: str) -> DataFrame:
    """Results of games that follow from the entities by rule, one a title, so that their figures can be stated in SQL."""
    last = F.ascii(F.substring("entity_id", -1, 1))
    rows = canonical_rows(spark, folder).where(F.col("title").isNotNull() & (F.length("entity_id") > 0)).select(
        F.when(F.length("entity_id") % 2 == 0, "even").otherwise("odd").alias("policy"), (1 + last % 3).alias("seed"), F.lit(0).alias("game"), F.col("entity_id").alias("target_entity_id"),
        (1 + (F.length("title") * 7 + last) % 25).alias("questions_asked"), ((F.length("title") + last) % 5).alias("remaining_candidates"),
    )
    asked, left = F.col("questions_asked"), F.col("remaining_candidates")
    family = lambda s: F.when(s % 3 == 0, "media").when(s % 3 == 1, "genre").otherwise("time")
    step = lambda s: F.struct(
        s.alias("step"), F.concat(F.lit("q"), s).alias("question_id"), family(s).alias("question_family"), F.lit(1).alias("answer"),
        F.when(s == asked, left).otherwise(F.floor(F.lit(1000) / (s + 1)).cast("int") + 5).alias("remaining_candidates"),
    )
    reason = F.when(left == 1, "single_candidate").when(left == 0, "empty_candidate_set").otherwise("max_questions_reached")
    return rows.withColumns({"correct": left == 1, "terminated_reason": reason, "history": F.transform(F.sequence(F.lit(1), asked), step)}).withColumn(
        "guessed_entity_id", F.when(F.col("correct"), F.col("target_entity_id"))
    )


_RATES = """count(*) AS games, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(1 - CAST(correct AS INT)), 6) AS failure_rate, round(avg(CAST(reason = 'empty_candidate_set' AS INT)), 6) AS zero_candidate_rate,
round(avg(asked), 6) AS mean_questions, median(asked) AS median_questions, round(avg(left_over), 6) AS mean_remaining, median(left_over) AS median_remaining"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_KNOWN} SELECT policy, seed, {_RATES} FROM g GROUP BY ALL")
def known_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the known games by policy and seed."""
    return _rounded(simulate.rates(known_games(spark, folder)))


@query(f"""WITH {_KNOWN}, c AS (SELECT policy, 0 AS step, 2000 AS n FROM g UNION ALL SELECT policy, step, remaining FROM h)
SELECT policy, CAST(step AS INT) AS step, round(avg(n), 6) AS mean_remaining, median(n) AS median_remaining, count(*) AS games FROM c GROUP BY ALL""")
def known_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Remaining candidates of the known games by step."""
    return _rounded(simulate.reduction_curve(known_games(spark, folder), 2000))


@query(f"""WITH {_KNOWN}, b AS (SELECT *, lag(remaining, 1, 2000) OVER (PARTITION BY policy, seed, entity_id ORDER BY step) AS before FROM h),
f AS (SELECT policy, family, count(*) AS uses, avg((before - remaining) / before) AS mean_reduction FROM b GROUP BY ALL)
SELECT policy, family AS question_family, uses, round(uses / sum(uses) OVER (PARTITION BY policy), 6) AS share, round(mean_reduction, 6) AS mean_reduction FROM f""")
def known_family(spark: SparkSession, folder: str) -> DataFrame:
    """Use and effect of the families in the known games."""
    games = known_games(spark, folder).withColumn("game", F.col("target_entity_id"))
    return _rounded(simulate.family_use(games, 2000))


@query(f"WITH {_KNOWN} SELECT policy, entity_id AS target_entity_id, CAST(asked AS INT) AS questions_asked, correct FROM g WHERE NOT correct OR asked >= 20")
def known_difficult(spark: SparkSession, folder: str) -> DataFrame:
    """The known games that failed or took 20 questions."""
    return simulate.difficult(known_games(spark, folder)).select("policy", "target_entity_id", "questions_asked", "correct")


@query(f"""WITH {_KNOWN}, s AS (SELECT policy, seed, avg(CAST(correct AS INT)) AS a, avg(asked) AS q, avg(left_over) AS r FROM g GROUP BY ALL)
SELECT policy, round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_sd, round(avg(q), 6) AS mean_questions_mean, round(stddev_pop(q), 6) AS mean_questions_sd,
round(avg(r), 6) AS mean_remaining_mean, round(stddev_pop(r), 6) AS mean_remaining_sd, round(avg(1 - a), 6) AS failure_rate_mean, round(stddev_pop(1 - a), 6) AS failure_rate_sd FROM s GROUP BY 1""")
def known_multi_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over seeds of the known games."""
    return _rounded(simulate.across_seeds(simulate.rates(known_games(spark, folder))))
