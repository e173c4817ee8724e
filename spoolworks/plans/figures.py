"""Queries on counts, distributions, samples and games."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.operators import audit, normalize, questions, simulate, stats, strata
from spoolworks.plans.guesser import U, universe
from spoolworks.plans.pipeline import _AUDIT, _BIN, _DECADE, _SAMPLE, canonical_rows, quarter
from spoolworks.session import materialise
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


# --- counts ---------------------------------------------------------------------------------------------------------


@query(f"WITH {U}, c AS (SELECT g AS value, count(*) AS n FROM (SELECT unnest(genres) AS g FROM u) WHERE g IS NOT NULL GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def value_counts_genres(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and share of every genre."""
    return audit.value_counts(canonical_rows(spark, folder), F.explode("genres")).withColumn("share", F.round("share", 6))


@query(f"WITH {U} SELECT status AS value, count(*) AS n FROM u GROUP BY 1")
def value_counts_null(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every status, null included."""
    return audit.value_counts(canonical_rows(spark, folder), F.col("status"), keep_null=True).select("value", "n")


@query("SELECT times, count(*) AS values FROM (SELECT entity_id, count(*) AS times FROM development_entities WHERE entity_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def histogram_of_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How many entities occur how many times in the loads."""
    return audit.histogram_of_counts(table(spark, folder, "development_entities"), F.col("entity_id"))


@query("""SELECT 'entity_id' AS name, count(*) - count(DISTINCT coalesce(entity_id, '~')) AS duplicates FROM canonical_entities
UNION ALL SELECT 'title_year', (SELECT count(*) FROM canonical_entities) - (SELECT count(*) FROM (SELECT DISTINCT title, release_year FROM canonical_entities))""")
def duplicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows beyond the first of an entity id, and of a title and year."""
    return audit.duplicates(table(spark, folder, "canonical_entities"), {"entity_id": ["entity_id"], "title_year": ["title", "release_year"]})


# The columns of the canonical table by kind.
_SCALARS = (
    "source", "source_id", "title", "original_title", "media_type", "source_media_type", "release_date", "release_year", "end_date", "original_language", "overview", "rating", "vote_count", "popularity",
    "rank", "favorites", "num_list_users", "status", "runtime", "num_episodes", "source_material", "tmdb_id", "mal_id", "entity_id", "match_confidence",
)
_LISTED = (
    "alternative_titles", "genres", "origin_country", "studios", "production_companies", "production_countries", "discovered_from", "source_presence", "keywords", "themes", "demographics", "relations",
)


def _sql_entry(column: str, kind: str) -> str:
    gone, value = (f"{column} IS NULL OR len({column}) = 0", f"len({column})") if kind == "list" else (f"{column} IS NULL", column)
    return f"SELECT '{column}' AS column_name, '{kind}' AS kind, count(*) FILTER ({gone}) AS missing, round(count(*) FILTER ({gone}) * 100 / count(*), 4) AS missing_percent, count(DISTINCT {value}) AS unique_values FROM u"


@query(f"WITH {U} " + " UNION ALL ".join([_sql_entry(c, "scalar") for c in _SCALARS] + [_sql_entry(c, "list") for c in _LISTED]))
def data_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, missing share and unique values of every column."""
    return audit.data_dictionary(canonical_rows(spark, folder))


@query(f"""WITH {U}, g AS (SELECT unnest(genres) AS genre, media_type FROM u) SELECT genre, count(*) FILTER (media_type = 'movie') AS movie, count(*) FILTER (media_type = 'tv') AS tv,
count(*) FILTER (media_type = 'anime_tv') AS anime_tv FROM g WHERE media_type IN ('movie', 'tv', 'anime_tv') GROUP BY genre""")
def pivot_genre_media(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by genre and media type."""
    rows = canonical_rows(spark, folder).select(F.explode("genres").alias("genre"), "media_type").where(F.col("media_type").isin("movie", "tv", "anime_tv"))
    return rows.groupBy("genre").pivot("media_type", ["movie", "tv", "anime_tv"]).count().fillna(0)


@query(f"WITH {U} SELECT media_type, count(title) AS title, count(overview) AS overview, count(rating) AS rating, count(runtime) AS runtime FROM u GROUP BY 1")
def nonnull_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Non-null values of four columns by media type."""
    return canonical_rows(spark, folder).groupBy("media_type").agg(*[F.count(c).alias(c) for c in ("title", "overview", "rating", "runtime")])


@query(f"""WITH {U}, c AS (SELECT original_language, media_type, count(*) AS n FROM u WHERE original_language IS NOT NULL AND media_type IS NOT NULL GROUP BY ALL),
m AS (SELECT *, max(n) OVER w AS top_n, sum(n) OVER w AS total FROM c WINDOW w AS (PARTITION BY original_language))
SELECT original_language, min(media_type) AS top, top_n, CAST(total AS BIGINT) AS total, round(top_n * 100 / total, 4) AS share FROM m WHERE n = top_n GROUP BY ALL""")
def crosstab_dominant(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest media type of each language."""
    return audit.dominant(canonical_rows(spark, folder), "original_language", "media_type").withColumn("share", F.round("share", 4))


@query(f"""WITH {U} SELECT coalesce(media_type, '?') AS media, count(*) AS entities, count(*) FILTER (len(origin_country) = 0) AS missing,
round(avg(CASE WHEN len(origin_country) = 0 THEN 1 ELSE 0 END) * 100, 4) AS missing_percent FROM u GROUP BY 1""")
def missing_countries(spark: SparkSession, folder: str) -> DataFrame:
    """Entities without countries by media type."""
    gone = F.when(F.size("origin_country") == 0, 1).otherwise(0)
    return canonical_rows(spark, folder).groupBy(F.coalesce("media_type", F.lit("?")).alias("media")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum(gone).alias("missing"), F.round(F.avg(gone) * 100, 4).alias("missing_percent")
    )


@query(f"WITH {_SAMPLE}, a AS (SELECT {_DECADE} AS decade, count(*) AS n FROM u GROUP BY 1), b AS (SELECT {_DECADE} AS decade, count(*) AS n FROM sample GROUP BY 1) SELECT decade, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (decade)")
def decade_before_after(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by decade before and after sampling."""
    rows, target = quarter(spark, folder)
    counts = lambda df: df.groupBy(normalize.decade_label(F.col("release_year")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))
    sample = strata.sample_diverse(rows.select("entity_id", "media_type", "release_year", "original_language"), target)
    return audit.aligned(counts(rows), counts(sample), "decade")


@query(f"WITH {U} SELECT round(sum(coalesce(len(genres), 0)) / count(*), 6) AS genres_per_entity, min(release_year) AS first_year, max(release_year) AS last_year, count(DISTINCT original_language) AS languages FROM u")
def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Genres per entity, range of years, languages."""
    return canonical_rows(spark, folder).agg(
        F.round(F.sum(F.coalesce(F.when(F.col("genres").isNotNull(), F.size("genres")), F.lit(0))) / F.count(F.lit(1)), 6).alias("genres_per_entity"),
        F.min("release_year").alias("first_year"), F.max("release_year").alias("last_year"), F.count_distinct("original_language").alias("languages"),
    )


@query("""SELECT 'rating' AS name, count(*) AS n FROM canonical_entities WHERE rating < 0 OR (rating > 10 AND NOT isnan(rating)) UNION ALL SELECT 'release_year', count(*) FROM canonical_entities WHERE release_year < 1890 OR release_year > 2030
UNION ALL SELECT 'blank_title', count(*) FROM canonical_entities WHERE trim(title) = ''""")
def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with an implausible rating or year, or a blank title."""
    rating, year = F.col("rating"), F.col("release_year")
    tests = {"rating": (rating < 0) | ((rating > 10) & ~F.isnan(rating)), "release_year": (year < 1890) | (year > 2030), "blank_title": F.trim("title") == ""}
    one = table(spark, folder, "canonical_entities").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in tests])))


# --- entropy and gain -----------------------------------------------------------------------------------------------

_FEATURES = ("media_type", "original_language", "status", "source_material", "release_year")
_ENTROPY = "SELECT '{0}' AS feature, CAST(sum(c) AS BIGINT) AS n, count(*) AS unique_values, round(max(c) / sum(c), 6) AS top_share, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT {1} AS v, count(*) AS c FROM u GROUP BY 1) WHERE v IS NOT NULL"


@query(f"WITH {U} " + " UNION ALL ".join(_ENTROPY.format(f, f) for f in _FEATURES) + " UNION ALL " + _ENTROPY.format("genres", "unnest(genres)"))
def entropy_by_feature(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy, distinct values and top share of six features."""
    rows = canonical_rows(spark, folder)
    every = [stats.feature_entropy(rows, f) for f in _FEATURES] + [stats.feature_entropy(rows, "genres", F.explode("genres"))]
    return reduce(DataFrame.unionByName, every).withColumns({c: F.round(c, 6) for c in ("top_share", "entropy")})


@query(f"""WITH {U}, n AS (SELECT count(*) AS total FROM u), c AS (SELECT media_type AS value, count(*) AS yes FROM u WHERE media_type IS NOT NULL GROUP BY 1)
SELECT value, yes, total - yes AS no, round(yes * 100 / total, 4) AS yes_percent, CASE WHEN total > yes THEN round(log2(total) - (yes / total * log2(yes) + (total - yes) / total * log2(total - yes)), 6) END AS gain FROM c, n""")
def info_gain_values(spark: SparkSession, folder: str) -> DataFrame:
    """Information gained by asking for each media type, by the number of candidates."""
    rows = canonical_rows(spark, folder)
    counts = rows.where(F.col("media_type").isNotNull()).groupBy(F.col("media_type").alias("value")).agg(F.count(F.lit(1)).alias("yes"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    both = counts.join(F.broadcast(total)).withColumn("no", F.col("total") - F.col("yes"))  # one row
    p, q = F.col("yes") / F.col("total"), F.col("no") / F.col("total")
    gain = F.when(F.col("no") > 0, F.round(F.log2("total") - (p * F.log2("yes") + q * F.log2("no")), 6))
    return both.select("value", "yes", "no", F.round(p * 100, 4).alias("yes_percent"), gain.alias("gain"))


_PART = "CASE WHEN {0} > 0 AND {0} < 1 THEN -{0} * log2({0}) - (1 - {0}) * log2(1 - {0}) ELSE 0 END"


@query(f"""WITH {U}, r AS (SELECT CAST({_AUDIT} = 'anime' AS INT) AS t, {_BIN} AS b FROM u), a AS (SELECT count(*) AS n, avg(t) AS p FROM r),
i AS (SELECT sum(c / n * {_PART.format('q')}) AS h FROM (SELECT b, count(*) AS c, avg(t) AS q FROM r WHERE b IS NOT NULL GROUP BY 1), a)
SELECT round({_PART.format('p')}, 6) AS root_entropy, round(h, 6) AS conditional_entropy, round({_PART.format('p')} - h, 6) AS gain FROM a, i""")
def info_gain_bins(spark: SparkSession, folder: str) -> DataFrame:
    """What the year's bin says about being anime."""
    rows = canonical_rows(spark, folder)
    anime = normalize.audit_media_group(F.col("source"), F.col("media_type")) == "anime"
    gain = stats.information_gain(rows, anime, normalize.year_bin(F.col("release_year")))
    return gain.select(*[F.round(c, 6).alias(c) for c in gain.columns])


@query(f"""WITH {U}, a AS (SELECT * FROM u WHERE {_AUDIT} = 'anime'), n AS (SELECT count(*) AS n FROM a)
SELECT 'language' AS feature, original_language AS value, round(count(*) / any_value(n), 6) AS p FROM a, n WHERE original_language IS NOT NULL GROUP BY 2
UNION ALL SELECT 'genre', g, round(count(*) / any_value(n), 6) FROM (SELECT unnest(genres) AS g FROM a), n WHERE g IS NOT NULL GROUP BY 2""")
def anime_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of languages and genres among anime."""
    rows = canonical_rows(spark, folder)
    rows = rows.where(normalize.audit_media_group(F.col("source"), F.col("media_type")) == "anime")
    total = rows.agg(F.count(F.lit(1)))
    parts = (("language", F.col("original_language")), ("genre", F.explode("genres")))
    every = [audit.value_counts(rows, v).select(F.lit(f).alias("feature"), "value", "n") for f, v in parts]
    return reduce(DataFrame.unionByName, every).select("feature", "value", F.round(F.col("n") / total.scalar(), 6).alias("p"))


# --- samples --------------------------------------------------------------------------------------------------------


def _with_sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, target = quarter(spark, folder)
    return rows, strata.sample_diverse(rows.select("entity_id", "media_type", "release_year", "original_language", "popularity", "vote_count", "rating", "source"), target)


_AT = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query(f"WITH {U} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, {', '.join(f'round(quantile_cont(v, {q}), 4) AS p{int(q * 100)}' for q in _AT)} FROM (SELECT {c}::DOUBLE AS v FROM u) WHERE v IS NOT NULL AND NOT isnan(v)"
    for c in ("popularity", "vote_count", "rating")
))
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, deviation and percentiles of popularity, votes and rating."""
    rows = canonical_rows(spark, folder)
    every = [stats.describe(rows.select(F.col(c).cast("double").alias(c)), c).select(F.lit(c).alias("name"), "*") for c in ("popularity", "vote_count", "rating")]
    out = reduce(DataFrame.unionByName, every)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c not in ("name", "n")})


_CLEAN = "(SELECT popularity AS v FROM {0} WHERE popularity IS NOT NULL AND NOT isnan(popularity))"


@query(f"""WITH {_SAMPLE}, x AS (SELECT count(*) AS n1, avg(v) AS m1, stddev_samp(v) AS s1 FROM {_CLEAN.format('u')}), y AS (SELECT count(*) AS n2, avg(v) AS m2, stddev_samp(v) AS s2 FROM {_CLEAN.format('sample')})
SELECT round((m2 - m1) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 6) AS smd FROM x, y""")
def smd(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised mean difference of popularity between table and sample."""
    return stats.mean_difference(*_with_sample(spark, folder), "popularity").select(F.round("smd", 6).alias("smd"))


@query(f"""WITH {_SAMPLE}, c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT v, 1 AS a, 0 AS b FROM {_CLEAN.format('u')} UNION ALL SELECT v, 0, 1 FROM {_CLEAN.format('sample')}) GROUP BY v),
k AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb FROM c)
SELECT round(max(abs(fa - fb)), 6) AS ks, round(sum(abs(fa - fb) * (nv - v)), 4) AS wasserstein FROM k""")
def ks_wasserstein(spark: SparkSession, folder: str) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein distance of popularity between table and sample."""
    return stats.distances(*_with_sample(spark, folder), "popularity").select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"))


_WEIGHTS = f"{_SAMPLE}, dw AS (SELECT stratum, population, sampled, population / sampled AS weight FROM (SELECT {_AUDIT} AS stratum, count(*) AS population FROM u GROUP BY 1) JOIN (SELECT {_AUDIT} AS stratum, count(*) AS sampled FROM sample GROUP BY 1) USING (stratum))"


@query(f"WITH {_WEIGHTS} SELECT stratum, population, sampled, round(weight, 6) AS weight FROM dw")
def design_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a sampled row of each media group stands for."""
    rows, sample = _with_sample(spark, folder)
    return stats.design_weights(rows, sample, normalize.audit_media_group(F.col("source"), F.col("media_type"))).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_WEIGHTS}, ww AS (SELECT s.entity_id, s.popularity AS v, coalesce(weight, 1.0) AS w FROM (SELECT *, {_AUDIT} AS stratum FROM sample) s LEFT JOIN dw USING (stratum) WHERE s.popularity IS NOT NULL AND NOT isnan(s.popularity)),
pq AS (SELECT v, (sum(w) OVER (ORDER BY v, entity_id) - w / 2) / sum(w) OVER () AS pl FROM ww),
qq AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) t(quantile)),
bb AS (SELECT quantile, arg_max(v, pl) FILTER (pl <= quantile) AS lv, max(pl) FILTER (pl <= quantile) AS la, arg_min(v, pl) FILTER (pl >= quantile) AS hv, min(pl) FILTER (pl >= quantile) AS ha FROM pq, qq GROUP BY 1)
SELECT quantile, round(CASE WHEN la IS NULL THEN hv WHEN ha IS NULL OR ha = la THEN lv ELSE lv + (quantile - la) / (ha - la) * (hv - lv) END, 4) AS value FROM bb""")
def weighted_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of popularity of the reweighted sample."""
    rows, sample = _with_sample(spark, folder)
    group = normalize.audit_media_group(F.col("source"), F.col("media_type"))
    weights = stats.design_weights(rows, sample, group).select("stratum", "weight")
    weighted = sample.withColumn("stratum", group).join(F.broadcast(weights), "stratum", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))  # four strata
    return stats.weighted_quantiles(weighted, "popularity", "weight", [0.5, 0.9, 0.95], ["entity_id"]).withColumn("value", F.round("value", 4))


@query(f"""WITH {U}, w AS (SELECT entity_id, CASE WHEN x > 0 THEN x ELSE 0.001 END AS w FROM (SELECT entity_id, ln(1 + greatest(coalesce(CASE WHEN isnan(popularity) THEN 0 ELSE popularity END, 0), 0) + greatest(coalesce(vote_count, 0), 0)) AS x FROM u))
SELECT entity_id, round(sum(w) OVER (ORDER BY w, entity_id) / sum(w) OVER (), 6) AS upto FROM w""")
def target_weighted_cdf(spark: SparkSession, folder: str) -> DataFrame:
    """Running share of the popularity weights by which targets are chosen."""
    rows = universe(spark, folder)
    weight = simulate.target_weight()
    weighted = rows.select("entity_id", F.when(weight > 0, weight).otherwise(0.001).alias("w"))
    total = weighted.agg(F.sum("w"))
    return stats.running(weighted, "w", ["w"], ["entity_id"]).select("entity_id", F.round(F.col("upto_w") / total.scalar(), 6).alias("upto"))


# --- games ----------------------------------------------------------------------------------------------------------

# The reference's default workload, 9,000 games.
GAMES = {"policies": ("entropy", "expected_reduction", "random"), "seeds": (42, 123, 999), "games": 1000}


_PLAYED: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def _games(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The results of the games and the number of candidates; played once for each folder and application."""
    key = spark.sparkContext.applicationId, folder
    if key not in _PLAYED:
        rows = universe(spark, folder)
        found = questions.qualify(rows, questions.generate(rows))
        _PLAYED[key] = materialise(simulate.run_games(rows, found, **GAMES), "games"), rows.count()
    return _PLAYED[key]


@query()
def benchmark_games(spark: SparkSession, folder: str) -> DataFrame:
    """Results of games over all entities for three policies and three seeds."""
    return _games(spark, folder)[0].drop("history", "emptied")


@query()
def metrics_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and effort of the games by policy and seed."""
    return simulate.rates(_games(spark, folder)[0])


@query()
def metrics_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Remaining candidates by step."""
    return simulate.reduction_curve(*_games(spark, folder))


@query()
def metrics_family(spark: SparkSession, folder: str) -> DataFrame:
    """Use and effect of the question families."""
    return simulate.family_use(*_games(spark, folder))


@query()
def metrics_difficult(spark: SparkSession, folder: str) -> DataFrame:
    """Games that failed or took 20 questions."""
    return simulate.difficult(_games(spark, folder)[0]).drop("history", "emptied")


@query()
def metrics_multi_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation over seeds by policy."""
    return simulate.across_seeds(simulate.rates(_games(spark, folder)[0]))
