"""Queries on questions, predicates and split scores over the canonical entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.operators import predicates, questions
from spoolworks.sources.tables import table

FEATURES = ("media_type", "genres", "original_language", "origin_country", "release_year", "runtime", "num_episodes", "rating", "status", "end_date", "keywords")


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical entities, one row for each entity_id (repeated rows have the same content)."""
    rows = table(spark, folder, "canonical_entities").where(F.col("entity_id").isNotNull())
    return rows.select("entity_id", "title", *FEATURES, "popularity", "vote_count").dropDuplicates(["entity_id"])


def catalogue(spark: SparkSession, folder: str) -> tuple[DataFrame, list[questions.Question]]:
    """The entities, and the questions generated from them."""
    entities = universe(spark, folder)
    return entities, questions.generate(entities)


# --- predicates -----------------------------------------------------------------------------------------------------

#: The predicates shown by the state queries: name -> (feature, operator, value).
STATES = {
    "equals": ("media_type", "equals", " Movie "),
    "contains_list": ("genres", "contains", "drama"),
    "contains_text": ("title", "contains", "the"),
    "gte": ("rating", "gte", 7),
    "lte": ("runtime", "lte", 90),
    "gt": ("release_year", "greater_than", 2010),
    "lt": ("release_year", "lt", 1990),
    "in_set": ("original_language", "in_set", ["ja", "KO", "zh"]),
    "between": ("release_year", "between", [1990, 1999]),
    "not_applicable": ("num_episodes", "greater_than", 12),
    "mixed_kinds": ("media_type", "equals", 5),
    "unparsable": ("title", "gte", 3),
    "unknown_operator": ("rating", "resembles", 3),
    "absent_feature": ("mood", "equals", "sad"),
}


def _state_query(feature: str, operator: str, value: object):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        entities = universe(spark, folder)
        return entities.select("entity_id", predicates.state(entities, feature, operator, value).alias("state"))

    return query


def missingness(spark: SparkSession, folder: str) -> DataFrame:
    """Null and missing values of every column of the canonical table."""
    return predicates.missing_counts(table(spark, folder, "canonical_entities"))


# --- questions ------------------------------------------------------------------------------------------------------


def gen_genre(spark: SparkSession, folder: str) -> DataFrame:
    """Genre questions with their counts."""
    return questions.genre_questions(universe(spark, folder)).drop("first_seen")


def gen_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language questions with their counts."""
    return questions.language_questions(universe(spark, folder)).drop("first_seen")


def gen_country(spark: SparkSession, folder: str) -> DataFrame:
    """Country questions with their counts."""
    return questions.country_questions(universe(spark, folder)).drop("first_seen")


def _frame(spark: SparkSession, folder: str) -> tuple[DataFrame, list[questions.Question], DataFrame]:
    entities, found = catalogue(spark, folder)
    return entities, found, questions.to_frame(spark, found)


def question_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All questions in catalogue order."""
    return _frame(spark, folder)[2].select("pos", "question_id", "text", "feature", "operator", "value", "question_family", "reliability", "answerability")


def profile_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Answer counts, coverage, balance and missingness of every question."""
    entities, found, frame = _frame(spark, folder)
    return questions.profile(entities, found).join(F.broadcast(frame.select("pos", "question_id")), "pos").drop("pos")


def profile_qualified(spark: SparkSession, folder: str) -> DataFrame:
    """The questions that reach the thresholds, with their quality."""
    entities, found = catalogue(spark, folder)
    kept = questions.qualify(entities, found)
    return spark.createDataFrame([(q.question_id, q.coverage, q.balance, round(q.quality, 6)) for q in kept], "question_id string, coverage double, balance double, quality double")


def redundancy_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of questions with the same answers on the first 200 entities."""
    entities, found, frame = _frame(spark, folder)
    return questions.redundancy(entities, found).join(F.broadcast(frame.select("pos", "question_id")), "pos").select("question_id", "redundancy_group")


def split_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Split scores of every question over all entities."""
    entities, found, frame = _frame(spark, folder)
    scores = questions.split_scores(questions.answer_counts(entities, found))
    rounded = {c: F.round(c, 6) for c in ("yes_share", "no_share", "unknown_share", "entropy", "expected_reduction")} | {"expected_remaining": F.round("expected_remaining", 3)}
    return scores.withColumns(rounded).join(F.broadcast(frame.select("pos", "question_id")), "pos").drop("pos")


def _top(by: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        entities, found, frame = _frame(spark, folder)
        scores = questions.split_scores(questions.answer_counts(entities, found)).withColumn(by, F.round(by, 9))
        return questions.ranked(scores, frame, by).limit(20).select("question_id", "text", "yes", "no", "unknown", F.round(by, 6).alias("score"))

    return query


split_scores_top20 = _top("entropy")
split_scores_top20_reduction = _top("expected_reduction")


def elimination_step(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates left after YES to the first movie question and no answer to the second question."""
    entities = universe(spark, folder)
    movie = questions.Question("Is it a movie?", "media_type", "equals", "movie", "media")
    drama = questions.Question("Is it a Drama title?", "genres", "contains", "Drama", "genre")
    left = questions.eliminate(questions.eliminate(entities, movie, predicates.YES), drama, predicates.NO_ANSWER)
    return questions.eliminate(left, drama, predicates.NO).select("entity_id")


QUERIES = {f"state_{name}": _state_query(*of) for name, of in STATES.items()}
QUERIES |= {
    f.__name__: f
    for f in (missingness, gen_genre, gen_language, gen_country, question_catalogue, profile_questions, profile_qualified, redundancy_groups, split_scores, elimination_step)
}
QUERIES |= {"split_scores_top20": split_scores_top20, "split_scores_top20_reduction": split_scores_top20_reduction}

# --- SQL ------------------------------------------------------------------------------------------------------------

MISSING = "('', 'nan', 'none', 'null', '[]', '{}')"
U = "u AS (SELECT DISTINCT ON (entity_id) * FROM canonical_entities WHERE entity_id IS NOT NULL)"


def sql_strip(x: str) -> str:
    """Trimmed of white space."""
    return rf"regexp_replace({x}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"


def sql_fold(x: str) -> str:
    """Trimmed and in lower case."""
    return f"lower({sql_strip(x)})"


def _sql_missing(feature: str) -> str:
    if feature in ("genres", "origin_country", "keywords"):
        return f"({feature} IS NULL OR len({feature}) = 0)"
    if feature in ("rating", "runtime"):
        return f"({feature} IS NULL OR isnan({feature}))"
    if feature in ("release_year", "num_episodes"):
        return f"({feature} IS NULL)"
    return f"({feature} IS NULL OR {sql_fold(feature)} IN {MISSING})"


def _sql_state(test: str, feature: str) -> str:
    applicable = "WHEN media_type = 'movie' THEN 'not_applicable' " if feature == "num_episodes" else ""
    return f"WITH {U} SELECT entity_id, CASE {applicable}WHEN {_sql_missing(feature)} THEN 'unknown' WHEN {test} THEN 'known_true' ELSE 'known_false' END AS state FROM u"


SQL = {
    "state_equals": _sql_state(f"{sql_fold('media_type')} = 'movie'", "media_type"),
    "state_contains_list": _sql_state(f"len(list_filter(genres, lambda x: {sql_fold('x')} = 'drama')) > 0", "genres"),
    "state_contains_text": _sql_state(f"contains({sql_fold('title')}, 'the')", "title"),
    "state_gte": _sql_state("rating >= 7", "rating"),
    "state_lte": _sql_state("runtime <= 90", "runtime"),
    "state_gt": _sql_state("release_year > 2010", "release_year"),
    "state_lt": _sql_state("release_year < 1990", "release_year"),
    "state_in_set": _sql_state(f"{sql_fold('original_language')} IN ('ja', 'ko', 'zh')", "original_language"),
    "state_between": _sql_state("release_year BETWEEN 1990 AND 1999", "release_year"),
    "state_not_applicable": _sql_state("num_episodes > 12", "num_episodes"),
    "state_mixed_kinds": _sql_state("false", "media_type"),
    "state_unparsable": f"WITH {U} SELECT entity_id, CASE WHEN {_sql_missing('title')} OR TRY_CAST(title AS DOUBLE) IS NULL THEN 'unknown' WHEN TRY_CAST(title AS DOUBLE) >= 3 THEN 'known_true' ELSE 'known_false' END AS state FROM u",
    "state_unknown_operator": f"WITH {U} SELECT entity_id, 'unknown' AS state FROM u",
    "state_absent_feature": f"WITH {U} SELECT entity_id, 'unknown' AS state FROM u",
}

_COLUMNS = {
    "text": "source title original_title media_type source_media_type release_date end_date original_language overview status source_material entity_id match_confidence".split(),
    "double": "rating popularity runtime".split(),
    "list": "alternative_titles genres origin_country studios production_companies production_countries discovered_from source_presence keywords themes demographics relations".split(),
    "other": "source_id release_year vote_count rank favorites num_list_users num_episodes tmdb_id mal_id".split(),
}
_TEST = {"text": lambda c: f"{sql_fold(c)} IN {MISSING}", "double": lambda c: f"isnan({c})", "list": lambda c: f"len({c}) = 0", "other": lambda c: "false"}
SQL["missingness"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(*) FILTER ({c} IS NULL OR {_TEST[k](c)}) AS missing FROM canonical_entities"
    for k, names in _COLUMNS.items()
    for c in names
)


def _sql_id(family: str, feature: str, operator: str, value: str = "value") -> str:
    return f"'q_{family}_' || substr(sha256('{family}:{feature}:{operator}:' || {value}), 1, 12)"


def _sql_names(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


_GENRES = f"""g AS (SELECT value, count(*) AS n, min((entity_id, place)) AS seen FROM
  (SELECT entity_id, unnest(range(len(genres))) AS place, {sql_strip('unnest(genres)')} AS value FROM u) WHERE value <> '' GROUP BY value HAVING count(*) >= 10),
genre AS (SELECT row_number() OVER (ORDER BY seen) AS k, value, n, {_sql_id('genre', 'genres', 'contains')} AS question_id,
  CASE WHEN regexp_matches(lower(value), '^an? ') THEN 'Is it ' || value || '?' ELSE 'Is it ' || CASE WHEN regexp_matches(lower(value), '^[aeiou]') THEN 'an ' ELSE 'a ' END || value || ' title?' END AS text FROM g)"""
_LANGUAGES = f"""l AS (SELECT {sql_fold('original_language')} AS value, count(*) AS n, min(entity_id) AS seen FROM u
  WHERE NOT {_sql_missing('original_language')} GROUP BY 1),
lt AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen) AS k FROM l),
language AS (SELECT k, value, n, {_sql_id('language', 'original_language', 'equals')} AS question_id,
  'Is the primary language ' || coalesce({_sql_names(questions.LANGUAGES)}[value], upper(value)) || '?' AS text FROM lt WHERE k <= 12 AND n >= 5)"""
_COUNTRIES = f"""c AS (SELECT value, count(*) AS n, min((entity_id, place)) AS seen FROM
  (SELECT entity_id, unnest(range(len(origin_country))) AS place, upper({sql_strip('unnest(origin_country)')}) AS value FROM u) WHERE value <> '' GROUP BY value),
ct AS (SELECT *, row_number() OVER (ORDER BY n DESC, seen) AS k FROM c),
country AS (SELECT k, value, n, {_sql_id('country', 'origin_country', 'contains')} AS question_id,
  'Is it produced in or associated with ' || coalesce({_sql_names(questions.COUNTRIES)}[value], value) || '?' AS text FROM ct WHERE k <= 10 AND n >= 5)"""
for _name, _cte, _table in (("gen_genre", _GENRES, "genre"), ("gen_language", _LANGUAGES, "language"), ("gen_country", _COUNTRIES, "country")):
    SQL[_name] = f"WITH {U}, {_cte} SELECT question_id, text, value, n FROM {_table}"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_fixed() -> str:
    """The fixed questions as VALUES (family number, k, family, feature, operator, value, text, reliability, answerability, low, high)."""
    rows = [(0, i, "media", "media_type", "equals", v, text, 0.98, 1.0, None, None) for i, (v, text) in enumerate(questions.MEDIA)]
    rows += [
        (4, i, "time", "release_year", "between", f"[{d}, {d + 9}]", f"Was it released in the {d}s ({d}–{d + 9})?", 0.95, 0.85, d, d + 9)
        for i, d in enumerate(questions.DECADES)
    ]
    for i, y in enumerate(questions.YEARS):
        rows.append((4, 10 + 2 * i, "time", "release_year", "greater_than", str(y), f"Was it released after {y}?", 0.95, 0.90, y, None))
        rows.append((4, 11 + 2 * i, "time", "release_year", "less_than", str(y), f"Was it released before {y}?", 0.95, 0.90, y, None))
    number = {"runtime": 5, "episodes": 6, "rating": 7}
    for i, (family, feature, operator, value, text, r, a) in enumerate(questions.THRESHOLDS):
        rows.append((number[family], i, family, feature, operator, str(value), text, r, a, value, None))
    show = lambda x: "NULL" if x is None else _quoted(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(show(x) for x in row) + ")" for row in rows) + ")"


SQL_QUESTIONS = f"""{U}, {_GENRES}, {_LANGUAGES}, {_COUNTRIES},
fixed AS (SELECT * FROM {_sql_fixed()} AS t(f, k, family, feature, operator, value, text, reliability, answerability, low, high)
  WHERE CASE feature WHEN 'media_type' THEN value IN (SELECT lower(media_type) FROM u) WHEN 'release_year' THEN EXISTS (SELECT 1 FROM u WHERE release_year BETWEEN 1900 AND 2030)
    WHEN 'runtime' THEN EXISTS (SELECT 1 FROM u WHERE runtime IS NOT NULL AND NOT isnan(runtime)) WHEN 'num_episodes' THEN EXISTS (SELECT 1 FROM u WHERE num_episodes IS NOT NULL)
    ELSE EXISTS (SELECT 1 FROM u WHERE rating IS NOT NULL AND NOT isnan(rating)) END),
everyone AS (
  SELECT f, k, 'q_' || family || '_' || substr(sha256(family || ':' || feature || ':' || operator || ':' || value), 1, 12) AS question_id, text, feature, operator, value, family AS question_family, reliability, answerability, low, high FROM fixed
  UNION ALL SELECT 1, k, question_id, text, 'genres', 'contains', value, 'genre', 0.90, 0.95, NULL, NULL FROM genre
  UNION ALL SELECT 2, k, question_id, text, 'original_language', 'equals', value, 'language', 0.95, 0.90, NULL, NULL FROM language
  UNION ALL SELECT 3, k, question_id, text, 'origin_country', 'contains', value, 'country', 0.92, 0.85, NULL, NULL FROM country),
q AS (SELECT *, row_number() OVER (ORDER BY f, k) - 1 AS pos FROM everyone)"""

_NUMBER = "CASE feature WHEN 'release_year' THEN CAST(release_year AS DOUBLE) WHEN 'runtime' THEN runtime WHEN 'num_episodes' THEN CAST(num_episodes AS DOUBLE) ELSE rating END"
SQL_ANSWERS = f"""{SQL_QUESTIONS},
w AS (SELECT entity_id, media_type, release_year, runtime, num_episodes, rating, {sql_fold('media_type')} AS fm, {sql_fold('original_language')} AS fl,
  list_transform(genres, lambda x: {sql_fold('x')}) AS fg, list_transform(origin_country, lambda x: {sql_fold('x')}) AS fc FROM u),
x AS (SELECT q.pos, q.question_id, w.entity_id, q.feature, q.operator, lower(q.value) AS v, low, high, fm, fl, fg, fc, media_type, {_NUMBER} AS num FROM q CROSS JOIN w),
a AS (SELECT pos, question_id, entity_id, CASE
  WHEN feature = 'media_type' THEN CASE WHEN fm IS NULL OR fm IN {MISSING} THEN 2 WHEN fm = v THEN 1 ELSE 0 END
  WHEN feature = 'original_language' THEN CASE WHEN fl IS NULL OR fl IN {MISSING} THEN 2 WHEN fl = v THEN 1 ELSE 0 END
  WHEN feature = 'genres' THEN CASE WHEN fg IS NULL OR len(fg) = 0 THEN 2 WHEN list_contains(fg, v) THEN 1 ELSE 0 END
  WHEN feature = 'origin_country' THEN CASE WHEN fc IS NULL OR len(fc) = 0 THEN 2 WHEN list_contains(fc, v) THEN 1 ELSE 0 END
  WHEN feature = 'num_episodes' AND media_type = 'movie' THEN 2
  WHEN num IS NULL OR isnan(num) THEN 2
  WHEN operator = 'between' THEN CAST(num BETWEEN low AND high AS INT) WHEN operator = 'greater_than' THEN CAST(num > low AS INT)
  WHEN operator = 'less_than' THEN CAST(num < low AS INT) WHEN operator = 'greater_equal' THEN CAST(num >= low AS INT) ELSE CAST(num = low AS INT) END AS ans FROM x),
n AS (SELECT pos, question_id, count(*) FILTER (ans = 1) AS yes, count(*) FILTER (ans = 0) AS no, count(*) FILTER (ans = 2) AS unknown, count(*) AS total FROM a GROUP BY ALL),
p AS (SELECT *, round((yes + no) / total, 4) AS coverage, round(CASE WHEN yes = 0 OR no = 0 THEN 0 ELSE least(yes, no) / greatest(yes, no) END, 4) AS balance, round(unknown / total, 4) AS missingness FROM n),
s AS (SELECT *, yes / total AS py, no / total AS pn, unknown / total AS pu,
  CASE WHEN yes > 0 THEN -yes / total * log2(yes / total) ELSE 0 END + CASE WHEN no > 0 THEN -no / total * log2(no / total) ELSE 0 END + CASE WHEN unknown > 0 THEN -unknown / total * log2(unknown / total) ELSE 0 END AS h,
  yes / total * yes + no / total * no + unknown / total * total AS e FROM n)"""

SQL["question_catalogue"] = f"WITH {SQL_QUESTIONS} SELECT pos, question_id, text, feature, operator, value, question_family, reliability, answerability FROM q"
SQL["profile_questions"] = f"WITH {SQL_ANSWERS} SELECT question_id, yes, no, unknown, coverage, balance, missingness FROM p"
SQL["profile_qualified"] = (
    f"WITH {SQL_ANSWERS} SELECT question_id, coverage, balance, round(0.4 * balance + 0.3 * coverage + 0.15 * reliability + 0.15 * answerability, 6) AS quality "
    "FROM p JOIN q USING (question_id) WHERE coverage >= 0.01 AND balance >= 0.001"
)
SQL["redundancy_groups"] = f"""WITH {SQL_ANSWERS},
f200 AS (SELECT entity_id FROM u ORDER BY entity_id LIMIT 200),
vec AS (SELECT pos, question_id, list(ans ORDER BY entity_id) AS v FROM a SEMI JOIN f200 USING (entity_id) GROUP BY ALL),
fst AS (SELECT *, min(pos) OVER (PARTITION BY v) AS fp FROM vec)
SELECT question_id, printf('rg_%03d', dense_rank() OVER (ORDER BY fp)) AS redundancy_group FROM fst"""
SQL["split_scores"] = f"""WITH {SQL_ANSWERS} SELECT question_id, yes, no, unknown, total, round(py, 6) AS yes_share, round(pn, 6) AS no_share, round(pu, 6) AS unknown_share,
round(h, 6) AS entropy, round(e, 3) AS expected_remaining, round(1 - e / total, 6) AS expected_reduction FROM s"""
for _name, _score in (("split_scores_top20", "h"), ("split_scores_top20_reduction", "1 - e / total")):
    SQL[_name] = f"""WITH {SQL_ANSWERS} SELECT question_id, text, yes, no, unknown, round({_score}, 6) AS score FROM s JOIN q USING (question_id)
ORDER BY round({_score}, 9) DESC, (yes + no) / total DESC, pu, reliability DESC, q.pos LIMIT 20"""
SQL["elimination_step"] = f"""WITH {U} SELECT entity_id FROM u WHERE {sql_fold('media_type')} = 'movie' AND len(genres) > 0 AND len(list_filter(genres, lambda x: {sql_fold('x')} = 'drama')) = 0"""
