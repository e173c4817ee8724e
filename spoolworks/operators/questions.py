"""Questions: generation from a population, ids, profiles, redundancy, split scores and ranking.

A catalogue is small (at most MOST_QUESTIONS) and is held as Python metadata; everything about the entities stays in
Spark. All questions are answered in one projection, whose answers are counted by question before they are shuffled, so a
population is read once and a task sends one row for each question.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.text import strip
from spoolworks.operators import registry
from spoolworks.operators.predicates import NO, NO_ANSWER, YES, answer, fold_columns, folded, is_missing

MOST_QUESTIONS = 10_000

# Names of language codes.
LANGUAGES = {
    "ja": "Japanese", "en": "English", "fr": "French", "ko": "Korean", "zh": "Chinese", "hi": "Hindi", "es": "Spanish", "de": "German", "it": "Italian",
    "ru": "Russian", "pt": "Portuguese", "th": "Thai", "tl": "Tagalog", "id": "Indonesian", "ta": "Tamil", "te": "Telugu", "ml": "Malayalam", "bn": "Bengali",
}
# Names of country codes.
COUNTRIES = {
    "JP": "Japan", "US": "the United States", "GB": "the United Kingdom", "FR": "France", "KR": "South Korea", "CN": "China", "IN": "India", "DE": "Germany",
    "CA": "Canada", "IT": "Italy", "ES": "Spain", "AU": "Australia", "RU": "Russia", "HK": "Hong Kong",
}
# Media questions (value, text), decades, and year thresholds.
MEDIA = (("movie", "Is it a movie?"), ("tv", "Is it a TV series?"), ("anime", "Is it an anime?"))
DECADES = (1970, 1980, 1990, 2000, 2010, 2020)
YEARS = (1980, 1990, 2000, 2010, 2018, 2020)
# Threshold questions on numbers (family, feature, operator, value, text, reliability, answerability).
THRESHOLDS = (
    ("runtime", "runtime", "less_than", 60.0, "Is the runtime under 60 minutes?", 0.90, 0.80),
    ("runtime", "runtime", "greater_equal", 90.0, "Is the runtime 90 minutes (1.5 hours) or longer?", 0.90, 0.85),
    ("runtime", "runtime", "greater_equal", 120.0, "Is the runtime 2 hours (120 minutes) or longer?", 0.90, 0.85),
    ("episodes", "num_episodes", "equals", 1.0, "Is it a single episode or feature special?", 0.92, 0.90),
    ("episodes", "num_episodes", "greater_than", 12.0, "Does it have more than 12 episodes (more than 1 cour)?", 0.92, 0.85),
    ("episodes", "num_episodes", "greater_than", 24.0, "Does it have more than 24 episodes (2+ seasons or 2+ cours)?", 0.92, 0.85),
    ("episodes", "num_episodes", "greater_than", 50.0, "Does it have more than 50 episodes?", 0.92, 0.85),
    ("rating", "rating", "greater_equal", 7.0, "Is it highly rated (rating 7.0 out of 10 or higher)?", 0.85, 0.75),
    ("rating", "rating", "greater_equal", 8.0, "Is it critically acclaimed (rating 8.0 out of 10 or higher)?", 0.85, 0.75),
)


@dataclass(frozen=True)
class Question:
    """A predicate with its text and profile. Features that must not be asked about are refused."""

    text: str
    feature: str
    operator: str
    value: object
    family: str
    reliability: float = 1.0
    answerability: float = 1.0
    source: str = "structured_generator"
    coverage: float = 0.0
    balance: float = 0.0
    missingness: float = 0.0
    redundancy_group: str | None = None
    question_id: str = field(default="")

    def __post_init__(self) -> None:
        registry.DEFAULT.check(self.feature)
        if not self.question_id:
            object.__setattr__(self, "question_id", question_id(self.family, self.feature, self.operator, self.value))

    @property
    def value_text(self) -> str:
        """The value as stored: lists as JSON, others as text."""
        return json.dumps(self.value) if isinstance(self.value, (list, tuple, dict)) else str(self.value)

    @property
    def quality(self) -> float:
        """One figure out of balance, coverage, reliability and answerability."""
        return 0.4 * self.balance + 0.3 * self.coverage + 0.15 * self.reliability + 0.15 * self.answerability


def question_id(family: str, feature: str, operator: str, value: object) -> str:
    """The id of a question: its family and the first 12 hex digits of the SHA-256 of its predicate."""
    shown = list(value) if isinstance(value, tuple) else value
    return f"q_{family}_{hashlib.sha256(f'{family}:{feature}:{operator}:{shown}'.encode()).hexdigest()[:12]}"


def id_column(family: str, feature: str, operator: str, value: Column) -> Column:
    """:func:`question_id` as an expression."""
    text = F.concat(F.lit(f"{family}:{feature}:{operator}:"), value)
    return F.concat(F.lit(f"q_{family}_"), F.substr(F.sha2(text, 256), F.lit(1), F.lit(12)))


def element_counts(entities: DataFrame, values: Column, order: str = "entity_id") -> DataFrame:
    """``value, n, first_seen``: occurrences of list elements, and where each is first met in the order of ``order``."""
    return (
        entities.select(F.col(order).alias("at"), F.posexplode(values).alias("place", "value"))
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "place")).alias("first_seen"))
    )


def genre_questions(entities: DataFrame, least: int = 10) -> DataFrame:
    """``question_id, text, value, n, first_seen`` for every genre that occurs ``least`` times."""
    counts = element_counts(entities, F.transform("genres", strip)).where(F.col("n") >= least)
    low = F.lower("value")
    article = F.when(low.rlike("^[aeiou]"), "an").otherwise("a")
    text = F.when(low.rlike("^an? "), F.concat(F.lit("Is it "), F.col("value"), F.lit("?"))).otherwise(
        F.concat(F.lit("Is it "), article, F.lit(" "), F.col("value"), F.lit(" title?"))
    )
    return counts.select(id_column("genre", "genres", "contains", F.col("value")).alias("question_id"), text.alias("text"), "value", "n", "first_seen")


def _lookup(names: dict[str, str], code: Column, other: Column) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), other)


def _top(counts: DataFrame, n: int, least: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "first_seen").limit(n).where(F.col("n") >= least)


def language_questions(entities: DataFrame, top: int = 12, least: int = 5) -> DataFrame:
    """``question_id, text, value, n, first_seen``: the ``top`` languages, of which those that occur ``least`` times."""
    present = entities.where(~is_missing(F.col("original_language"), entities.schema["original_language"].dataType))
    rows = _top(element_counts(present, F.array(folded(F.col("original_language")))), top, least)
    text = F.concat(F.lit("Is the primary language "), _lookup(LANGUAGES, F.col("value"), F.upper("value")), F.lit("?"))
    return rows.select(id_column("language", "original_language", "equals", F.col("value")).alias("question_id"), text.alias("text"), "value", "n", "first_seen")


def country_questions(entities: DataFrame, top: int = 10, least: int = 5) -> DataFrame:
    """``question_id, text, value, n, first_seen``: the ``top`` countries, of which those that occur ``least`` times."""
    rows = _top(element_counts(entities, F.transform("origin_country", lambda x: F.upper(strip(x)))), top, least)
    text = F.concat(F.lit("Is it produced in or associated with "), _lookup(COUNTRIES, F.col("value"), F.col("value")), F.lit("?"))
    return rows.select(id_column("country", "origin_country", "contains", F.col("value")).alias("question_id"), text.alias("text"), "value", "n", "first_seen")


def fixed_questions(entities: DataFrame) -> dict[str, list[Question]]:
    """The questions that do not depend on counts, by family; a family is empty if no entity has a value for it."""
    numbers = ("runtime", "num_episodes", "rating")
    lacking = [c for c in ("media_type", "release_year", *numbers) if c not in entities.columns]
    df = entities.withColumns({c: F.lit(None).cast("string" if c == "media_type" else "double") for c in lacking})
    kinds = {c: df.schema[c].dataType for c in ("media_type", "release_year", *numbers)}
    year = F.when(~is_missing(F.col("release_year"), kinds["release_year"]), F.col("release_year"))
    there = df.agg(
        *[F.max((F.lower("media_type") == value)).alias(value) for value, _ in MEDIA],
        F.max(year.between(1900, 2030)).alias("time"),
        *[F.max(~is_missing(F.col(c), kinds[c])).alias(c) for c in numbers],
    ).first()
    found: dict[str, list[Question]] = {"media": [Question(text, "media_type", "equals", v, "media", 0.98, 1.0) for v, text in MEDIA if there[v]]}
    found["time"] = []
    if there["time"]:
        found["time"] = [Question(f"Was it released in the {d}s ({d}–{d + 9})?", "release_year", "between", [d, d + 9], "time", 0.95, 0.85) for d in DECADES]
        for year_ in YEARS:
            found["time"] += [Question(f"Was it released {word} {year_}?", "release_year", operator, year_, "time", 0.95, 0.90) for word, operator in (("after", "greater_than"), ("before", "less_than"))]
    for family, feature, operator, value, text, reliability, answerability in THRESHOLDS:
        found.setdefault(family, [])
        if there[feature]:
            found[family].append(Question(text, feature, operator, value, family, reliability, answerability))
    return found


def generate(entities: DataFrame, least_genre: int = 10) -> list[Question]:
    """The catalogue of a population: media, genre, language, country, time, runtime, episode and rating questions.

    Genres come in the order in which they are first met, languages and countries by number. Lists the table lacks give
    no questions. More than MOST_QUESTIONS genres are refused.
    """
    fixed = fixed_questions(entities)
    found = list(fixed["media"])
    makers = (
        ("genres", genre_questions(entities, least_genre).orderBy("first_seen") if "genres" in entities.columns else None, "contains", "genre", 0.90, 0.95),
        ("original_language", language_questions(entities).orderBy(F.desc("n"), "first_seen") if "original_language" in entities.columns else None, "equals", "language", 0.95, 0.90),
        ("origin_country", country_questions(entities).orderBy(F.desc("n"), "first_seen") if "origin_country" in entities.columns else None, "contains", "country", 0.92, 0.85),
    )
    for feature, rows, operator, family, reliability, answerability in makers:
        if rows is not None:
            got = rows.select("text", "value").limit(MOST_QUESTIONS + 1).collect()
            if len(got) > MOST_QUESTIONS:
                raise ValueError("too many questions")
            found += [Question(r.text, feature, operator, r.value, family, reliability, answerability) for r in got]
    return found + fixed["time"] + fixed["runtime"] + fixed["episodes"] + fixed["rating"]


CATALOGUE = (
    "pos int, question_id string, text string, feature string, operator string, value string, question_family string, source string, coverage double, "
    "reliability double, answerability double, balance double, missingness double, redundancy_group string"
)


def to_frame(spark: SparkSession, questions: Sequence[Question]) -> DataFrame:
    """The catalogue as a table, in its order."""
    rows = [
        (i, q.question_id, q.text, q.feature, q.operator, q.value_text, q.family, q.source, float(q.coverage), float(q.reliability), float(q.answerability), float(q.balance), float(q.missingness), q.redundancy_group)
        for i, q in enumerate(questions)
    ]
    return spark.createDataFrame(rows, CATALOGUE)


def read_value(feature: str, text: str) -> object:
    """The typed value of a stored one: lists are read as JSON, and numbers only for features that are compared as such."""
    if text[:1] in ("[", "{"):
        try:
            return json.loads(text)
        except ValueError:
            return text
    if registry.DEFAULT.uses.get(feature) == "transformed_question":
        for kind in (int, float):
            try:
                return kind(text)
            except ValueError:
                continue
    return text


def from_frame(df: DataFrame) -> list[Question]:
    """The catalogue of a table made by :func:`to_frame`."""
    return [
        Question(r.text, r.feature, r.operator, read_value(r.feature, r.value), r.question_family, r.reliability, r.answerability, r.source, r.coverage, r.balance, r.missingness, r.redundancy_group, r.question_id)
        for r in df.orderBy("pos").collect()
    ]


def save(df: DataFrame, parquet: str | None = None, json_lines: str | None = None) -> None:
    """Write a catalogue of :func:`to_frame` as Parquet, as JSON, or both, in its order."""
    ordered = df.orderBy("pos")
    if parquet:
        ordered.write.mode("overwrite").parquet(parquet)
    if json_lines:
        ordered.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(json_lines)  # a catalogue is small


def load(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue written by :func:`save`, whichever way."""
    kind = T._parse_datatype_string(CATALOGUE)
    return spark.read.schema(kind).json(path) if path.endswith(".json") else spark.read.schema(kind).parquet(path)


def by_id(questions: Sequence[Question], question_id: str) -> Question | None:
    """The question of that id, if there is one."""
    return next((q for q in questions if q.question_id == question_id), None)


def by_family(questions: Sequence[Question], family: str) -> list[Question]:
    """The questions of a family, in catalogue order."""
    return [q for q in questions if q.family == family]


def added(questions: Sequence[Question], *more: Question) -> list[Question]:
    """The catalogue with more questions at its end; one whose id is known takes the place of the former."""
    of = {q.question_id: q for q in questions}
    return list((of | {q.question_id: q for q in more}).values())


def answers(entities: DataFrame, questions: Sequence[Question]) -> tuple[DataFrame, list[Column]]:
    """The entities with the folded features, and one answer column for each question."""
    ready = fold_columns(entities, [q.feature for q in questions])
    return ready, [answer(ready, q.feature, q.operator, q.value) for q in questions]


def answer_counts(entities: DataFrame, questions: Sequence[Question], by: Sequence[str] = ()) -> DataFrame:
    """``by..., pos, yes, no, unknown, total`` of every question; without ``by`` also of a population without entities."""
    if not questions:
        return entities.select(*by).limit(0).selectExpr(*by, "0 AS pos", "0L AS yes", "0L AS no", "0L AS unknown", "0L AS total")
    ready, columns = answers(entities, questions)
    long = ready.select(*by, F.posexplode(F.array(*columns)).alias("pos", "ans"))
    count = {"yes": F.count_if(F.col("ans") == YES), "no": F.count_if(F.col("ans") == NO), "unknown": F.count_if(F.col("ans") == NO_ANSWER), "total": F.count(F.lit(1))}
    counts = long.groupBy(*by, "pos").agg(*[c.alias(n) for n, c in count.items()])
    if by:
        return counts
    every = F.broadcast(entities.sparkSession.range(len(questions)).select(F.col("id").cast("int").alias("pos")))
    return every.join(counts, "pos", "left").select("pos", *[F.coalesce(n, F.lit(0)).alias(n) for n in count])


def profile(entities: DataFrame, questions: Sequence[Question]) -> DataFrame:
    """``pos, yes, no, unknown, coverage, balance, missingness`` (shares to four places) of every question.

    Of no entities coverage and balance are 0 and missingness is 1.
    """
    total = F.col("total")
    share = lambda n: F.round(F.coalesce(F.try_divide(n, total), F.lit(0.0)), 4)
    least, most = F.least("yes", "no"), F.greatest("yes", "no")
    return answer_counts(entities, questions).select(
        "pos", "yes", "no", "unknown", share(F.col("yes") + F.col("no")).alias("coverage"),
        F.round(F.when(least > 0, F.try_divide(least, most)).otherwise(0.0), 4).alias("balance"),
        F.when(total > 0, share(F.col("unknown"))).otherwise(1.0).alias("missingness"),
    )


def qualify(entities: DataFrame, questions: Sequence[Question], coverage: float = 0.01, balance: float = 0.001) -> list[Question]:
    """The profiled questions that reach both thresholds, in catalogue order."""
    rows = {r.pos: r for r in profile(entities, questions).collect()}
    kept = []
    for i, q in enumerate(questions):
        if rows[i].coverage >= coverage and rows[i].balance >= balance:
            kept.append(replace(q, coverage=rows[i].coverage, balance=rows[i].balance, missingness=rows[i].missingness))
    return kept


def redundancy(entities: DataFrame, questions: Sequence[Question], probe: int = 200, order: str = "entity_id") -> DataFrame:
    """``pos, redundancy_group``: questions with the same answers on the first ``probe`` entities share a group.

    Groups are numbered in the order of their first question.
    """
    first, columns = answers(entities.orderBy(order).limit(probe), questions)
    long = first.select(F.col(order).alias("at"), F.posexplode(F.array(*columns)).alias("pos", "ans"))
    vectors = long.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ans"))), lambda x: x["ans"]).alias("vector"))
    numbered = vectors.withColumn("first", F.min("pos").over(Window.partitionBy("vector")))
    return numbered.select("pos", F.format_string("rg_%03d", F.dense_rank().over(Window.orderBy("first"))).alias("redundancy_group"))


def split_scores(counts: DataFrame) -> DataFrame:
    """Entropy of the answers (bits), expected remaining candidates and expected reduction, out of answer counts."""
    total = F.col("total").cast("double")
    p = {c: F.col(c) / total for c in ("yes", "no", "unknown")}
    entropy = sum((F.when(F.col(c) > 0, -p[c] * F.log2(p[c])).otherwise(0.0) for c in p), F.lit(0.0))
    remaining = p["yes"] * F.col("yes") + p["no"] * F.col("no") + p["unknown"] * total
    return counts.where(F.col("total") > 0).withColumns(
        {"yes_share": p["yes"], "no_share": p["no"], "unknown_share": p["unknown"], "entropy": entropy, "expected_remaining": remaining, "expected_reduction": 1 - remaining / total}
    )


def ranked(scores: DataFrame, catalogue: DataFrame, by: str = "entropy", asked: Sequence[str] = ()) -> DataFrame:
    """The questions not yet asked, best first: score, coverage, less missing, reliability, then catalogue order."""
    rows = scores.join(F.broadcast(catalogue), "pos").where(~F.col("question_id").isin(*asked) if asked else F.lit(True))
    share = (F.col("yes") + F.col("no")) / F.col("total")
    return rows.withColumn("answered", share).orderBy(F.desc(by), F.desc("answered"), "unknown_share", F.desc("reliability"), "pos")


def eliminate(entities: DataFrame, question: Question, given: int) -> DataFrame:
    """The candidates left after an answer: those with the same one, or all if there is none."""
    if given == NO_ANSWER:
        return entities
    return entities.where(answer(entities, question.feature, question.operator, question.value) == given)
