"""From raw records to the staging schema: keeping first records, merging strategies, recoding, years, genres, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.text import nfkc, strip

STAGING = (
    "source STRING, source_id BIGINT, title STRING, original_title STRING, alternative_titles ARRAY<STRING>, media_type STRING, source_media_type STRING, "
    "release_date STRING, release_year INT, end_date STRING, genres ARRAY<STRING>, original_language STRING, origin_country ARRAY<STRING>, overview STRING, "
    "rating DOUBLE, vote_count BIGINT, popularity DOUBLE, rank BIGINT, favorites BIGINT, num_list_users BIGINT, studios ARRAY<STRING>, "
    "production_companies ARRAY<STRING>, production_countries ARRAY<STRING>, status STRING, runtime DOUBLE, num_episodes BIGINT, source_material STRING, "
    "discovered_from ARRAY<STRING>"
)

# Media types of the second source, where they differ in the staging schema.
RECODED_MEDIA = {"tv": "anime_tv", "movie": "anime_movie"}
# Genres that stand for several, or for another one.
GENRE_PARTS = {
    "Action & Adventure": ("Action", "Adventure"),
    "Sci-Fi & Fantasy": ("Science Fiction", "Fantasy"),
    "War & Politics": ("War", "Politics"),
    "Sci-Fi": ("Science Fiction",),
    "Historical": ("History",),
}
# Patterns of title modifiers and the tags they give.
MODIFIERS = (
    (r"\bseason\s*(\d+)\b", "season_"),
    (r"\bpart\s*(\d+)\b", "part_"),
    (r"\b(\d+)(?:st|nd|rd|th)\s*season\b", "season_"),
    (r"\b(\d+)\b", "num_"),
)
MODIFIER_WORDS = ("movie", "ova", "ona", "special", "brotherhood", "shippuden", "final")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; rows with a null in the key are dropped.

    The rows are combined on the map side, so a key that a third of all rows have is no burden. Ties go to the least row.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.count(F.lit(1))
    kept = df.dropna(subset=list(key)).groupBy(*key).agg(first.alias("of"))
    return (kept.select(*key, "of.*") if rest else kept.drop("of")).select(*df.columns)


def merge_in_order(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, values``: the distinct values of each key in the order in which they are first met; nulls are left out."""
    firsts = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("at"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("of")).select(key, F.transform("of", lambda x: x[value]).alias("values"))


def year_of(date: Column, season_year: Column | None = None) -> Column:
    """The year of a date text of four characters or more, else the year of the season, else null."""
    of = F.when(F.length(date) >= 4, F.substr(date, F.lit(1), F.lit(4)).try_cast("int"))
    return of if season_year is None else F.coalesce(of, season_year.try_cast("int"))


def blank_to_null(column: Column) -> Column:
    """Null for the empty text."""
    return F.when(column != "", column)


def recode_media(column: Column) -> Column:
    """The staging media type of a media type of the second source; null is ``unknown``."""
    pairs = [F.lit(x) for pair in RECODED_MEDIA.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column, F.lit("unknown"))


def unify_genres(genres: Column) -> Column:
    """Trimmed genres in the unified taxonomy, each once, in order; blank and null ones are left out, null gives an empty list."""
    table = F.create_map(*[x for name, parts in GENRE_PARTS.items() for x in (F.lit(name), F.array(*map(F.lit, parts)))])
    present = F.filter(F.transform(genres, strip), lambda g: g.isNotNull() & (g != ""))
    unified = F.array_distinct(F.flatten(F.transform(present, lambda g: F.coalesce(F.try_element_at(table, g), F.array(g)))))
    return F.coalesce(unified, F.array().cast("array<string>"))


def genre_names(ids: Column, names: dict[int, str]) -> Column:
    """Names of genre ids; an unknown id gives ``Unknown(<id>)``, a null one nothing."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    return F.transform(F.filter(ids, lambda x: x.isNotNull()), lambda x: F.coalesce(F.try_element_at(table, x.cast("int")), F.concat(F.lit("Unknown("), x.cast("string"), F.lit(")"))))


def normalize_title(column: Column) -> Column:
    """A title for comparison: NFKC, lower case, all but letters, numbers and underscores as blanks (combining marks that
    NFKC leaves, too), blanks collapsed; null gives the empty text."""
    words = F.regexp_replace(F.lower(nfkc(column)), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.coalesce(strip(F.regexp_replace(words, r"(?U)\s+", " ")), F.lit(""))


def title_modifiers(normal: Column) -> Column:
    """The tags (seasons, parts, numbers, kinds) of a normalised title, each once, sorted."""
    tags = [F.transform(F.regexp_extract_all(normal, F.lit("(?U)" + pattern), F.lit(1)), _tagged(tag)) for pattern, tag in MODIFIERS]
    words = F.array_compact(F.array(*[F.when(normal.rlike(rf"(?U)\b{word}\b"), F.lit(word)) for word in MODIFIER_WORDS]))
    return F.array_sort(F.array_distinct(F.concat(*tags, words)))


def _tagged(tag: str):
    return lambda x: F.concat(F.lit(tag), x)


def all_titles(df: DataFrame) -> Column:
    """Title, original title and alternative titles that are not blank, in this order."""
    every = F.concat(F.array("title", "original_title"), F.coalesce("alternative_titles", F.array().cast("array<string>")))
    return F.filter(every, lambda t: t.isNotNull() & (strip(t) != ""))


def _staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    fields = T._parse_datatype_string(STAGING).fields
    empty = lambda t: F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit(None).cast(t)
    return df.select(*[(columns[f.name].cast(f.dataType) if f.name in columns else empty(f.dataType)).alias(f.name) for f in fields])


def stage_first(raw: DataFrame, genres: dict[int, str]) -> DataFrame:
    """Raw records of the first source (one struct a row, ``_media_type`` told) in the staging schema.

    Films and series name their title and date columns differently; columns that the source lacks are null or empty.
    """
    film = F.coalesce(F.col("_media_type"), F.lit("movie")) == "movie"
    pick = lambda a, b: F.when(film, F.col(a)).otherwise(F.col(b))
    date = blank_to_null(pick("release_date", "first_air_date"))
    media = F.coalesce(F.col("_media_type"), F.lit("movie"))
    return _staged(raw, {
        "source": F.lit("tmdb"), "source_id": F.col("id"), "title": pick("title", "name"), "original_title": pick("original_title", "original_name"),
        "media_type": media, "source_media_type": media, "release_date": date, "release_year": year_of(date), "genres": genre_names(F.col("genre_ids"), genres),
        "original_language": F.col("original_language"), "origin_country": F.coalesce("origin_country", F.array().cast("array<string>")), "overview": F.coalesce("overview", F.lit("")),
        "rating": F.col("vote_average"), "vote_count": F.col("vote_count"), "popularity": F.col("popularity"), "discovered_from": F.array(F.coalesce("_strategy", F.lit("unknown"))),
    })


def stage_second(raw: DataFrame) -> DataFrame:
    """Raw records of the second source, whose nested fields are structs, in the staging schema."""
    alternative = F.col("alternative_titles")
    blank = F.array().cast("array<string>")
    names = lambda c: F.filter(F.transform(c, lambda g: blank_to_null(g["name"])), lambda g: g.isNotNull())
    strategy = F.array_compact(F.array(blank_to_null(F.col("_strategy"))))
    return _staged(raw, {
        "source": F.lit("mal"), "source_id": F.col("id"), "title": F.col("title"), "original_title": F.coalesce(blank_to_null(alternative["ja"]), F.col("title")),
        "alternative_titles": F.concat(F.array_compact(F.array(blank_to_null(alternative["en"]))), F.coalesce(alternative["synonyms"], blank)),
        "media_type": recode_media(F.col("media_type")), "source_media_type": F.coalesce("media_type", F.lit("unknown")),
        "release_date": blank_to_null(F.col("start_date")), "release_year": year_of(F.col("start_date"), F.col("start_season")["year"]), "end_date": blank_to_null(F.col("end_date")),
        "genres": F.coalesce(names("genres"), blank), "studios": F.coalesce(names("studios"), blank), "original_language": F.lit("ja"), "origin_country": F.array(F.lit("JP")),
        "production_countries": F.array(F.lit("Japan")), "overview": F.coalesce("synopsis", F.lit("")), "rating": F.col("mean"), "vote_count": F.col("num_scoring_users"),
        "popularity": F.col("popularity"), "rank": F.col("rank"), "favorites": F.col("num_favorites"), "num_list_users": F.col("num_list_users"), "status": F.col("status"),
        "runtime": F.col("average_episode_duration"), "num_episodes": F.col("num_episodes"), "source_material": F.col("source"), "discovered_from": strategy,
    })


def decade_label(year: Column) -> Column:
    """``Unknown`` for null, ``Pre-1900`` before 1900, else a decade such as ``1990s``."""
    return F.when(year.isNull(), "Unknown").when(year < 1900, "Pre-1900").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


# Media types of the anime group; languages with a group of their own.
ANIME_TYPES = ("anime_tv", "anime_movie", "ova", "ona", "special", "music")
MAJOR_LANGUAGES = ("en", "ja", "es", "fr", "de", "ko", "hi", "zh", "it", "ru", "pt", "tr", "sv", "nl")
# Right-closed bins of years, the first closed on both sides.
YEAR_BINS = (
    (0, 1950, "Before 1950"), (1950, 1970, "1950-1969"), (1970, 1990, "1970-1989"), (1990, 2000, "1990-1999"),
    (2000, 2010, "2000-2009"), (2010, 2020, "2010-2019"), (2020, 2026, "2020+"),
)


def media_group(media: Column) -> Column:
    """The sampler's group of a media type: anime, tv, movie or other."""
    return F.when(media.isin(*ANIME_TYPES), "anime").when(media.isin("tv", "movie"), media).otherwise("other")


def audit_media_group(source: Column, media: Column) -> Column:
    """The audit's group, in which everything of the second source is anime."""
    low = F.coalesce(F.lower(media), F.lit(""))
    return F.when((source == "mal") | F.contains(low, F.lit("anime")), "anime").when(low.isin("tv", "movie"), low).otherwise("other")


def language_group(language: Column) -> Column:
    """A major language, ``other_lang``, or ``other`` for null and empty."""
    low = strip(F.lower(language))
    return F.when(language.isNull() | (language == ""), "other").when(low.isin(*MAJOR_LANGUAGES), low).otherwise("other_lang")


def year_bin(year: Column) -> Column:
    """The label of the year's bin; null outside all bins."""
    result = F.lit(None).cast("string")
    for i, (low, high, label) in enumerate(YEAR_BINS):
        result = F.when((year >= low if i == 0 else year > low) & (year <= high), label).otherwise(result)
    return result
