"""Linking the two staging tables by titles: exact, blocked fuzzy, greedy one-to-one; and the canonical table."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.operators import normalize
from spoolworks.session import Scratch

# Media types of the two sources that may be the same work; confidences by rank.
COMPATIBLE = (("movie", "anime_movie"), ("tv", "anime_tv"), ("tv", "ona"), ("tv", "special"), ("tv", "ova"))
CONFIDENCE = {3: "high", 2: "medium", 1: "low"}
LEAST_SIMILARITY, LENGTH_SLACK, PREFIX = 0.88, 5, 3


def animation_candidate() -> Column:
    """Rows of the first source that may be in the second: Animation genre, Japanese, or from Japan."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    return has("genres", "Animation") | F.coalesce(F.lower("original_language") == "ja", F.lit(False)) | has("origin_country", "JP")


def years_compatible(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Whether two years are at most so far apart; false if one is null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def media_compatible(a: Column, b: Column) -> Column:
    """Whether the media types of the two sources may be the same work."""
    test = F.lit(False)
    for x, y in COMPATIBLE:
        test |= (a == x) & (b == y)
    return F.coalesce(test, F.lit(False))


def title_rows(df: DataFrame) -> DataFrame:
    """Rows ``id, year, media, modifiers, place, title`` of every normalised title; ``place`` is its place in the record."""
    of = df.select(
        F.col("source_id").alias("id"), F.col("release_year").alias("year"), F.col("media_type").alias("media"),
        normalize.title_modifiers(normalize.normalize_title(F.col("title"))).alias("modifiers"), F.posexplode(normalize.all_titles(df)).alias("place", "raw"),
    )
    return of.select("id", "year", "media", "modifiers", "place", normalize.normalize_title(F.col("raw")).alias("title")).where(F.col("title") != "")


def _one_a_record(df: DataFrame) -> DataFrame:
    return normalize.keep_first(df.select("source_id", "release_year", "media_type", "title", "original_title", "alternative_titles", "genres", "original_language", "origin_country", "popularity"), ["source_id"], ["popularity", "title"])


def sides(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The title rows of both sources; the first is limited to animation candidates. Repeated ids count once."""
    return title_rows(_one_a_record(first).where(animation_candidate())), title_rows(_one_a_record(second))


def exact_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, rank, place, title``: pairs with an equal title, the best rank of each pair and where it was first met.

    Rank 3 is high (equal modifiers, near years, compatible types), 2 is medium (types not compatible), 1 is low.
    """
    a = left.select(F.col("id").alias("l"), F.col("year").alias("ly"), F.col("media").alias("lm"), F.col("modifiers").alias("lt"), "place", "title")
    b = right.select(F.col("id").alias("r"), F.col("year").alias("ry"), F.col("media").alias("rm"), F.col("modifiers").alias("rt"), "title").distinct()
    near = years_compatible(F.col("ly"), F.col("ry")) & (F.col("lt") == F.col("rt"))
    rank = F.when(near & media_compatible(F.col("lm"), F.col("rm")), 3).when(near, 2).otherwise(1)
    pairs = a.join(b, "title").withColumn("rank", rank)
    return pairs.groupBy("l", "r").agg(F.max("rank").alias("rank"), F.min(F.struct("place", "title")).alias("met")).select("l", "r", "rank", "met.place", "met.title")


def best_edges(edges: DataFrame, order: tuple[str, ...] = ("place", "r")) -> DataFrame:
    """The best edge of each left record: rank, then the given columns."""
    best = F.max_by(F.struct("r", "rank", "place", "title"), F.struct("rank", *[-F.col(c) for c in order]))
    return edges.groupBy("l").agg(best.alias("of")).select("l", "of.*")


@F.pandas_udf(T.DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity of two texts."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def fuzzy_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Title pairs ``l, r, lt, rt, ...`` that share their first letters, in years one apart at most, of similar length."""
    keyed = lambda df, years: df.where((F.length("title") >= PREFIX) & F.col("year").isNotNull()).withColumn("block", F.substr("title", F.lit(1), F.lit(PREFIX))).withColumn("at", years)
    a = keyed(left, F.col("year")).select(F.col("id").alias("l"), "block", "at").distinct()
    b = keyed(right, F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1))).select(F.col("id").alias("r"), "block", "at").distinct()
    pairs = a.join(b, ["block", "at"]).select("l", "r").distinct()
    lefts = left.select(F.col("id").alias("l"), F.col("title").alias("lt"), F.col("place").alias("lp"), F.col("media").alias("lm"), F.col("modifiers").alias("lmods"))
    rights = right.select(F.col("id").alias("r"), F.col("title").alias("rt"), F.col("place").alias("rp"), F.col("media").alias("rm"), F.col("modifiers").alias("rmods"))
    return pairs.join(lefts, "l").join(rights, "r").where(F.abs(F.length("lt") - F.length("rt")) <= LENGTH_SLACK)


def fuzzy_edges(blocks: DataFrame) -> DataFrame:
    """``l, r, similarity, rank``: record pairs whose most similar titles exceed the least similarity; 2 is medium, 1 low.

    Two texts of so much similarity are no more edits apart than the letters outside their matching blocks, so most pairs are
    left out before they reach Python.
    """
    apart = (F.length("lt") + F.length("rt")) * (1 - LEAST_SIMILARITY)
    near = blocks.where(F.levenshtein("lt", "rt") <= apart)
    scored = near.withColumn("similarity", ratio("lt", "rt")).where(F.col("similarity") > LEAST_SIMILARITY)
    rank = F.when(media_compatible(F.col("lm"), F.col("rm")) & (F.col("lmods") == F.col("rmods")), 2).otherwise(1)
    return scored.groupBy("l", "r").agg(F.max("similarity").alias("similarity"), F.max(rank).alias("rank"))


def assign(edges: DataFrame, score: tuple[str, ...], consuming: int = 2) -> DataFrame:
    """Greedy one-to-one links as made record by record in the order of ``l``, without going record by record.

    ``edges`` are ``l, r, rank`` and the score columns (greatest first, then the least r). Each left record takes its best
    edge whose right record no earlier left record holds; only edges of rank ``consuming`` or more hold. Every round, all
    left records pick among the right records not held by an earlier one, and the holds are computed anew, until nothing
    changes; each settles at least the next left record, so the end is always reached, and from whatever holds it begins: it
    is the only state that reproduces itself. The first holds are guessed: the n-th of the left records with the same best
    edge takes its n-th edge, which is right for records that share all their edges. The rows are the picks, those of lower
    rank included.
    """
    best = F.struct(*score, -F.col("r"))
    with Scratch(edges.sparkSession) as kept, Scratch(edges.sparkSession) as rounds:
        edges = kept.keep(edges, "edges")
        placed = edges.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(best.desc())))
        turn = placed.where("place = 1").select("l", F.row_number().over(Window.partitionBy("r").orderBy("l")).alias("place"))
        guessed = placed.join(turn, ["l", "place"]).where(F.col("rank") >= consuming)
        held = rounds.keep(guessed.groupBy("r").agg(F.min("l").alias("l")).select("l", "r"), "held")
        while True:
            holders = held.select(F.col("l").alias("holder"), "r")
            free = edges.join(holders, "r", "left").where(F.col("holder").isNull() | (F.col("holder") >= F.col("l"))).drop("holder")
            picks = rounds.keep(free.groupBy("l").agg(F.max_by(F.struct("r", "rank", *[c for c in score if c != "rank"]), best).alias("of")).select("l", "of.*"), "picks")
            now = rounds.keep(picks.where(F.col("rank") >= consuming).groupBy("r").agg(F.min("l").alias("l")).select("l", "r"), "held")
            if now.exceptAll(held).isEmpty() and held.exceptAll(now).isEmpty():
                settled = picks.join(now.withColumnRenamed("l", "owner"), "r", "left").where((F.col("rank") < consuming) | (F.col("owner") == F.col("l")))
                return rounds.hand_over(settled.drop("owner"), "links")
            held = now
            rounds.clear(but=2)


def link_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """``l, r, match_confidence, match_method, similarity``: exact links, then fuzzy links of what is left."""
    with Scratch(first.sparkSession) as scratch:
        left, right = (scratch.keep(side, "titles") for side in sides(first, second))
        exact = assign(exact_edges(left, right).withColumn("first", -F.col("place")), ("rank", "first"))
        good = exact.where(F.col("rank") >= 2)
        rest_l = left.join(good.select(F.col("l").alias("id")), "id", "left_anti")
        rest_r = right.join(good.select(F.col("r").alias("id")), "id", "left_anti")
        fuzzy = assign(fuzzy_edges(fuzzy_blocks(rest_l, rest_r)), ("similarity", "rank"))
    name = F.element_at(F.create_map(*[x for r, n in CONFIDENCE.items() for x in (F.lit(r), F.lit(n))]), F.col("rank"))
    return exact.select("l", "r", name.alias("match_confidence"), F.lit("exact_title").alias("match_method"), F.lit(1.0).alias("similarity")).unionByName(
        fuzzy.select("l", "r", name.alias("match_confidence"), F.lit("fuzzy_title").alias("match_method"), F.round("similarity", 4).alias("similarity"))
    )


def canonical(first: DataFrame, second: DataFrame, links: DataFrame, prefix: str = "") -> DataFrame:
    """The canonical table: linked rows merged, then the unlinked rows of both sources, one row for each source id.

    ``links`` are ``l, r, match_confidence``. A merged row has the columns of the first source, and the media type of the
    second where it has one. Missing lists are empty, genres are unified.
    """
    a, b = (normalize.keep_first(df, ["source_id"], ["popularity", "title"]) for df in (first, second))
    one = links.select("l", "r", "match_confidence")
    met = a.join(one, a["source_id"] == one["l"]).join(b.select(F.col("source_id").alias("r"), F.col("media_type").alias("second_media")), "r")
    merged = met.withColumns({
        "media_type": F.coalesce(normalize.blank_to_null(F.col("second_media")), F.col("media_type")), "source": F.lit("tmdb+mal"), "tmdb_id": F.col("l"), "mal_id": F.col("r"),
        "entity_id": F.concat(F.lit(f"{prefix}tmdb_"), F.col("l"), F.lit("_mal_"), F.col("r")), "source_presence": F.array(F.lit("tmdb"), F.lit("mal")),
    }).drop("l", "r", "second_media")
    linked = lambda df, side: df.join(one.select(F.col(side).alias("source_id")), "source_id", "left_anti")
    alone = [
        linked(df, side).withColumns({
            "tmdb_id": F.col("source_id") if name == "tmdb" else F.lit(None).cast("bigint"), "mal_id": F.col("source_id") if name == "mal" else F.lit(None).cast("bigint"),
            "entity_id": F.concat(F.lit(f"{prefix}{name}_"), F.col("source_id")), "source_presence": F.array(F.lit(name)), "match_confidence": F.lit("unmatched"),
        })
        for df, side, name in ((a, "l", "tmdb"), (b, "r", "mal"))
    ]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [merged, *alone])
    lists = [f.name for f in every.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name != "genres"]
    return every.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists} | {"genres": normalize.unify_genres(F.col("genres"))})


def enrich(df: DataFrame, extra: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with list columns of ``extra`` attached by key; rows without one get empty lists, and no row is multiplied."""
    one = normalize.keep_first(extra.select(key, *columns), [key], list(columns))
    joined = df.drop(*columns).join(one, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns})
