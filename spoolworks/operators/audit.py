"""Crawl tasks, raw-record audits, analytic views, validation, and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw_profile(df: DataFrame, key: str) -> DataFrame:
    """``lines, unique_ids, duplicate_ids, null_ids`` of raw records."""
    return df.agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct(key).alias("unique_ids"), (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"),
        F.count_if(F.col(key).isNull()).alias("null_ids"),
    )


def contribution(df: DataFrame, key: str, strategy: str) -> DataFrame:
    """``strategy, total, unique_ids, exclusive_ids``: an id is exclusive that no other strategy found."""
    rows = df.where(F.col(key).isNotNull() & F.col(strategy).isNotNull())
    pairs = rows.groupBy(F.col(key).alias("id"), F.col(strategy).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))
    finders = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("finders"))
    counted = pairs.join(finders, "id").groupBy("strategy")
    return counted.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_ids"), F.count_if(F.col("finders") == 1).alias("exclusive_ids"))


def year_tasks(spark: SparkSession, first: int, last: int, media: Sequence[str] = ("movie", "tv")) -> DataFrame:
    """``task_key, task_year, task_media``: a crawl task for each year and medium."""
    rows = spark.range(first, last + 1).select(F.col("id").cast("int").alias("task_year"), F.explode(F.array(*map(F.lit, media))).alias("task_media"))
    return rows.select(F.concat_ws(":", F.lit("year"), "task_year", "task_media").alias("task_key"), "task_year", "task_media")


def language_tasks(years: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``task_key, task_year, task_language``: a task for each language in each of the years."""
    rows = years.select("task_year", F.explode(F.array(*map(F.lit, languages))).alias("task_language"))
    return rows.select(F.concat_ws(":", F.lit("language"), "task_year", "task_language").alias("task_key"), "task_year", "task_language")


def genre_tasks(spark: SparkSession, genres: Sequence[int], decades: Sequence[int], media: Sequence[str] = ("movie", "tv")) -> DataFrame:
    """``task_key, genre_id, decade, task_media``: a task for each genre, decade and medium."""
    rows = spark.createDataFrame([(g,) for g in genres], "genre_id int").withColumn("decade", F.explode(F.array(*map(F.lit, decades))))
    rows = rows.withColumn("task_media", F.explode(F.array(*map(F.lit, media))))
    return rows.select(F.concat_ws(":", F.lit("genre"), "genre_id", "decade", "task_media").alias("task_key"), "genre_id", "decade", "task_media")


#: Sources of the views.
VIEWS = {"all": None, "first": ("tmdb", "tmdb+mal"), "second": ("mal", "tmdb+mal"), "shared": ("tmdb+mal",)}


def views(df: DataFrame) -> dict[str, DataFrame]:
    """All rows, those of either source, and those of both."""
    return {name: df if sources is None else df.where(F.col("source").isin(*sources)) for name, sources in VIEWS.items()}


def view_counts(df: DataFrame) -> DataFrame:
    """``view, rows`` in one pass."""
    counts = [F.count(F.lit(1)) if s is None else F.count_if(F.col("source").isin(*s)) for s in VIEWS.values()]
    one = df.agg(*[c.alias(n) for n, c in zip(VIEWS, counts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("view"), F.col(n).alias("rows")) for n in VIEWS])))


def validate(views: dict[str, DataFrame], sample: DataFrame, canonical: DataFrame, expected: dict[str, int], key: str = "entity_id") -> DataFrame:
    """``name, passed, details``: the twelve checks of the four views against the sample and the canonical table.

    ``views`` are those of :func:`views`, wherever they come from; ``expected`` has the numbers of shared rows, of null dates
    and of canonical rows. Ids that are null are in no set; repeated ids are.
    """
    dev, first, second, shared = (views[n] for n in VIEWS)

    def figures(df: DataFrame, name: str, *ids: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), *[e for i in ids for e in (F.count(i).alias(f"{name}_{i}"), F.count_distinct(i).alias(f"{name}_{i}_d"))])

    def strangers(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
        return df.select(key).where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").agg(F.count_distinct(key).alias(name))

    dates = dev.agg(F.count_if(F.col("release_date").isNull()).alias("dates"))
    parts = [
        figures(dev, "dev", key), figures(first, "first", key, "tmdb_id"), figures(second, "second", key, "mal_id"), figures(shared, "shared"), figures(sample, "sample"),
        figures(canonical, "canonical"), dates, strangers(dev, canonical, "unknown"), strangers(shared, first, "not_first"), strangers(shared, second, "not_second"),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    c = F.col
    repeated = lambda name, i: c(f"{name}_{i}") - c(f"{name}_{i}_d")
    unique = lambda name, i: (repeated(name, i) == 0, F.concat(repeated(name, i).cast("string"), F.lit(" repeated")))
    counted = lambda *names: F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), c(n).cast("string")) for n in names])
    checks = {
        "rows_equal_sample": (c("dev_rows") == c("sample_rows"), counted("dev_rows", "sample_rows")), "ids_in_canonical": (c("unknown") == 0, counted("unknown")),
        "ids_unique": unique("dev", key), "first_ids_unique": unique("first", key), "second_ids_unique": unique("second", key),
        "shared_count": (c("shared_rows") == expected["shared"], counted("shared_rows")),
        "shared_in_both": ((c("not_first") == 0) & (c("not_second") == 0), counted("not_first", "not_second")),
        "tmdb_id_unique": unique("first", "tmdb_id"), "mal_id_unique": unique("second", "mal_id"), "null_dates": (c("dates") == expected["null_dates"], counted("dates")),
        "inclusion": (c("first_rows") + c("second_rows") - c("shared_rows") == c("dev_rows"), counted("first_rows", "second_rows", "shared_rows", "dev_rows")),
        "canonical_count": (c("canonical_rows") == expected["canonical"], counted("canonical_rows")),
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed"), d.alias("details")) for n, (p, d) in checks.items()])))


def value_counts(df: DataFrame, value: Column, keep_null: bool = False) -> DataFrame:
    """``value, n, share`` of a column, or of a list column's elements if exploded; null is a value only if kept."""
    rows = df.select(value.alias("value"))
    counts = (rows if keep_null else rows.where(F.col("value").isNotNull())).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def histogram_of_counts(df: DataFrame, value: Column) -> DataFrame:
    """``times, values``: how many values occur so many times."""
    return value_counts(df, value).groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("values"))


def duplicates(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """``name, duplicates``: rows beyond the first of each key; nulls equal each other."""
    rows = [df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*columns))).alias("duplicates")).select(F.lit(name).alias("name"), "duplicates") for name, columns in keys.items()]
    return reduce(DataFrame.unionByName, rows)


def field_quality(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, total, present, missing, missing_percent`` of the fields that the table has; empty lists are missing."""
    known = [f for f in fields if f in df.columns]
    present = [F.count(F.when(F.size(f) > 0, 1) if isinstance(df.schema[f].dataType, T.ArrayType) else F.col(f)).alias(f) for f in known]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *present)
    n = F.col("_n")
    rows = [F.struct(F.lit(f).alias("field"), n.alias("total"), F.col(f).alias("present"), (n - F.col(f)).alias("missing"), F.round((n - F.col(f)) * 100 / n, 4).alias("missing_percent")) for f in known]
    return one.select(F.inline(F.array(*rows)))


def sections(df: DataFrame, values: dict[str, Column], many: dict[str, str], top: int) -> DataFrame:
    """``section, item, n, percent, place``: the ``top`` commonest items of each section, ties in order of the item.

    ``values`` are columns, ``many`` list columns whose elements are counted. All sections are counted in one pass; null is no
    item, and an item's share is that of all items of its section.
    """
    item = lambda name, v: F.struct(F.lit(name).alias("section"), v.cast("string").alias("item"))
    single = F.array(*[item(n, v) for n, v in values.items()])
    listed = [F.coalesce(F.transform(c, _item_of(n)), F.array().cast("array<struct<section:string,item:string>>")) for n, c in many.items()]
    counts = df.select(F.inline(F.concat(single, *listed))).where(F.col("item").isNotNull()).groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("section").agg(F.sum("n").alias("all"))
    place = Window.partitionBy("section").orderBy(F.desc("n"), "item")
    best = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    return best.join(F.broadcast(totals), "section").select("section", "item", "n", (F.col("n") * 100 / F.col("all")).alias("percent"), "place")  # one row a section


def _item_of(name: str):
    return lambda x: F.struct(F.lit(name).alias("section"), x.cast("string").alias("item"))


def data_dictionary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, kind, missing, missing_percent, unique_values``; of lists the distinct lengths are counted.

    The values of all columns are counted in one pass and combined before they are shuffled. NaN is a value. A table without
    rows has no entries.
    """
    pairs = []
    for name in columns or df.columns:
        column, is_list = F.col(name), isinstance(df.schema[name].dataType, T.ArrayType)
        gone = column.isNull() | (F.size(column) == 0) if is_list else column.isNull()
        value = F.when(column.isNotNull(), F.size(column).cast("string")) if is_list else column.cast("string")
        pairs.append(F.struct(F.lit(name).alias("column_name"), F.lit("list" if is_list else "scalar").alias("kind"), gone.alias("gone"), value.alias("value")))
    counts = df.select(F.inline(F.array(*pairs))).groupBy("column_name", "kind", "gone", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0))
    # a list of no length is missing and still a length; no other value is both
    return counts.groupBy("column_name", "kind").agg(missing.alias("missing"), F.round(missing * 100 / F.sum("n"), 4).alias("missing_percent"), F.count("value").alias("unique_values"))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, before, after``: two count tables ``key, n`` side by side, 0 where one lacks the key."""
    x, y = a.select(key, F.col("n").alias("before")), b.select(key, F.col("n").alias("after"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def dominant(df: DataFrame, index: str, column: str) -> DataFrame:
    """``index, top, top_n, total, share``: the commonest value of ``column`` for each index, ties to the least one."""
    counts = df.where(F.col(index).isNotNull() & F.col(column).isNotNull()).groupBy(index, column).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(index).agg(F.max("n").alias("top_n"), F.sum("n").alias("total"))
    top = counts.join(most, index).where(F.col("n") == F.col("top_n")).groupBy(index, "top_n", "total").agg(F.min(column).alias("top"))
    return top.select(index, "top", "top_n", "total", (F.col("top_n") * 100 / F.col("total")).alias("share"))
