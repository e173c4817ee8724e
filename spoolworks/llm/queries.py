"""The queries of the training-data operators, and the SQL that states the same results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolworks.functions.text import clean_term
from spoolworks.llm import encode, leak, link, quota_sample, spans, terms
from spoolworks.sources.tables import table

SEED = 42


def sampled_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each entity_id with its category of media type, decade and language; rows without an id are left out."""
    year = F.col("release_year")
    decade = F.when(year.between(1890, 2030), F.concat(F.expr("release_year DIV 10 * 10"), F.lit("s"))).otherwise("unknown")
    rows = table(spark, folder, "canonical_entities").select(
        "entity_id",
        F.coalesce(clean_term(F.col("media_type")), F.lit("unknown")).alias("media_type"),
        decade.alias("release_year"),
        F.coalesce(clean_term(F.col("original_language")), F.lit("missing")).alias("original_language"),
    )
    one = rows.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.min(F.struct("media_type", "release_year", "original_language")).alias("of"))
    return one.select("entity_id", "of.*")


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, list[quota_sample.TargetSet], quota_sample.Plan]:
    entities = sampled_entities(spark, folder)
    sets = quota_sample.read_targets(table(spark, folder, "sample_targets"))
    return entities, sets, quota_sample.plan_samples(entities, "entity_id", sets, SEED)


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with the number wanted, there and drawn, and why it is not met."""
    return spark.createDataFrame(_plan(spark, folder)[2].report, quota_sample.REPORT)


def p3_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes, wanted numbers and supplies of the report, which do not depend on the draw."""
    return p3_report(spark, folder).select("target_set", "dimension", "category", "sample_size", "wanted", "supply")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """target_set, category of the targets that no exchange of records could meet."""
    return p3_report(spark, folder).where(F.col("unmet") == "supply").select("target_set", "category")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn samples: target_set, entity_id, signature."""
    entities, sets, plan = _plan(spark, folder)
    return quota_sample.draw(entities, "entity_id", sets, plan, SEED).withColumn("signature", F.regexp_replace("signature", quota_sample.OTHER, "(other)"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """tmdb_id, mal_id, confidence of the records that describe the same work."""
    found = link.link(table(spark, folder, "tmdb_normalized"), table(spark, folder, "mal_normalized"))
    return found.select(F.col("l").alias("tmdb_id"), F.col("r").alias("mal_id"), F.round("value", 4).alias("confidence"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """tmdb_id, mal_id of the records that describe the same work."""
    return p4_links(spark, folder).select("tmdb_id", "mal_id")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """source, id, class_id of every record that can be linked: records of one class are told apart by nothing."""
    sides = {name: link.classes(table(spark, folder, f"{name}_normalized")) for name in ("tmdb", "mal")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), "id", "class_id") for name, df in sides.items()])


TERM_FIELDS = ("genres", "original_language", "origin_country")


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    canonical = table(spark, folder, "canonical_entities")
    total = canonical.agg(F.count_distinct("entity_id"))
    return terms.mark_terms(terms.term_frequencies(canonical, "entity_id", TERM_FIELDS), total)


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, records and marks."""
    return _frequencies(spark, folder).withColumn("marks", F.array_join("marks", ","))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """field_name, term, mark of the terms that are too rare or too common."""
    return _frequencies(spark, folder).select("field_name", "term", F.explode("marks").alias("mark"))


def byte_bpe_50k(path: str | None = None) -> encode.Vocabulary:
    """The public vocabulary byte_bpe_50k; ``path`` is its rank file, by default that of the installed collection."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return encode.Vocabulary(file.read(), public_tokenizers.PATTERN)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode.encode_texts(table(spark, folder, "documents"), "doc_id", "text", byte_bpe_50k())


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that a document carries, with how much of it."""
    return leak.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, doc_id of every leak."""
    return p7_leaks(spark, folder).select("item_id", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, span_start, span_end of every stretch of 300 code points or more that another document holds too."""
    return spans.shared_spans(table(spark, folder, "documents"), "doc_id", "text")


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How many code points of each document stand in another one too, and their share of the text."""
    documents = table(spark, folder, "documents")
    return spans.shared_amounts(p8_found(spark, folder), documents, "doc_id", "text").withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_targets, p3_sample, p4_found, p4_links, p4_classes, p5_found, p5_terms, p6_ids, p7_found, p7_leaks, p8_found, p8_shared)}

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + chr(0x3000) + chr(0xA0)
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''") + "  "


def _sql_term(column: str) -> str:
    """The term of a text. DuckDB has no NFKC; full-width forms and wide blanks are mapped."""
    clean = f"lower(trim(translate({column}, '{_WIDE}', '{_NARROW}'), ' ' || chr(9) || chr(10) || chr(13)))"
    return f"CASE WHEN {clean} IN ('', 'nan', 'none', 'null', '[]', '{{}}') THEN NULL ELSE {clean} END"


_SQL_TERMS = f"""
raw AS (SELECT 'genres' AS field_name, unnest(genres) AS v, entity_id FROM canonical_entities
  UNION ALL SELECT 'origin_country', unnest(origin_country), entity_id FROM canonical_entities
  UNION ALL SELECT 'original_language', original_language, entity_id FROM canonical_entities),
t AS (SELECT field_name, {_sql_term('v')} AS term, entity_id FROM raw),
f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT entity_id) AS records FROM t WHERE term IS NOT NULL GROUP BY ALL),
n AS (SELECT count(DISTINCT entity_id) AS total FROM canonical_entities)"""

_SQL_TARGETS = f"""
WITH e AS (SELECT DISTINCT entity_id, coalesce({_sql_term('media_type')}, 'unknown') AS media_type,
  CASE WHEN release_year BETWEEN 1890 AND 2030 THEN CAST(release_year // 10 * 10 AS VARCHAR) || 's' ELSE 'unknown' END AS release_year,
  coalesce({_sql_term('original_language')}, 'missing') AS original_language FROM canonical_entities WHERE entity_id IS NOT NULL),
n AS (SELECT count(DISTINCT entity_id) AS total FROM e),
c AS (SELECT 'media_type' AS dimension, media_type AS category, count(DISTINCT entity_id) AS supply FROM e GROUP BY ALL
  UNION ALL SELECT 'release_year', release_year, count(DISTINCT entity_id) FROM e GROUP BY ALL
  UNION ALL SELECT 'original_language', original_language, count(DISTINCT entity_id) FROM e GROUP BY ALL),
w AS (SELECT *, sample_permille * total // 1000 AS size FROM sample_targets, n),
r AS (SELECT target_set, dimension, category, CAST(size AS BIGINT) AS size, CAST(greatest(min_rows, (share_permille * size + 999) // 1000) AS BIGINT) AS wanted, coalesce(supply, 0) AS supply
  FROM w LEFT JOIN c USING (dimension, category))"""

# every window of every text, by its hash
_SQL_SPANS = """
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT doc_id, s, md5(substr(text, CAST(s + 1 AS INT), 300)) AS k FROM (SELECT doc_id, text, unnest(range(n - 299)) AS s FROM d)),
k AS (SELECT k FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM (SELECT DISTINCT doc_id, s FROM w SEMI JOIN k USING (k))),
g AS (SELECT *, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM m),
spans AS (SELECT doc_id, CAST(min(s) AS INT) AS span_start, CAST(max(s) + 300 AS INT) AS span_end FROM g GROUP BY doc_id, span)"""

SQL = {
    "p3_found": f"""{_SQL_TARGETS}
SELECT target_set, category FROM r WHERE supply < wanted""",
    "p3_targets": f"""{_SQL_TARGETS}
SELECT target_set, dimension, category, size AS sample_size, wanted, supply FROM r""",
    "p8_found": f"WITH {_SQL_SPANS} SELECT * FROM spans",
    "p8_shared": f"""WITH {_SQL_SPANS}, a AS (SELECT doc_id, sum(span_end - span_start) AS shared FROM spans GROUP BY 1),
t AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(n_chars AS INT) AS n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared, round(CASE WHEN n_chars > 0 THEN coalesce(shared, 0) / n_chars ELSE 0 END, 6) AS share FROM t LEFT JOIN a USING (doc_id)""",
    "p5_found": f"""
WITH {_SQL_TERMS}
SELECT field_name, term, 'rare' AS mark FROM f WHERE records <= 2
UNION ALL SELECT field_name, term, 'common' FROM f, n WHERE records * 4 > total""",
    "p5_terms": f"""
WITH {_SQL_TERMS}
SELECT field_name, term, occurrences, records,
  CASE WHEN records <= 2 THEN 'rare' ELSE '' END || CASE WHEN records <= 2 AND records * 4 > total THEN ',' ELSE '' END || CASE WHEN records * 4 > total THEN 'common' ELSE '' END AS marks
FROM f, n""",
}
