"""Exact frequencies of every distinct term of a collection.

Pairs of term and record are range-partitioned and sorted externally; a scan over the sorted runs counts a term's
occurrences and distinct records. The range key includes the record (or a tie where there is none), so a term that a third of
all records carry is spread over many partitions, and each partition hands on one partial count for each term it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.text import clean_term


def _named(name: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(name).alias("field_name"), x.cast("string").alias("raw"))


def term_pairs(df: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """Rows ``field_name, term, record`` for every value, or element of a list, that is a term.

    Null lists, null elements and the texts that stand for a missing value are no terms.
    """
    lists = []
    for name in fields:
        value = F.col(name)
        values = value if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(value)
        lists.append(F.transform(values, _named(name)))
    empty = F.array().cast("array<struct<field_name:string,raw:string>>")
    every = F.flatten(F.array(*[F.coalesce(x, empty) for x in lists]))
    raw = df.select(F.col(record).alias("record"), F.inline(every)).where(F.col("raw").isNotNull())
    return raw.select("field_name", clean_term(F.col("raw")).alias("term"), "record").where(F.col("term").isNotNull())


def term_frequencies(df: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """``field_name, term, occurrences, records`` over the whole table.

    Occurrences count every element of every row, repeated rows included; records are distinct values of ``record``. Terms
    of rows without a record id occur but are in no record. An empty table has no terms.
    """
    tie = F.when(F.col("record").isNull(), F.monotonically_increasing_id())  # rows without a record are no single key either
    pairs = term_pairs(df, record, fields).withColumn("tie", tie).repartitionByRange("field_name", "term", "record", "tie")
    run = Window.partitionBy("field_name", "term", "record", "tie").orderBy("record")
    scanned = pairs.sortWithinPartitions("field_name", "term", "record", "tie").withColumn("starts", F.row_number().over(run) == 1)
    begins = F.col("starts") & F.col("record").isNotNull()
    return scanned.groupBy("field_name", "term").agg(F.count(F.lit(1)).alias("occurrences"), F.count(F.when(begins, 1)).alias("records"))


def mark_terms(frequencies: DataFrame, total: DataFrame, rare: int = 2, common: float = 0.25) -> DataFrame:
    """The frequencies with ``marks``: ``rare`` (at most so many records), ``common`` (more than that share), both or none.

    ``total`` is one row with the number of all records.
    """
    marks = F.array_compact(F.array(F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.col("records") > common * total.scalar(), F.lit("common"))))
    return frequencies.withColumn("marks", marks)
