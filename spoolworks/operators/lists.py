"""Lists that arrive in any container: as lists, as JSON text, as single values."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.text import by_distinct, strip

# The columns of an entity that hold lists.
LIST_COLUMNS = (
    "genres", "origin_country", "keywords", "studios", "production_companies", "production_countries", "themes", "demographics", "alternative_titles",
    "discovered_from", "source_presence",
)
_TEXTS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_TEXTS)


def _elements(text: str) -> list[str | None] | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list):
        return None
    return [x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in value]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The list that a text holds as JSON, elements as texts; null if the text is not wholly a JSON list.

    Spark's own parsers accept what only begins as JSON.
    """
    yield from by_distinct(_elements, pa.list_(pa.string()))(batches)


def _bracketed(text: Column) -> Column:
    return text.startswith("[") & text.endswith("]")


def as_list(column: Column, kind: T.DataType) -> Column:
    """Any container as a clean list of texts; null, NaN, blank texts and empty lists give an empty list.

    Elements are trimmed, null and blank ones left out. A text in brackets is read as a JSON list; if it is none, and for any
    other text, the list has the trimmed text as its only element. A single number gives an empty list.
    """
    def clean(items: Column) -> Column:
        return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))

    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
            return F.when(column.isNotNull() | column.isNull(), _empty())
        return F.coalesce(clean(column.cast(_TEXTS)), _empty())
    if isinstance(kind, T.StringType):
        text = strip(column)
        single = F.filter(F.array(text), lambda x: x.isNotNull() & (x != ""))
        return F.coalesce(F.when(_bracketed(text), clean(_json_list(text))), single, _empty())
    return F.when(column.isNotNull() | column.isNull(), _empty())


def parse_lists(df: DataFrame, columns: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    """``df`` whose text columns among ``columns`` are lists: a text in brackets as JSON (an empty list if it does not parse),
    any other text as a list of itself; null stays null. Columns that are lists already, or absent, are left alone."""
    texts = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    parsed = {c: F.when(_bracketed(F.col(c)), F.coalesce(_json_list(F.col(c)), _empty())).when(F.col(c).isNotNull(), F.array(c)) for c in texts}
    return df.withColumns(parsed) if parsed else df


def smallest_hashes(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A simple random sample: the ``n`` rows of smallest seeded hash of ``key``; all rows if there are no more.

    The hash does not depend on how the rows lie, so the sample is the same each time. Rows with a null key come last.
    """
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).asc_nulls_last(), key).limit(n)


def load_entities(df: DataFrame, sample: int | None = None, key: str = "entity_id", seed: int = 42) -> DataFrame:
    """Entities as the predicates expect them: list columns parsed, and if wanted a sample of so many."""
    return parse_lists(smallest_hashes(df, sample, key, seed) if sample else df)
