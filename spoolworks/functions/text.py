"""Text normalisation that Spark's built-in functions lack (NFKC) or do otherwise than Unicode (white space)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The texts that stand for a missing value.
MISSING_TEXTS = ("", "nan", "none", "null", "[]", "{}")

#: Most distinct values whose result a worker remembers; beyond it the memory starts anew.
REMEMBERED = 100_000


def by_distinct(function: Callable[[str], object], kind: pa.DataType) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Apply ``function`` once per distinct text of an Arrow batch and spread the results; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, object] = {}
        for batch in batches:
            coded = pa.array(batch, type=pa.string(), from_pandas=True).dictionary_encode()
            results = []
            for text in coded.dictionary.to_pylist():
                if text not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[text] = function(text)
                results.append(known[text])
            yield pa.array(results, type=kind).take(coded.indices).to_pandas()

    return run


def term_of(text: str) -> str:
    """NFKC, no white space at the ends, lower case."""
    return unicodedata.normalize("NFKC", text).strip().lower()


@F.pandas_udf(T.StringType())
def _term(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from by_distinct(term_of, pa.string())(batches)


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode form NFKC; null stays null."""
    yield from by_distinct(lambda text: unicodedata.normalize("NFKC", text), pa.string())(batches)


def clean_term(column: Column) -> Column:
    """A value as a term (NFKC, trimmed, lower case), or null where it is missing.

    Missing are null, the empty text and the texts of :data:`MISSING_TEXTS`, whatever their case or outer white space.
    """
    term = _term(column)
    return F.when(~term.isin(*MISSING_TEXTS), term)


def strip(column: Column) -> Column:
    """Without Unicode white space at the ends (``trim`` takes only blanks)."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
