"""Predicates that keep missing values apart from false ones.

A predicate on a feature has one of four states. The order of tests is fixed: not applicable, missing, predicate; a
comparison whose value is no number is unknown. Which test applies is decided from the column's type when the plan is
built, so each predicate is one expression that Spark compiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.functions.text import MISSING_TEXTS, strip

KNOWN_TRUE, KNOWN_FALSE, UNKNOWN, NOT_APPLICABLE = "known_true", "known_false", "unknown", "not_applicable"
#: Answers as numbers.
NO, YES, NO_ANSWER = 0, 1, 2

# Features that a media type does not have.
NOT_OF_MEDIA = {"movie": ("num_episodes", "end_date")}
# Names of the comparison predicates.
COMPARISONS = {
    "gte": ">=", "greater_equal": ">=", ">=": ">=", "lte": "<=", "less_equal": "<=", "<=": "<=",
    "gt": ">", "greater_than": ">", ">": ">", "lt": "<", "less_than": "<", "<": "<",
}

_NUMBERS = (T.NumericType,)


def folded(column: Column) -> Column:
    """Trimmed and in lower case, the form in which texts are compared."""
    return F.lower(strip(column))


def _fold(text: str) -> str:
    return text.strip().lower()


def is_missing(column: Column, kind: T.DataType, fold: Column | None = None) -> Column:
    """Whether a value is null, NaN, an empty list, or a text that stands for a missing value."""
    if isinstance(kind, T.StringType):
        return column.isNull() | (folded(column) if fold is None else fold).isin(*MISSING_TEXTS)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


def _number(value: object) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


FOLDED, GONE = "_folded_", "_gone_"


def fold_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with the folded form of text features, and whether a feature is missing, computed once for all predicates."""
    more = {GONE + f: is_missing(F.col(f), df.schema[f].dataType) for f in dict.fromkeys(features) if f in df.columns}
    for feature in dict.fromkeys(features):
        kind = df.schema[feature].dataType if feature in df.columns else None
        if isinstance(kind, T.StringType):
            more[FOLDED + feature] = folded(F.col(feature))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            more[FOLDED + feature] = F.transform(F.filter(feature, lambda x: x.isNotNull()), folded)
    return df.withColumns(more)


def _same(column: Column, kind: T.DataType, value: object, fold: Column | None = None) -> Column:
    """Equality as between values of one kind; values of different kinds are unequal."""
    if isinstance(kind, T.StringType):
        return (folded(column) if fold is None else fold) == _fold(value) if isinstance(value, str) else F.lit(False)
    if isinstance(kind, _NUMBERS):
        return column.cast("double") == float(value) if isinstance(value, (int, float)) else F.lit(False)
    if isinstance(kind, T.BooleanType):
        return column.cast("double") == float(value) if isinstance(value, (bool, int, float)) else F.lit(False)
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return column == F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(False)


def _contains(column: Column, kind: T.DataType, value: object, fold: Column | None = None) -> Column:
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        if fold is not None and isinstance(value, str):
            return F.array_contains(fold, _fold(value))
        if isinstance(value, str) and not isinstance(item, T.StringType):
            return F.lit(False)
        return F.exists(F.filter(column, lambda x: x.isNotNull()), lambda x: _same(x, item, value))
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return F.contains(folded(column) if fold is None else fold, F.lit(_fold(value)))
    return F.lit(False)


def _compare(column: Column, kind: T.DataType, sign: str, value: object) -> Column:
    number = _number(value)
    if number is None or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("boolean")
    left = column.try_cast("double")
    test = {">=": left >= number, "<=": left <= number, ">": left > number, "<": left < number}[sign]
    return F.when(F.isnan(left), F.lit(False)).otherwise(test)  # nothing compares with NaN


def holds(column: Column, kind: T.DataType, operator: str, value: object, fold: Column | None = None) -> Column:
    """Whether a present value satisfies the predicate; null where that cannot be told. ``fold`` is its folded form."""
    name = operator.lower()
    if name == "equals":
        return _same(column, kind, value, fold)
    if name == "contains":
        return _contains(column, kind, value, fold)
    if name in COMPARISONS:
        return _compare(column, kind, COMPARISONS[name], value)
    if name in ("in_set", "in"):
        if not isinstance(value, (list, tuple, set, frozenset)):
            return F.lit(False)
        test = F.lit(False)
        for one in sorted(value, key=str):
            test |= _same(column, kind, one, fold)
        return test
    if name == "between" and isinstance(value, (list, tuple)) and len(value) == 2:
        return _compare(column, kind, ">=", value[0]) & _compare(column, kind, "<=", value[1])
    return F.lit(None).cast("boolean")


def _tested(df: DataFrame, feature: str, operator: str, value: object, media: str, names: tuple) -> Column:
    """The name for true, false, unknown or not applicable of a predicate."""
    yes, no, unknown, not_applicable = map(F.lit, names)
    result = unknown
    if feature in df.columns:
        column, kind = F.col(feature), df.schema[feature].dataType
        fold = F.col(FOLDED + feature) if FOLDED + feature in df.columns else None
        gone = F.col(GONE + feature) if GONE + feature in df.columns else is_missing(column, kind, fold)
        test = holds(column, kind, operator, value, fold)
        result = F.when(gone, unknown).when(test, yes).when(~test, no).otherwise(unknown)
    for kind_of_media, features in NOT_OF_MEDIA.items():
        if feature in features and media in df.columns:
            result = F.when(F.col(media) == kind_of_media, not_applicable).otherwise(result)
    return result


def state(df: DataFrame, feature: str, operator: str, value: object, media: str = "media_type") -> Column:
    """The state of a predicate for every row; a feature that the table lacks is missing everywhere."""
    return _tested(df, feature, operator, value, media, (KNOWN_TRUE, KNOWN_FALSE, UNKNOWN, NOT_APPLICABLE))


def answer(df: DataFrame, feature: str, operator: str, value: object, media: str = "media_type") -> Column:
    """The answer to a predicate: YES, NO, or NO_ANSWER where it is unknown or not applicable."""
    return _tested(df, feature, operator, value, media, (YES, NO, NO_ANSWER, NO_ANSWER))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, rows, nulls, missing`` of every column, in one pass."""
    names = list(columns or df.columns)
    counts = []
    for name in names:
        column, kind = F.col(name), df.schema[name].dataType
        counts += [F.count_if(column.isNull()).alias(f"n_{name}"), F.count_if(is_missing(column, kind)).alias(f"m_{name}")]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"m_{c}").alias("missing")) for c in names])
    return one.select("rows", F.inline(rows)).select("column_name", "rows", "nulls", "missing")
