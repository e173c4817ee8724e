"""Column profiles of loads: masks of values, dominant patterns, rare-mask violations and what moved between loads.

A value is generalised to a mask of character classes (``a`` lower case, ``A`` other letters, ``9`` digits, runs written
once; any other character stands for itself). Everything below starts from one histogram of (load, column, value), which
combines on the map side, so a load or a value that holds a third of all rows reaches the shuffle as a few rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.session import Scratch

def number_text(value: Column) -> Column:
    """A double as text without exponent or needless decimals: ``12``, ``12.5``, ``-3``; null and NaN are null."""
    whole = value == F.rint(value)
    exact = F.when(F.abs(value) < 1e15, value.cast("bigint").cast("string")).otherwise(F.format_string("%.0f", value))
    return F.when(~F.isnan(value), F.when(whole, exact).otherwise(value.cast("string")))


def value_text(column: Column, kind: T.DataType) -> Column:
    """A value as the text that is profiled: numbers without needless decimals, lists joined by commas."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return number_text(column.cast("double"))
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, T.ArrayType):
        return F.array_join(column.cast("array<string>"), ",")
    return column.cast("string")


def mask(text: Column) -> Column:
    """The character-class mask of a text; runs of one class are written once, and null stays null."""
    lower = F.regexp_replace(text, r"\p{Ll}+", "a")
    other = F.regexp_replace(lower, r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}]+", "A")
    digits = F.regexp_replace(other, r"\p{Nd}+", "9")
    return F.regexp_replace(digits, r"[\s\x85\p{Z}]+", " ")


def value_histogram(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows ``by..., column_name, value, n``: how often each value of each column occurs in each load.

    Values are texts as of :func:`value_text`; NaN and null both count as the null value. Rows whose load is null form a load
    of their own. An empty table has an empty histogram.
    """
    pairs = [F.struct(F.lit(name).alias("column_name"), value_text(F.col(name), df.schema[name].dataType).alias("value")) for name in columns]
    long = df.select(*by, F.inline(F.array(*pairs)))
    return long.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


#: Masks that a column of whole numbers may have.
WHOLE = "^-?9$"


def dominant_masks(masks: DataFrame, admits: str | None = None) -> DataFrame:
    """``column_name, dominant``: the masks of each column's dominant pattern, mined over all loads.

    ``masks`` are rows ``column_name, mask, n``. The pattern is the column's commonest mask and the masks that differ from it
    by a sign only; ties go to the first in code-point order. With ``admits``, a regular expression, only masks it matches
    can be dominant; a column without such a mask has no row, and all its values violate it.
    """
    known = masks.where(F.col("mask").isNotNull() if admits is None else F.col("mask").rlike(admits))
    shape = F.regexp_replace("mask", "^-", "").alias("shape")
    overall = known.groupBy("column_name", "mask").agg(F.sum("n").alias("n"))
    shapes = overall.groupBy("column_name", shape).agg(F.sum("n").alias("n"), F.collect_set("mask").alias("masks"))  # at most two masks a shape
    top = shapes.groupBy("column_name").agg(F.min_by("masks", F.struct(-F.col("n"), "shape")).alias("dominant"))
    return top.select("column_name", "dominant")


@dataclass(frozen=True)
class Rule:
    """What a numeric column should look like, and when a load of it has gone wrong or has moved.

    ``low`` to ``high`` are plausible. ``moved`` is the change of the median that counts as a shift: an absolute amount, or
    with ``relative`` a share of the earlier median.
    """

    low: float
    high: float
    moved: float = 0.25
    relative: bool = True


def load_figures(histogram: DataFrame, by: Sequence[str], rules: dict[str, Rule]) -> DataFrame:
    """Per load and column: rows, missing, present, out_of_range, violations, top_count, median of plausible whole values.

    Everything is read off the distribution of masks: missing values are those of the null mask, and values whose mask is
    not of the pattern mined for their column violate it. Conforming values in range are plausible; their median is exact
    (mean of the middle two), computed from value counts, of which there are at most as many as plausible whole values.
    """
    number = F.col("value").try_cast("double")
    low = high = F.lit(None).cast("double")
    for name, rule in rules.items():
        low = F.when(F.col("column_name") == name, F.lit(float(rule.low))).otherwise(low)
        high = F.when(F.col("column_name") == name, F.lit(float(rule.high))).otherwise(high)
    masked = histogram.withColumn("mask", mask(F.col("value")))
    mined = F.broadcast(dominant_masks(masked, WHOLE))  # one row for each of the rules
    conforms = F.coalesce(F.array_contains("dominant", F.col("mask")), F.lit(False))
    values = masked.join(mined, "column_name", "left").select(
        *by, "column_name", "n", F.col("mask").isNull().alias("gone"), F.coalesce((number < low) | (number > high), F.lit(False)).alias("outside"),
        conforms.alias("conforms"), number.alias("number"),
    )
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return values.groupBy(*by, "column_name").agg(
        F.sum("n").alias("rows"),
        total(F.col("gone")).alias("missing"),
        total(~F.col("gone")).alias("present"),
        total(F.col("outside")).alias("out_of_range"),
        total(~F.col("gone") & ~F.col("conforms")).alias("violations"),
        F.max(F.when(~F.col("gone"), F.col("n"))).alias("top_count"),
        F.expr("percentile(CASE WHEN NOT outside AND conforms THEN number END, 0.5D, n)").alias("median"),
    )


def load_issues(df: DataFrame, feed: str, load: str, rules: dict[str, Rule], tolerated: int = 2, null_step: float = 0.15) -> DataFrame:
    """The issues ``load, column_name, issue`` of every load of every feed.

    * ``range`` / ``pattern``: more than ``tolerated`` per cent of the present values are outside the plausible values, or
      violate the column's dominant pattern of whole numbers;
    * ``constant``: one value makes up more than half of the present ones;
    * ``null_rate``: the missing share differs by more than ``null_step`` from that of the feed's preceding load;
    * ``shift``: the median of plausible whole values moved further than the rule allows.

    Null and NaN are missing. The first load of a feed has neither of the last two, nor has a load whose own or preceding
    median is undefined a shift. Rows without a load id belong to no load. Shares are compared in whole numbers, so a share
    of exactly the limit is no issue. Repeated rows count; an empty table has no issues.
    """
    rows = df.where(F.col(load).isNotNull()).select(feed, load, *rules)
    with Scratch(df.sparkSession) as scratch:  # the loads are read once, for the patterns and for the figures
        histogram = scratch.keep(value_histogram(rows, [feed, load], list(rules)), "histogram")
        figures = load_figures(histogram, [feed, load], rules)
        return scratch.hand_over(_issues_of(figures, feed, load, rules, tolerated, null_step), "issues")


def _issues_of(figures: DataFrame, feed: str, load: str, rules: dict[str, Rule], tolerated: int, null_step: float) -> DataFrame:
    earlier = Window.partitionBy(feed, "column_name").orderBy(load)
    exact = lambda name: F.col(name).cast("decimal(15,0)")
    steps = figures.withColumns({f"last_{c}": F.lag(c).over(earlier) for c in ("rows", "missing", "median")})
    share_moved = F.abs(exact("missing") * exact("last_rows") - exact("last_missing") * exact("rows")) * 1000 > exact("rows") * exact("last_rows") * round(null_step * 1000)
    shifted = F.lit(False)
    for name, rule in rules.items():
        limit = F.abs(F.col("last_median")) * rule.moved if rule.relative else F.lit(float(rule.moved))
        shifted = F.when(F.col("column_name") == name, F.abs(F.col("median") - F.col("last_median")) > limit).otherwise(shifted)
    found = {
        "range": F.col("out_of_range") * 100 > F.col("present") * tolerated,
        "pattern": F.col("violations") * 100 > F.col("present") * tolerated,
        "constant": F.col("top_count") * 2 > F.col("present"),
        "null_rate": share_moved,
        "shift": shifted,
    }
    issues = F.array_compact(F.array(*[F.when(condition, F.lit(issue)) for issue, condition in found.items()]))
    return steps.select(load, "column_name", F.explode(issues).alias("issue"))


def mask_counts(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows ``by..., column_name, mask, n, distinct_values``; the null mask counts the missing values."""
    return histogram.groupBy(*by, "column_name", mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"), F.count("value").alias("distinct_values"))


def column_profile(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per load and column: rows, null rate, distinct values, least and greatest value, the dominant mask and its share.

    Numbers are compared as numbers if every value of the group is one, and else as text. Ties of masks go to the first in
    code-point order.
    """
    number = F.col("value").try_cast("double")
    values = histogram.groupBy(*by, "column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct_values"), F.count(number).alias("numbers"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.min("value").alias("first_text"), F.max("value").alias("last_text"),
    )
    masks = mask_counts(histogram, by).where(F.col("mask").isNotNull())
    top = masks.groupBy(*by, "column_name").agg(
        F.max_by("mask", F.struct(F.col("n"), F.col("mask"))).alias("dominant_mask"), F.max("n").alias("dominant_n"), F.count(F.lit(1)).alias("masks")
    )
    same = [values[c].eqNullSafe(top[c]) for c in (*by, "column_name")]
    numeric = (F.col("numbers") == F.col("distinct_values")) & (F.col("numbers") > 0)
    return values.join(top, same, "left").select(
        *[values[c] for c in (*by, "column_name")],
        "rows",
        (F.col("missing") / F.col("rows")).alias("null_rate"),
        "distinct_values",
        F.when(numeric, number_text(F.col("low"))).otherwise(F.col("first_text")).alias("least"),
        F.when(numeric, number_text(F.col("high"))).otherwise(F.col("last_text")).alias("greatest"),
        F.coalesce("masks", F.lit(0)).alias("masks"),
        "dominant_mask",
        (F.col("dominant_n") / (F.col("rows") - F.col("missing"))).alias("dominant_share"),
    )


def rare_masks(histogram: DataFrame, by: Sequence[str], rare_share: float = 0.02) -> DataFrame:
    """The violations: masks that hold less than ``rare_share`` of a column's present values over all loads.

    Rows ``by..., column_name, mask, n`` give where they stand. A column's commonest mask is never rare.
    """
    masks = mask_counts(histogram, by).where(F.col("mask").isNotNull())
    overall = masks.groupBy("column_name", "mask").agg(F.sum("n").alias("all_n"))
    column = Window.partitionBy("column_name")
    rare = overall.withColumns({"total": F.sum("all_n").over(column), "most": F.max("all_n").over(column)})
    rare = rare.where((F.col("all_n") < F.col("total") * rare_share) & (F.col("all_n") < F.col("most")))
    return masks.join(rare.select("column_name", "mask"), ["column_name", "mask"], "left_semi").select(*by, "column_name", "mask", "n")


def mask_divergence(histogram: DataFrame, feed: str, load: str) -> DataFrame:
    """Jensen-Shannon divergence (bits, 0 to 1) between the masks of each load and the feed's preceding load.

    Rows ``feed, load, column_name, divergence``; missing values count as a mask of their own. First loads have none.
    """
    masks = mask_counts(histogram.where(F.col(load).isNotNull()), [feed, load]).withColumn("mask", F.coalesce("mask", F.lit("<missing>")))
    loads = masks.groupBy(feed, load, "column_name").agg(F.sum("n").alias("rows"))
    order = Window.partitionBy(feed, "column_name").orderBy(load)
    loads = loads.withColumns({"next_load": F.lead(load).over(order), "first": F.row_number().over(order) == 1})
    shares = masks.join(loads, [feed, load, "column_name"]).withColumn("share", F.col("n") / F.col("rows"))
    now = shares.select(feed, load, "column_name", "mask", F.col("share").alias("p"), F.lit(0.0).alias("q"), "first").where(~F.col("first"))
    before = shares.where(F.col("next_load").isNotNull()).select(feed, F.col("next_load").alias(load), "column_name", "mask", F.lit(0.0).alias("p"), F.col("share").alias("q"))
    both = now.drop("first").unionByName(before).groupBy(feed, load, "column_name", "mask").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return both.groupBy(feed, load, "column_name").agg(F.sum((part(F.col("p")) + part(F.col("q"))) / 2).alias("divergence"))
