"""Distribution statistics: entropies, information gain, sample comparisons, weighted quantiles.

Running sums over all rows are computed in ranges of about equal size, each with the sum of the ranges before it, so that no
window spans the table. Ranges are of values and ties, so a value that a third of all rows have is spread over many of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolworks.session import materialise


def entropy(n: Column) -> Column:
    """Shannon entropy (bits) of the counts of a group."""
    total = F.sum(n)
    return F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)) / total


def feature_entropy(df: DataFrame, feature: str, value: Column | None = None) -> DataFrame:
    """``feature, n, unique_values, top_share, entropy`` of the non-null values of a feature."""
    counts = df.select((F.col(feature) if value is None else value).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("unique_values"), (F.max("c") / F.sum("c")).alias("top_share"), entropy(F.col("c")).alias("entropy")).select(F.lit(feature).alias("feature"), "*")


def running(df: DataFrame, value: str, sums: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``upto_<column>`` for each of the sums, in the order of ``value`` and ``ties``, and ``next_value``."""
    # ranges are as many as the session's shuffle partitions, small ones being joined; the table fixes where they are cut
    keyed = materialise(df.repartitionByRange(value, *ties).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = keyed.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums], F.min(value).alias("_least"))
    every = Window.orderBy("_range")  # one row for each range
    before = totals.select("_range", *[(F.sum(f"_all_{c}").over(every) - F.col(f"_all_{c}")).alias(f"_before_{c}") for c in sums], F.lead("_least").over(every).alias("_next"))
    order = Window.partitionBy("_range").orderBy(value, *ties)
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(F.broadcast(before), "_range")
    columns = {f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums} | {"next_value": F.coalesce(F.lead(value).over(order), "_next")}
    return joined.withColumns(columns).drop("_range", "_next", *[f"_before_{c}" for c in sums])


def distances(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``ks, wasserstein`` of two samples: the largest gap of their distribution functions, and the area between them."""
    both = a.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("upto_a") / F.col("na") - F.col("upto_b") / F.col("nb"))
    steps = running(counts, "v", ["a", "b"]).join(F.broadcast(total))  # one row
    return steps.agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next_value") - F.col("v"))).alias("wasserstein"))


def ks_p_value(d: float, n: int, m: int, terms: int = 100) -> float:
    """The asymptotic p-value of a two-sample Kolmogorov-Smirnov statistic (for small samples an approximation)."""
    from math import exp, sqrt

    if n <= 0 or m <= 0:
        return 1.0
    root = sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, terms + 1))))


def moments(df: DataFrame, value: str) -> DataFrame:
    """``n, mean, sd`` of the numbers of a column."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return good.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """:func:`ks_p_value` as a column."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + F.lit(0.11) / root) * d
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda sum_, k: sum_ + term(k))
    return F.when((n <= 0) | (m <= 0) | (x < 0.2), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def describe(df: DataFrame, value: str, at: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """``n, mean, sd`` and the quartiles and upper percentiles (interpolated) of a column.

    Percentiles are read off the running count of the distinct values, which no task holds as a whole.
    """
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))
    counts = running(good.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "v", ["c"])
    total = moments(df, value)
    place = {q: F.col("n").cast("double") * q - q for q in at}
    reached = lambda rank: F.min(F.when(F.col("upto_c") > rank, F.col("v")))
    ends = [e for q in at for e in (reached(F.floor(place[q])).alias(f"lo{int(q * 100)}"), reached(F.ceil(place[q])).alias(f"hi{int(q * 100)}"))]
    bounds = counts.join(F.broadcast(total.select("n"))).agg(*ends)  # one row
    between = lambda q: F.col(f"lo{int(q * 100)}") + (place[q] - F.floor(place[q])) * (F.col(f"hi{int(q * 100)}") - F.col(f"lo{int(q * 100)}"))
    return total.crossJoin(bounds).select("n", "mean", "sd", *[between(q).alias(f"p{int(q * 100)}") for q in at])  # one row each


def mean_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``smd``: the difference of the means of b and a in pooled standard deviations; 0 if these are 0."""
    x = moments(a, value).select(F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("sd").alias("s1"))
    y = moments(b, value).select(F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("sd").alias("s2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") ** 2 + (F.col("n2") - 1) * F.col("s2") ** 2) / (F.col("n1") + F.col("n2") - 2))
    return x.join(F.broadcast(y)).select(F.when(pooled > 0, (F.col("m2") - F.col("m1")) / pooled).otherwise(0.0).alias("smd"))  # one row each


def design_weights(population: DataFrame, sample: DataFrame, stratum: Column) -> DataFrame:
    """``stratum, population, sampled, weight``: rows that a sampled row of each stratum stands for."""
    a = population.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    b = sample.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("sampled"))
    return a.join(b, "stratum").select("stratum", "population", "sampled", (F.col("population") / F.col("sampled")).alias("weight"))


def weighted_quantiles(df: DataFrame, value: str, weight: str, at: Sequence[float], ties: Sequence[str] = ()) -> DataFrame:
    """``quantile, value``: quantiles of weighted rows, interpolated between the middles of their weights, clamped at the ends."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"), F.col(weight).alias("w"), *ties)
    total = rows.agg(F.sum("w").alias("all"))
    placed = running(rows, "v", ["w"], ties).join(F.broadcast(total)).withColumn("at", (F.col("upto_w") - F.col("w") / 2) / F.col("all"))  # one row
    bounds = []
    for i, q in enumerate(at):
        bounds += [F.max(F.when(F.col("at") <= q, F.struct("at", "v"))).alias(f"lo{i}"), F.min(F.when(F.col("at") >= q, F.struct("at", "v"))).alias(f"hi{i}")]
    one = placed.agg(*bounds)
    rows_ = []
    for i, q in enumerate(at):
        lo, hi = F.coalesce(f"lo{i}", f"hi{i}"), F.coalesce(f"hi{i}", f"lo{i}")
        step = F.when(hi["at"] > lo["at"], (q - lo["at"]) / (hi["at"] - lo["at"])).otherwise(0.0)
        rows_.append(F.struct(F.lit(q).alias("quantile"), (lo["v"] + step * (hi["v"] - lo["v"])).alias("value")))
    return one.select(F.inline(F.array(*rows_)))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """``sample, reweighted``: the plain and the weighted mean of a column; rows without a value or weight are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(weight).isNotNull())
    return rows.agg(F.avg(value).alias("sample"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("reweighted"))


def information_gain(df: DataFrame, target: Column, bin_: Column) -> DataFrame:
    """``root_entropy, conditional_entropy, gain`` of a binary target by bins; rows without a bin lose their weight."""
    rows = df.select(target.cast("int").alias("t"), bin_.alias("b"))
    total = rows.agg(F.count(F.lit(1)).alias("all"), F.avg("t").alias("p"))
    part = lambda p: F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
    bins = rows.where(F.col("b").isNotNull()).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("q"))
    inner = bins.join(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("all") * part(F.col("q"))).alias("conditional_entropy"), F.first("p").alias("p"))  # one row
    return inner.select(part(F.col("p")).alias("root_entropy"), "conditional_entropy", (part(F.col("p")) - F.col("conditional_entropy")).alias("gain"))
