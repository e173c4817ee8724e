"""Loading of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; a missing table fails when the plan is analysed."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def inspect(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """``name, files, bytes, rows`` of every table in a folder, by name; a folder that is absent has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
    rows = []
    for one in sorted((p for p in found if p.getName().endswith(suffix)), key=lambda p: p.getName()):
        summary = system.getContentSummary(one)
        rows.append((one.getName()[: -len(suffix)], summary.getFileCount(), summary.getLength(), spark.read.parquet(one.toString()).count()))
    return spark.createDataFrame(rows, "name string, files bigint, bytes bigint, rows bigint")


def lookup(spark: SparkSession, path: str, key: str, value: str, most: int = 10_000) -> dict:
    """A small table of names as a dictionary, the least value of each key; more than ``most`` keys are refused."""
    rows = spark.read.parquet(path).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} keys")
    return {r[key]: r[value] for r in rows}
