"""Line-delimited JSON records: reading, profiling, incremental appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.session import Scratch


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of all lines that are not blank; ``line_no`` orders the lines of one file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines.where(F.trim("line") != "")


def parse(lines: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The records of JSON lines, with ``file`` and ``line_no``; lines that are no JSON object are left out."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    of = lines.withColumn("of", F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = of.where(F.col("of").isNotNull() & F.col("of._corrupt_record").isNull() & F.trim("line").startswith("{"))
    return good.select("file", "line_no", "of.*").drop("_corrupt_record")


def profile(lines: DataFrame, key: str = "id") -> DataFrame:
    """``file, lines, unique_ids, duplicate_ids, null_ids, malformed`` by file. A line that is no object is malformed."""
    value = F.get_json_object("line", f"$.{key}")
    parsed = F.from_json("line", T.StructType([T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"})
    good = F.trim("line").startswith("{") & parsed["_corrupt_record"].isNull()
    rows = lines.select("file", F.coalesce(good, F.lit(False)).alias("good"), F.when(good, value).alias("id"))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("id").alias("unique_ids"), (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"),
        F.count_if(F.col("good") & F.col("id").isNull()).alias("null_ids"), F.count_if(~F.col("good")).alias("malformed"),
    )


def _unknown(records: DataFrame, path: str, key: str) -> DataFrame:
    """The records whose key the folder does not have, one for each key; any one of several."""
    spark = records.sparkSession
    fresh = records.where(F.col(key).isNotNull()).dropDuplicates([key])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        there = spark.read.schema(T.StructType([records.schema[key]])).json(path)
        fresh = fresh.join(there.where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return fresh.select(*records.columns)


def append_new(records: DataFrame, path: str, key: str = "id") -> int:
    """Append the records whose key the folder does not have, one for each key; the number appended.

    Rows without a key are not appended. Of several rows with a new key, any one is.
    """
    with Scratch(records.sparkSession) as scratch:
        kept = scratch.keep(_unknown(records, path, key), "append")
        kept.write.mode("append").json(path)
        return kept.count()


def append_with_progress(records: DataFrame, path: str, key: str, progress, tasks: list) -> int:
    """As :func:`append_new`, noting for each of the tasks (``task_key, first``) how many records it gave and how many are new."""
    spark = records.sparkSession
    with Scratch(spark) as scratch:
        every = scratch.keep(records, "crawled")
        kept = scratch.keep(_unknown(every, path, key), "append")
        kept.write.mode("append").json(path)
        counts = lambda df, name: df.groupBy("task_key").agg(F.count(F.lit(1)).alias(name))
        of = spark.createDataFrame([(t.task_key, t.first) for t in tasks], "task_key string, page int")
        noted = of.join(counts(every, "total"), "task_key", "left").join(counts(kept, "new"), "task_key", "left").fillna(0, ["total", "new"])
        progress.append(noted.withColumn("complete", F.lit(True)))
        return kept.count()
