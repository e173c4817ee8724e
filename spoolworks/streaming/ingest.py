"""Incremental ingest of record files: new files only, each id once, resumable from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spoolworks.session import Scratch


def stream_records(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """The records of the files that appear in a folder."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def first_seen(records: DataFrame, key: str, time: str | None = None, late: str = "30 days") -> DataFrame:
    """Each key once. With ``time``, keys are remembered for as long as rows may be late, which bounds the state."""
    present = records.where(F.col(key).isNotNull())
    if time is None:
        return present.dropDuplicates([key])
    return present.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(records: DataFrame, time: str, by: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``window_start, by, n`` of records in windows of event time; rows later than ``late`` are left out."""
    counts = records.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), by, "n")


def ingest_apart(records: DataFrame, time: str, late: str, target: str, late_target: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that are in time to ``target`` and those later than ``late`` to ``late_target``, so that none is lost.

    A row is late if it is older, by more than ``late``, than the newest row of the batches before; rows without a time are in
    time. Each batch has a folder of its own, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-times")
        newest = None
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            newest = spark.read.schema("at timestamp, batch bigint").parquet(f"{checkpoint}-times").where(F.col("batch") < number).agg(F.max("at")).first()[0]
        limit = F.lit(newest) - F.expr(f"INTERVAL {late}") if newest else F.lit(None).cast("timestamp")
        with Scratch(spark) as scratch:
            rows = scratch.keep(batch.withColumn("_late", F.coalesce(F.col(time) < limit, F.lit(False))), "batch")
            for is_late, folder in ((False, target), (True, late_target)):
                rows.where(F.col("_late") == is_late).drop("_late").write.mode("overwrite").parquet(f"{folder}/batch={number}")
            rows.agg(F.max(time).cast("timestamp").alias("at")).write.mode("overwrite").parquet(f"{checkpoint}-times/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what there is now to Parquet and stop; the next call goes on from the checkpoint."""
    return records.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
