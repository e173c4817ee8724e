"""Crawls: tasks of each strategy, progress that survives interruptions, enrichment by key, and runs that stop on request.

A task is a row ``task_key, strategy, endpoint, params`` (JSON). What a task has yielded is appended to a progress table; a
later run resumes each task after its last page and skips those that are complete.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.sources import jsonl

TASKS = "task_key string, strategy string, endpoint string, params string"
PROGRESS = "task_key string, page int, complete boolean, total bigint, new bigint, at timestamp"


def _rows(spark: SparkSession, rows: list[tuple[str, str, str, dict]]) -> DataFrame:
    return spark.createDataFrame([(k, s, e, json.dumps(p, sort_keys=True)) for k, s, e, p in rows], TASKS)


def low_popularity_tasks(spark: SparkSession, years: Sequence[int], endpoints: Sequence[str] = ("movie", "tv"), least_votes: int = 1) -> DataFrame:
    """A sweep of each year from the least voted records up; records without a vote are left out by ``least_votes``."""
    params = lambda y: {"sort_by": "vote_count.asc", "vote_count.gte": least_votes, "year": y}
    return _rows(spark, [(f"low:{y}:{e}", "low_popularity", e, params(y)) for y in years for e in endpoints])


def ranking_tasks(spark: SparkSession, rankings: Sequence[str], endpoint: str = "ranking") -> DataFrame:
    """A task for each ranking."""
    return _rows(spark, [(f"ranking:{r}", "ranking", endpoint, {"ranking_type": r}) for r in rankings])


def search_tasks(terms: DataFrame, term: str, endpoint: str = "search", least: int = 3) -> DataFrame:
    """A task for each distinct search term of ``least`` characters or more; shorter ones, and null, are not searched for."""
    known = terms.select(F.lower(F.trim(term)).alias("q")).where(F.length("q") >= least).distinct()
    return known.select(F.concat(F.lit("search:"), "q").alias("task_key"), F.lit("search").alias("strategy"), F.lit(endpoint).alias("endpoint"), F.to_json(F.struct("q")).alias("params"))


class Progress:
    """An append-only table of what tasks have yielded, as JSON lines below a folder; damaged lines count as absent."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """All entries that can be read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], PROGRESS)
        kind = T._parse_datatype_string(PROGRESS)
        return self.spark.read.schema(kind).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(self.folder)

    def latest(self) -> DataFrame:
        """``task_key, page, complete, total, new``: the last page, whether the task is complete, and its sums."""
        known = self.rows().where(F.col("task_key").isNotNull())
        return known.groupBy("task_key").agg(F.max("page").alias("page"), F.coalesce(F.bool_or("complete"), F.lit(False)).alias("complete"), F.sum("total").alias("total"), F.sum("new").alias("new"))

    def pending(self, tasks: DataFrame) -> DataFrame:
        """The tasks that are not complete, with the page ``first`` at which to go on."""
        left = tasks.join(self.latest().where("complete").select("task_key"), "task_key", "left_anti")
        at = self.latest().select("task_key", (F.col("page") + 1).alias("first"))
        return left.join(at, "task_key", "left").withColumn("first", F.coalesce("first", F.lit(1)))

    def append(self, entries: DataFrame) -> None:
        """Add entries ``task_key, page, complete, total, new``."""
        entries.withColumn("at", F.current_timestamp()).select(*[f.name for f in T._parse_datatype_string(PROGRESS).fields]).write.mode("append").json(self.folder)

    def by_strategy(self, tasks: DataFrame) -> DataFrame:
        """``strategy, tasks, complete, total, new`` of all tasks, those without progress included."""
        known = tasks.select("task_key", "strategy").join(self.latest(), "task_key", "left")
        sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "new")}
        return known.groupBy("strategy").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("complete")).alias("complete"), *[s.alias(c) for c, s in sums.items()])


def crawl(spark: SparkSession, tasks: DataFrame, progress: Progress, target: str, format: str = "rest", key: str = "id", **options: str) -> int:
    """Read the pending tasks, append the records with new ids to ``target`` and note the progress; the number of new records.

    The tasks become one query of the data source, which reads them in parallel; their number is bounded by the strategies.
    """
    pending = progress.pending(tasks).collect()
    if not pending:
        return 0
    wanted = [{"key": t.task_key, "endpoint": t.endpoint, "params": json.loads(t.params), "first": t.first} for t in pending]
    rows = spark.read.format(format).options(tasks=json.dumps(wanted), **options).load()
    found = rows.select("task_key", F.get_json_object("record", f"$.{key}").cast("bigint").alias(key), "record")
    return jsonl.append_with_progress(found, target, key, progress, pending)


def enrich_by_key(keys: DataFrame, key: str, fetch: Callable[[int], list[str]], column: str, target: str, most: int | None = None) -> int:
    """Fetch a list for each key that ``target`` does not have yet, and append ``key, column``; the number of keys done.

    A fetch that fails gives an empty list, and its key counts as done. ``most`` bounds one run, least keys first.
    """
    spark, kind = keys.sparkSession, keys.schema[key].dataType
    todo = keys.select(key).where(F.col(key).isNotNull()).distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        todo = todo.join(spark.read.schema(T.StructType([T.StructField(key, kind)])).parquet(target), key, "left_anti")
    if most is not None:
        todo = todo.orderBy(key).limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = []
            for one in batch[key]:
                try:
                    lists.append(list(fetch(one)))
                except Exception:  # the source has nothing for this key, now or ever
                    lists.append([])
            yield pd.DataFrame({key: batch[key], column: lists})

    schema = T.StructType([T.StructField(key, kind), T.StructField(column, T.ArrayType(T.StringType()))])
    before = spark.read.schema(schema).parquet(target).count() if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else 0
    todo.mapInPandas(run, schema).write.mode("append").parquet(target)
    return spark.read.schema(schema).parquet(target).count() - before


def run_all(steps: Sequence[tuple[str, Callable[[], int]]], stop: Callable[[], bool] = lambda: False) -> dict[str, int]:
    """Run strategies one after the other until one is done or ``stop`` says so between them; new records by strategy."""
    done: dict[str, int] = {}
    for name, step in steps:
        if stop():
            break
        done[name] = step()
    return done


class Stop:
    """A request to stop after the step that is running: the first interrupt asks, a second one ends the process at once."""

    def __init__(self) -> None:
        self.asked = False

    def __call__(self, *_: object) -> bool:
        """Whether it was asked for; as a signal handler, ask for it."""
        if _:
            if self.asked:
                raise KeyboardInterrupt
            self.asked = True
        return self.asked
