"""Session building and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spoolworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC and adaptive execution.

    ``master`` is left to spark-submit unless given. Extra keyword settings use ``__`` for ``.``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Only a single-process session may go without one; it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spoolworks-")
    context.setCheckpointDir(folder)
    _own(spark, folder)
    return folder


_FOLDERS: dict[str, SparkSession] = {}


def _own(spark: SparkSession, folder: str) -> None:
    """Have a folder removed when the process ends."""
    if not _FOLDERS:
        atexit.register(_sweep)
    _FOLDERS[folder] = spark


def _sweep() -> None:
    """Remove the folders of this process's applications."""
    for folder, spark in _FOLDERS.items():
        with suppress(Exception):  # the application may have ended before
            remove_path(spark, folder)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, below a folder of the application, which is removed when the process ends."""
    folder = f"{shared_dir(spark)}/spoolworks-{spark.sparkContext.applicationId}"
    _own(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives the loss of executors."""
    return _written(df, work_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables between the steps of one operator, in the shared folder; ``with`` removes them, also after a failure."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write a table of the run and read it back, as :func:`materialise` does."""
        path = work_path(self.spark, label)
        self.paths.append(path)
        return _written(df, path)

    def clear(self, but: int = 0) -> None:
        """Remove the tables, but for the last ones."""
        gone = self.paths[: len(self.paths) - but]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            remove_path(self.spark, path)

    def hand_over(self, df: DataFrame, label: str = "result") -> DataFrame:
        """Write what the run returns, so that it outlives the run's tables; it goes with the application's folder."""
        return materialise(df, label)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`work_path`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Sent:
    """An object sent once to every executor, by value, and unpacked by each Python worker's task that asks for it."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self) -> object:
        """The object."""
        return cloudpickle.loads(self._packed.value)
