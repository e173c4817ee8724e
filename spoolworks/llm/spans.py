"""Long spans that stand verbatim in more than one record, found with a log-structured fingerprint index.

A span of ``length`` code points is a window; a text's shared part is the union of its windows that another text holds too.

1. Exact copies are grouped first, by text: a text of which there are two copies is shared whole, and one copy of it goes on.
2. *Index.* Of each window the k-gram with the smallest hash is its anchor (winnowing), so two equal windows have equal
   anchors, and about two in 200 k-grams are anchors. Each batch of texts becomes an immutable run, sorted and bucketed by
   hash, that holds for each anchor hash the least and the greatest record that has it. A run is as long as there are
   different hashes: the hash of a passage that a third of all records quote is combined before it is shuffled. A new
   batch is merge-joined with the historical runs without moving them; runs are compacted when there are ``fan_in``. The
   index lies in the shared folder and outlives the call and the session (:meth:`FingerprintIndex.open`).
3. *Verification.* An anchor whose least and greatest record differ is shared, and only texts with such an anchor go on.
   Windows whose anchor is about as far from their begin form a block; what they have in common, the block's core, must be
   shared if one of them is. Windows of blocks with a shared core are hashed whole, with 96 bits of two hash functions, and
   those of two records or more are shared. Counting combines least and greatest record before anything is shuffled, so no
   pairs of records are ever formed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spoolworks.session import Scratch, materialise, remove_path, shared_dir

#: Code points hashed at once, but for longer texts.
SLICE = 1_000_000
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MIXERS = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)
_PLACE = np.uint64(0xFFFFFF)


class Texts:
    """Some texts as one array of code points, with the prefix sums of their polynomial hashes."""

    def __init__(self, texts: list[str]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _prefix(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self.sums:
            mixed = self.codes * np.uint64(_MIXERS[which])
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(_MIXERS[1 - which])
            mixed ^= mixed >> np.uint64(32)
            base, back = _BASES[which], pow(_BASES[which], -1, 2**64)
            mixed *= np.cumprod(np.full(len(mixed), base, np.uint64))
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)]), np.cumprod(np.full(len(mixed), back, np.uint64))
        return self.sums[which]

    def blocks(self, begins: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """Where the core of each window's block begins: blocks hold windows whose anchors are so many places or fewer apart."""
        return place - (place - begins) // size * size

    def hashes(self, size: int, at: np.ndarray | slice, which: int = 0) -> np.ndarray:
        """Hashes of the windows of ``size`` code points that begin at the given places of the array."""
        prefix, back = self._prefix(which)
        n = len(self.codes) - size + 1
        value = (prefix[size:] - prefix[:n])[at] * back[:n][at]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x94D049BB133111EB)
        return value ^ (value >> np.uint64(29))

    def windows(self, length: int) -> np.ndarray:
        """The places at which a window begins that lies in one text."""
        inside = np.zeros(len(self.codes) + 1, np.int64)
        fits = self.lengths >= length
        np.add.at(inside, self.begins[fits], 1)
        np.add.at(inside, (self.begins + self.lengths - length + 1)[fits], -1)
        return np.flatnonzero(np.cumsum(inside)[:-1])

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins of the windows, place of each one's anchor, hashes of all k-grams)."""
        begins = self.windows(length)
        if not len(begins):
            return begins, begins, np.empty(0, np.uint64)
        grams = self.hashes(gram, slice(None))
        width = length - gram + 1
        keys = (grams & ~_PLACE) | (_PLACE - (np.arange(len(grams), dtype=np.uint64) & _PLACE))  # ties: the last
        padded = np.concatenate([keys, np.full(-len(keys) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[begins], ahead[begins + width - 1])
        place = begins + ((_PLACE - (least & _PLACE)).astype(np.int64) - begins) % (int(_PLACE) + 1)
        return begins, place, grams

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Which text each place lies in."""
        return np.searchsorted(self.begins, places, "right") - 1


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a batch of about SLICE code points."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(batch.column(column)):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= SLICE:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows ``fp, doc, pos`` of the anchors of all windows of texts ``doc, text``."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("pos", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in _slices(batch, 1):
                texts = Texts(body)
                _, place, grams = texts.anchors(length, gram)
                place = np.unique(place)
                if len(place):
                    owner = texts.owner(place)
                    rows = batch.column(0).take(pa.array(first + owner))
                    columns = [pa.array(grams[place].view(np.int64)), rows, pa.array((place - texts.begins[owner]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc", "text").mapInArrow(run, schema)


def block_size(length: int) -> int:
    """How many windows a block has at most."""
    return max(1, length // 12)


def _marked(texts: Texts, batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Which places of the texts are in the lists of the batch's third column."""
    marked = np.zeros(len(texts.codes), bool)
    for row, begin in enumerate(texts.begins):
        marked[begin + batch.column(2)[first + row].values.to_numpy()] = True
    return marked


def cores(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows ``core, doc, at``: hash and begin of the cores of all blocks of texts ``doc, text, places`` that are anchored there."""
    schema = T.StructType([T.StructField("core", T.LongType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("at", T.IntegerType())])
    arrow, size = to_arrow_schema(schema), block_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in _slices(batch, 1):
                texts = Texts(body)
                begins, place, _ = texts.anchors(length, gram)
                if len(begins):
                    near = _marked(texts, batch, first)[place]
                    at = np.unique(texts.blocks(begins[near], place[near], size))
                    owner = texts.owner(at)
                    columns = [pa.array(texts.hashes(length - size + 1, at).view(np.int64)), batch.column(0).take(pa.array(first + owner)), pa.array((at - texts.begins[owner]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc", "text", "places").mapInArrow(run, schema)


def candidates(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows ``h1, h2, doc, start`` of the windows of texts ``doc, text, places`` whose block's core begins at one of the places."""
    schema = T.StructType(
        [T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("start", T.IntegerType())]
    )
    arrow, size = to_arrow_schema(schema), block_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in _slices(batch, 1):
                texts = Texts(body)
                begins, place, _ = texts.anchors(length, gram)
                if not len(begins):
                    continue
                at = begins[_marked(texts, batch, first)[texts.blocks(begins, place, size)]]
                if len(at):
                    owner = texts.owner(at)
                    columns = [
                        pa.array(texts.hashes(length, at).view(np.int64)),
                        pa.array((texts.hashes(length, at, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        batch.column(0).take(pa.array(first + owner)),
                        pa.array((at - texts.begins[owner]).astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc", "text", "places").mapInArrow(run, schema)


class FingerprintIndex:
    """Sorted immutable runs of anchor hashes, each with the least and the greatest record that has it.

    Runs are bucketed tables in the shared folder, all with the same number of buckets, so that merging them or joining a
    batch with them moves no historical rows. Beside them lie the anchors' places, as they were written with each batch.
    A manifest, written anew after each change, names what belongs to the index; what it does not name is of no account, so
    a change that fails leaves the index as it was. Records must be orderable; ``drop`` removes the index.
    """

    def __init__(self, spark: SparkSession, length: int = 300, gram: int = 100, fan_in: int = 2, buckets: int | None = None, folder: str | None = None) -> None:
        if not 0 < gram <= length:
            raise ValueError("a k-gram is at most as long as a span")
        self.spark, self.length, self.gram, self.fan_in = spark, length, gram, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{shared_dir(spark)}/spans-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.places: list[str] = []
        self.kind, self.version = "bigint", 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier call or session left in a folder."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(f"no index in {folder}")
        newest = max(str(f.getPath().getParent().toString()) for f in found)
        state = json.loads(spark.read.text(newest).first().value)
        index = cls(spark, state["length"], state["gram"], state["fan_in"], state["buckets"], folder)
        index.runs, index.places, index.kind, index.version = state["runs"], state["places"], state["kind"], state["version"]
        for name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, least {index.kind}, greatest {index.kind}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return index

    def _save(self) -> None:
        self.version += 1
        state = {n: getattr(self, n) for n in ("length", "gram", "fan_in", "buckets", "runs", "places", "kind", "version")}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version:012}")
        remove_path(self.spark, f"{self.folder}/manifest-{self.version - 1:012}")

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.format("parquet")
        writer.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, f"{self.folder}/{name}")

    def anchors(self) -> DataFrame | None:
        """Rows ``fp, doc, pos`` of all batches; None if there are none."""
        parts = [self.spark.read.schema(f"fp bigint, doc {self.kind}, pos int").parquet(f"{self.folder}/{p}") for p in self.places]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch ``doc, text``, whose texts are read once; the result is that of :meth:`add_anchors`."""
        return self.add_anchors(anchors(docs, self.length, self.gram))

    def add_anchors(self, rows: DataFrame) -> DataFrame:
        """Add a batch by its anchors ``fp, doc, pos``; the result has the hashes ``fp`` of it that two records or more now have.

        The batch's run is merge-joined with every historical run, the result written to the shared folder.
        """
        self.kind = rows.schema["doc"].dataType.simpleString()
        place = f"places_{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{place}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{place}")
        name = self._write(rows.groupBy("fp").agg(F.min("doc").alias("least"), F.max("doc").alias("greatest")))
        met = self.spark.table(name)
        for old in self.runs:
            there = self.spark.table(old).select("fp", F.col("least").alias("l"), F.col("greatest").alias("g"))
            met = met.join(there.hint("merge"), "fp", "left").select("fp", F.least("least", "l").alias("least"), F.greatest("greatest", "g").alias("greatest"))
        shared = materialise(met.where(F.col("least") < F.col("greatest")).select("fp"), "met")
        self.runs.append(name)
        self.places.append(place)
        self._save()
        return shared

    def compact(self) -> None:
        """Merge all runs into one if there are ``fan_in``."""
        if len(self.runs) < self.fan_in:
            return
        rows = reduce(DataFrame.unionByName, [self.spark.table(r) for r in self.runs])
        old, self.runs = self.runs, [self._write(rows.groupBy("fp").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")))]
        self._save()
        for name in old:
            self._drop(name)

    def drop(self) -> None:
        """Remove the index."""
        for name in self.runs:
            self._drop(name)
        self.runs, self.places = [], []
        remove_path(self.spark, self.folder)

    def new_spans(self, batch: DataFrame, history: DataFrame) -> DataFrame:
        """Add a batch ``doc, text``; ``doc, start, end``: the spans of its texts that history or another of its texts holds.

        ``history`` are the texts ``doc, text`` added before; of these only the ones with an anchor of the batch are compared.
        """
        self.compact()
        shared = self.add(batch)
        texts = batch.select("doc", "text").unionByName(history.select("doc", "text"))
        return verify(texts, self.anchors(), shared, self.length, self.gram).join(batch.select("doc").distinct(), "doc", "left_semi")


def _with_places(docs: DataFrame, places: DataFrame, place: str) -> DataFrame:
    """The texts that have a place, with their places; these are no more than the text has code points."""
    return docs.join(places.groupBy("doc").agg(F.collect_list(place).alias("places")), "doc")


def verify(docs: DataFrame, places: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows ``doc, start, end``: the merged spans of texts ``doc, text`` that another of these texts holds too.

    ``places`` are the anchors ``fp, doc, pos`` of the texts, ``shared`` the hashes ``fp`` that two or more of them have.
    """
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("greatest")).where(F.col("least") < F.col("greatest")).select(*keys)
    with Scratch(docs.sparkSession) as scratch:
        anchored = scratch.keep(places.join(shared, "fp", "left_semi").select("doc", "pos"), "anchored")
        near = scratch.keep(_with_places(docs, anchored, "pos"), "near")
        blocks = scratch.keep(cores(near, length, gram), "cores")
        kept = scratch.keep(blocks.join(twice(blocks, "core"), "core", "left_semi").select("doc", "at"), "kept")
        dense = scratch.keep(candidates(_with_places(near.drop("places"), kept, "at"), length, gram), "windows")
        starts = dense.join(twice(dense, "h1", "h2"), ["h1", "h2"], "left_semi").select("doc", "start")
        return scratch.hand_over(merge_spans(starts, length), "spans")


def merge_spans(starts: DataFrame, length: int) -> DataFrame:
    """Spans ``doc, start, end`` out of the begins ``doc, start`` of windows; overlapping and touching windows are merged."""
    order = Window.partitionBy("doc").orderBy("start")
    breaks = F.coalesce(F.col("start") - F.lag("start").over(order) > length, F.lit(True))
    numbered = starts.withColumn("breaks", breaks).withColumn("span", F.sum(F.col("breaks").cast("int")).over(order))
    return numbered.groupBy("doc", "span").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).drop("span")


def shared_spans(df: DataFrame, doc_id: str, text: str, length: int = 300, gram: int = 100, batches: int = 3) -> DataFrame:
    """``doc_id, span_start, span_end``: each text's stretches of ``length`` code points or more that another record holds.

    Positions are code points, the end exclusive; overlapping or touching stretches are merged. Repetition within one record
    is none, and rows with the same id are one record, whose spans are merged. Null and short texts and rows without an id
    have no spans. The texts go into the index in ``batches`` told apart by their hash, the runs being compacted between.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    keys = docs.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), F.length("text").alias("n"))
    index = FingerprintIndex(spark, length, gram)
    with Scratch(spark) as scratch:
        try:
            copies = keys.groupBy("t1", "t2", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last"))
            whole = scratch.keep(keys.join(copies, ["t1", "t2", "n"]).select("doc", "n", "first"), "copies")
            ones = docs.join(whole.where(F.col("doc") != F.col("first")).select("doc"), "doc", "left_anti")
            rows, met = scratch.keep(anchors(ones, length, gram), "anchors"), []
            for b in range(batches):
                index.compact()
                met.append(index.add_anchors(rows.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)))
            spans = verify(ones, index.anchors(), reduce(DataFrame.unionByName, met).distinct(), length, gram)
            partly = spans.join(whole.select("doc"), "doc", "left_anti").select(F.col("doc").alias(doc_id), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
            copied = whole.select(F.col("doc").alias(doc_id), F.lit(0).alias("span_start"), F.col("n").alias("span_end"))
            return scratch.hand_over(copied.unionByName(partly), "shared")
        finally:
            index.drop()


def shared_amounts(spans: DataFrame, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_chars, shared, share``: how many code points of each record stand in another one too; null texts have none."""
    sums = spans.groupBy(doc_id).agg(F.sum(F.col("span_end") - F.col("span_start")).cast("bigint").alias("shared"))
    sizes = df.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    joined = sizes.join(sums, doc_id, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return joined.withColumn("share", F.coalesce(F.try_divide("shared", "n_chars"), F.lit(0.0)))
