"""Evaluation passages inside a corpus: containment search with size-partitioned MinHash sketches, verified exactly.

Passages and documents are compared as words without case, accents, punctuation and marks, by shingles of three words.

1. *Sketches.* Test items are partitioned by size. Of a passage in a size class, a true case leaves at least so many shingles
   whole (:meth:`Case.whole_shingles` of the class's least size). A sketch is a bottom-k MinHash sample that leaves out the
   shingles of greatest rank, a third as many as must stay whole; so by the pigeonhole principle every true case still shares
   the other two thirds with the sketch, whatever the size, and no case is lost to chance. Ranks are exponential with the number
   of items that hold a shingle (weighted MinHash), so the shingles common to many items are the first to be left out.
2. *Search.* Documents are read once, whole. A Bloom filter of the sketches, whose size is bounded, drops most of their
   shingles where they are read; the rest is joined with the sketches by hash. Documents' hits are salted, so that a shingle
   that a third of all documents hold is spread over many tasks, and counted by document and item before anything else.
3. *Verification.* Each document meets its candidates in groups of bounded number: first the exact count of shingles that it
   contains, then the words of the stretches themselves.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spoolworks.session import Scratch, Sent

#: Shingles have so many words; of those that stay whole in any case, a sketch may leave out one in so many.
SHINGLE, SPARED = 3, 3
#: Words whose hash a worker remembers.
REMEMBERED = 500_000
#: The filter has so many bits a sketched shingle, as a power of two within these bounds (16 MB at most), and so many probes.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 12, 1 << 27, 4
#: Salts of the join by shingle, and candidates that a document is verified against at once.
SALTS, AT_ONCE = 8, 64
#: Words of documents that are looked up at once, but for longer documents.
SLICE = 1_000_000

_ASCII_WORDS = re.compile(r"[a-z0-9]+")
_WORDS = re.compile(r"[^\W_]+")
_DROPPED = regex.compile(r"[\p{M}\p{Cf}'’‘ʼ`´]+")
# a tag: a name and attributes with values, of any length; angle brackets around other words are punctuation
_MARKS = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*\s*/?>|\[\d+\]""")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case without accents; null has no words.

    Tags and numbered reference marks are no words, character references stand for their character, and apostrophes inside
    words are dropped.
    """
    if not text:
        return []
    if "<" in text or "[" in text:
        text = _MARKS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower().replace("'", "").replace("`", ""))
    plain = _DROPPED.sub("", unicodedata.normalize("NFKD", text)).casefold()
    return _WORDS.findall(unicodedata.normalize("NFKC", plain))


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.known, words_of(text)
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (words[i : i + n] * _FACTORS[i % 4])) * _FACTORS[(i + 1) % 4]
        mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass(frozen=True)
class Case:
    """What counts as a leak: at least ``share`` of a passage's words, in stretches of at least ``stretch`` consecutive
    words in the passage's order, in which up to one word in ``per`` may be replaced."""

    share: float = 0.5
    stretch: int = 8
    per: int = 8

    def needed(self, words: int) -> int:
        """The words that must be covered."""
        return int(np.ceil(self.share * words))

    def kept(self, length: int) -> int:
        """How many shingles a stretch of that length leaves whole at least: a replaced word breaks SHINGLE of them."""
        return max(0, length - SHINGLE + 1 - SHINGLE * (length // self.per))

    def whole_shingles(self, words: int) -> int:
        """How many shingles (repeated ones counted each) a true case of a passage of so many words leaves whole at least."""
        return max(1, _least_kept(self, self.needed(words)))

    def size_class(self, words: int) -> tuple[int, int, int]:
        """(class, shingles that its sketches leave out, shingles of a sketch that a true case shares at least)."""
        number = int(2 * np.log2(max(words, 1)))
        whole = self.whole_shingles(int(np.ceil(2 ** (number / 2) - 1e-9)))
        spared = whole // SPARED
        return number, spared, whole - spared

    def covered(self, equal: np.ndarray) -> np.ndarray:
        """Which places of the passage lie in a stretch, given where passage and document agree on one alignment."""
        n = len(equal)
        inside = np.zeros(n, bool)
        balance = self.per * np.concatenate([[0], np.cumsum(~equal)]) - np.arange(n + 1)  # a stretch ends no higher than it begins
        lowest = np.minimum.accumulate(balance[::-1])[::-1]
        begins = np.flatnonzero(equal)
        ends = np.searchsorted(lowest, balance[begins], "right") - 1
        last = np.concatenate([[0], np.maximum.accumulate(np.where(equal, np.arange(1, n + 1), 0))])
        ends = last[ends]
        for b, e in zip(begins, ends):
            if e - b >= self.stretch:
                inside[b:e] = True
        return inside


@cache
def _least_kept(case: Case, covered: int) -> int:
    """The fewest whole shingles of stretches that cover so many words."""
    lengths = [(n, case.kept(n)) for n in range(case.stretch, 3 * case.stretch)]
    best = [0] * (covered + 1)
    for c in range(1, covered + 1):
        best[c] = min(kept + best[max(0, c - n)] for n, kept in lengths)
    return best[covered]


def in_order(stretches: list[tuple[int, int, int]]) -> int:
    """The most words of a passage that stretches ``(begin, end, begin in the document)`` cover in the passage's order."""
    if not stretches:
        return 0
    rows = np.array(sorted(set(stretches), key=lambda s: (s[2], s[0], s[1])), np.int64)
    begin, end, best = rows[:, 0], rows[:, 1], np.zeros(len(rows), np.int64)
    for i in range(len(rows)):
        gain = end[i] - np.maximum(begin[i], end[:i])
        earlier = (begin[:i] <= begin[i]) & (gain > 0)
        best[i] = max(end[i] - begin[i], (best[:i] + gain)[earlier].max(initial=0))
    return int(best.max())


class Document:
    """A document's words and sorted shingles, to be compared with passages."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.shingles = words, shingles(words)
        self.order = np.argsort(self.shingles, kind="stable")
        self.sorted = self.shingles[self.order]

    def leak(self, words: np.ndarray, case: Case) -> tuple[int, float] | None:
        """(words covered, containment of the shingles) of a passage that the document carries, else None."""
        every, n = shingles(words), len(words)
        first, last = np.searchsorted(self.sorted, every, "left"), np.searchsorted(self.sorted, every, "right")
        present = last > first
        if present.sum() < case.whole_shingles(n):
            return None
        shifts = np.zeros(len(self.words) + n, np.int32)  # shingles in place, by alignment
        for place in np.flatnonzero(present):
            shifts[self.order[first[place] : last[place]] - place + n] += 1
        stretches: list[tuple[int, int, int]] = []
        for shift in np.flatnonzero(shifts >= max(1, case.kept(case.stretch))) - n:
            begin, end = max(0, -shift), min(n, len(self.words) - shift)
            equal = np.zeros(n, bool)
            equal[begin:end] = words[begin:end] == self.words[begin + shift : end + shift]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], case.covered(equal), [False]])))
            stretches += [(int(b), int(e), int(b + shift)) for b, e in zip(edges[::2], edges[1::2])]
            if stretches and stretches[-1][:2] == (0, n):
                break
        covered = in_order(stretches)
        return (covered, float(present.mean())) if covered >= case.needed(n) else None


def sketch_items(items: DataFrame, item_id: str, passage: str, case: Case, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The passages ``item, item_id, words`` and their sketches ``item, size_class, hash, weight, need``.

    ``weight`` is how often the shingle stands in the passage; ``need`` the weight that a true case shares at least.
    """
    kind = items.schema[item_id].dataType
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", kind), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("size_class", T.IntegerType()),
        T.StructField("spared", T.IntegerType()), T.StructField("need", T.IntegerType()),
        T.StructField("every", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("weight", T.IntegerType())]))),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            for item, identity, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = hashes(text)
                if len(words) < case.stretch:
                    continue
                values, counts = np.unique(shingles(words), return_counts=True)
                every = [{"hash": h, "weight": c} for h, c in zip(values.view(np.int64).tolist(), counts.tolist())]
                for column, value in zip(rows, (item, identity, words.view(np.int64), *case.size_class(len(words)), every)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    numbered = items.where(F.col(passage).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(passage).cast("string").alias("passage"))
    shredded = scratch.keep(numbered.mapInArrow(run, schema), "items")
    single = shredded.select("item", "size_class", "spared", "need", F.inline("every"))
    holders = single.groupBy("hash").agg(F.count(F.lit(1)).alias("holders"))
    rank = -F.ln(F.greatest(F.col("hash") / F.lit(2.0**64) + 0.5, F.lit(1e-19))) * F.col("holders")
    last_first = Window.partitionBy("item").orderBy(F.desc("rank"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    ranked = single.join(holders, "hash").withColumn("rank", rank).withColumn("upto", F.sum("weight").over(last_first))
    sketches = ranked.where(F.col("upto") > F.col("spared")).select("item", "size_class", "hash", "weight", "need")
    return shredded.select("item", "item_id", "words"), scratch.keep(sketches, "sketches")


class Bloom:
    """A Bloom filter of 64-bit hashes: a table of 64-bit words, whose number is a power of two."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @staticmethod
    def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
        """The bits of each hash, a row for each probe."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in the filter."""
        inside = np.ones(len(hashes), bool)
        for at in self.probes(hashes, 64 * len(self.table)):
            inside &= (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return inside


def bloom_of(hashes: DataFrame, count: int) -> Bloom:
    """The filter of a column ``hash`` of about ``count`` distinct values. At most MOST_BITS reach the driver, as 64-bit words."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 2 ** int(np.ceil(np.log2(max(1, BITS_EACH * count)))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Bloom.probes(batch.column(0).to_numpy().view(np.uint64), bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = hashes.select("hash").mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return Bloom(table)


def hits(texts: DataFrame, bloom: Bloom, least: int) -> DataFrame:
    """``row, doc_id, text, hits`` of the texts that hold at least ``least`` different shingles of the filter."""
    schema = T.StructType([*texts.select("row", "doc_id", "text").schema.fields, T.StructField("hits", T.ArrayType(T.LongType()))])
    arrow, sent = to_arrow_schema(schema), Sent(texts.sparkSession, bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filter_ = WordHashes(), sent.get()
        for batch in batches:
            for begin, words in _slices(batch.column(2), hashes):
                rows, found = [], []
                for row, one in _shingles_met(words, filter_):
                    if len(one) >= least:
                        rows.append(begin + row)
                        found.append(one.view(np.int64))
                if rows:
                    kept = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, arrow.field("hits").type)], schema=arrow)

    return texts.select("row", "doc_id", "text").mapInArrow(run, schema)


def _slices(texts: pa.Array, hashes: WordHashes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, words of the texts) of slices of about SLICE words, of one text at least."""
    first, words, size = 0, [], 0
    for row, body in enumerate(texts):
        words.append(hashes(body.as_py()))
        size += len(words[-1])
        if size >= SLICE:
            yield first, words
            first, words, size = row + 1, [], 0
    if words:
        yield first, words


def _shingles_met(words: list[np.ndarray], bloom: Bloom) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its different shingles that the filter holds) of the texts that have any."""
    ends = np.cumsum([len(w) for w in words])
    every = shingles(np.concatenate(words))
    inside = np.flatnonzero(bloom.holds(every))
    owner = np.searchsorted(ends, inside, "right")
    within = inside + SHINGLE <= ends[owner]  # shingles that reach into the next text are none
    inside, owner = inside[within], owner[within]
    numbers, begins = np.unique(owner, return_index=True)
    for number, begin, end in zip(numbers, begins, [*begins[1:], len(owner)]):
        yield int(number), np.unique(every[inside[begin:end]])


def verify(groups: DataFrame, case: Case) -> DataFrame:
    """``item_id, doc_id, covered, words, containment`` of rows ``doc_id, text, items`` (a list of ``item_id, words``)."""
    fields = {f.name: f.dataType for f in groups.schema.fields}
    schema = T.StructType([
        T.StructField("item_id", fields["items"].elementType["item_id"].dataType), T.StructField("doc_id", fields["doc_id"]),
        T.StructField("covered", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("containment", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for identity, text, items in zip(*(batch.column(i) for i in range(3))):
                document = Document(hashes(text.as_py()))
                for item in items:
                    words = item["words"].values.to_numpy().view(np.uint64)
                    found = document.leak(words, case)
                    if found:
                        out.append((item["item_id"].as_py(), identity.as_py(), found[0], len(words), found[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return groups.select("doc_id", "text", "items").mapInArrow(run, schema)


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, case: Case = Case()) -> DataFrame:
    """``item_id, doc_id, covered, words, containment`` for every item that a document carries, one row each.

    Null and empty texts carry nothing, and passages shorter than a stretch are never found. Rows that repeat a document's or
    an item's id are each compared, and the one that covers most counts. Other columns are not read.
    """
    with Scratch(documents.sparkSession) as scratch:
        passages, sketches = sketch_items(items, item_id, passage, case, scratch)
        size = sketches.agg(F.count_distinct("hash").alias("hashes"), F.min(F.ceil(F.col("need") / F.col("weight"))).alias("least")).first()
        texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
        near = scratch.keep(hits(texts, bloom_of(sketches, size.hashes), size.least or 1), "near")
        salted = sketches.select("item", "hash", "weight", "need", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        met = near.select("row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.explode("hits").alias("hash")).join(salted, ["hash", "salt"])
        shared = met.groupBy("row", "item").agg(F.sum("weight").alias("shared"), F.first("need").alias("need")).where(F.col("shared") >= F.col("need"))
        part = F.floor((F.row_number().over(Window.partitionBy("row").orderBy("item")) - 1) / AT_ONCE)
        groups = shared.select("row", "item", part.alias("part")).join(passages, "item").groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
        found = verify(scratch.keep(groups, "groups").join(near.select("row", "doc_id", "text"), "row"), case)
        best = found.groupBy("item_id", "doc_id").agg(F.max(F.struct("covered", "words", "containment")).alias("of"))
        return scratch.hand_over(best.select(F.col("item_id").alias(item_id), F.col("doc_id").alias(doc_id), "of.*"), "leaks")
