"""Byte-pair encoding of whole corpora, by forced-boundary splitting.

A pair of bytes that stands next to each other inside no token of the vocabulary can never be merged over, so the text may
be cut there. Where the cut also leaves the vocabulary's pre-tokenisation pattern unmoved, both sides are encoded
independently and the ids concatenated. The fragments are about as long as words and recur, so each distinct one of a batch
is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spoolworks.session import Sent

#: Texts are encoded in slices of about so many bytes; only fragments up to FRAGMENT bytes are remembered, KEPT at most.
SLICE, FRAGMENT, KEPT = 4_000_000, 64, 200_000
#: A vocabulary file larger than this is refused, as it is sent to every executor.
MOST_VOCABULARY_BYTES = 64_000_000

#: Last bytes of the UTF-8 forms of white space beyond ASCII; a cut after one of them is not taken.
SPACE_ENDS = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)
ASCII_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20)
APOSTROPHE = 0x27


class Vocabulary:
    """A byte-level BPE vocabulary in tiktoken's rank format, with its pre-tokenisation pattern.

    The cuts are proven for patterns that match runs of letters, of digits or of other characters, each with one leading
    blank at most, runs of white space, and contractions that begin with an apostrophe.
    """

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.raw, self.pattern = ranks, pattern

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["raw"], state["pattern"])

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        """Token bytes and their ids."""
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.raw.splitlines() if line.strip())}

    @cached_property
    def cuts(self) -> np.ndarray:
        """For each pair of bytes (first * 256 + second), whether the text is certainly cut between them.

        The pair is inside no token; the second byte begins a character that is no apostrophe (it might begin a
        contraction); the first ends a character that is no white space (a run of it looks ahead to what follows).
        """
        inside = np.zeros(65536, dtype=bool)
        joined = np.frombuffer(b"".join(self.ranks), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(token) for token in self.ranks])
        within = np.ones(max(len(joined) - 1, 0), dtype=bool)
        within[ends[:-1] - 1] = False
        inside[(joined[:-1] * 256 + joined[1:])[within]] = True
        first, second = np.arange(65536) // 256, np.arange(65536) % 256
        begins = ((second < 0x80) | (second >= 0xC0)) & (second != APOSTROPHE)
        spaces = np.isin(first, ASCII_SPACES) | np.isin(first, SPACE_ENDS)
        return ~inside & begins & ~spaces & (first < 0xC0)

    @cached_property
    def plain(self):
        """The encoder of single fragments."""
        import tiktoken

        return tiktoken.Encoding("fragments", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


class Encoder:
    """Encodes Arrow arrays of texts; keeps the ids of short fragments between calls."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[bytes, list[int]] = {}

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Offsets of the fragments of texts that lie one after the other in ``data`` and end at ``ends``."""
        pairs = data[:-1].astype(np.int64) * 256 + data[1:]
        return np.unique(np.concatenate([[0], np.flatnonzero(self.vocabulary.cuts[pairs]) + 1, ends]))

    def _ids(self, fragment: bytes) -> list[int]:
        ids = self.known.get(fragment)
        if ids is None:
            ids = self.vocabulary.plain.encode_ordinary(fragment.decode())
            if len(fragment) <= FRAGMENT:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[fragment] = ids
        return ids

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null and empty texts give an empty list."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        flat, sizes, begin = [np.empty(0, np.int32)], [], 0
        while begin < len(texts):  # slices of bounded bytes, of one text at least
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), SLICE, "right")))
            part, ends = texts.slice(begin, end - begin), np.cumsum(lengths[begin:end])
            begin = end
            data = np.frombuffer(b"".join(part.to_pylist()), dtype=np.uint8)
            if not len(data):
                sizes.append(np.zeros(len(part), np.int64))
                continue
            offsets = self.fragments(data, ends)
            coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            ids = [self._ids(f) for f in coded.dictionary.to_pylist()]
            counts = np.array([len(x) for x in ids], np.int64)
            store, starts = np.fromiter((i for x in ids for i in x), np.int32, counts.sum()), np.cumsum(counts) - counts
            codes = coded.indices.to_numpy()
            each = counts[codes]
            upto = np.cumsum(each)
            flat.append(store[np.arange(upto[-1]) - np.repeat(upto - each - starts[codes], each)])
            at = np.concatenate([[0], upto])[np.searchsorted(offsets, ends)]
            sizes.append(np.diff(at, prepend=0))
        offsets = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, output: str = "ids") -> DataFrame:
    """``key`` and the list of token ids of each text, without special tokens and from the text as stored.

    Null and empty texts both give an empty list. The rows are encoded where they are read; nothing is shuffled.
    """
    if len(vocabulary.raw) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to every executor")
    sent = Sent(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(output, T.ArrayType(T.IntegerType(), False))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.get())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder(batch.column(1)).cast(arrow.field(1).type)], schema=arrow)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
