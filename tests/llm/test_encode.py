"""Encoding against two plain encoders of the same vocabulary."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoolworks.llm import encode, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = queries.byte_bpe_50k()
TEXTS = [
    "", None, " ", "\n\n\n", "don't we'll O'Neil 's 'S", "a  b   c\t\td", "<|endoftext|> is text", "日本語のテキスト、です。", "é é ﬁ", "x" * 50_000, "🎬👩‍👩‍👧 ok", "a  b　c  d", "!!!'s?'ll",
    "qzxjq" * 2000, "1234567890" * 50, "line\r\nline\n\n  indented", "\u0000\u0001", "a'b'c'd'e", "zqj 'zqj' \"zqj\"",
]


def plain(text):
    return VOCABULARY.plain.encode_ordinary(text) if text else []


def test_agrees_with_plain_encoding():
    assert encode.Encoder(VOCABULARY)(pa.array(TEXTS, pa.string())).to_pylist() == [plain(t) for t in TEXTS]


def test_agrees_with_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [t for t in TEXTS if t]
    assert encode.Encoder(VOCABULARY)(pa.array(texts)).to_pylist() == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    assert encode.Encoder(VOCABULARY)(pa.array(texts, pa.string())).to_pylist() == [plain(t) for t in texts]


def test_random_mixtures_of_awkward_pieces():
    rng = random.Random(5)
    pieces = ["'s", "'", " ", "  ", "\n", "qz", "ll", "don", "é", "日", "12", "!", " ", "　", "\u0085", " ", "zx", "'ll", "_", "jq", "Ж", "ʼ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(5000)]
    assert encode.Encoder(VOCABULARY)(pa.array(texts)).to_pylist() == [plain(t) for t in texts]


def test_slices_and_forgetting(monkeypatch):
    monkeypatch.setattr(encode, "SLICE", 50)
    monkeypatch.setattr(encode, "KEPT", 3)
    assert encode.Encoder(VOCABULARY)(pa.array(TEXTS, pa.string())).to_pylist() == [plain(t) for t in TEXTS]


def test_table(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS) if t != "\u0000\u0001"], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df, "doc_id", "text", VOCABULARY).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS) if t != "\u0000\u0001"}
    assert encode.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        encode.encode_texts(df, "doc_id", "text", encode.Vocabulary(b"x" * (encode.MOST_VOCABULARY_BYTES + 1), ""))
