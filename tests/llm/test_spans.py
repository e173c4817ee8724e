"""Shared spans against brute force over all windows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from spoolworks.llm import queries, spans


def brute(docs, length):
    holders = defaultdict(set)
    for doc, text in docs:
        for i in range(len(text or "") - length + 1):
            holders[text[i : i + length]].add(doc)
    out = set()
    for doc in {d for d, _ in docs}:
        starts = sorted({i for d, text in docs if d == doc for i in range(len(text or "") - length + 1) if len(holders[text[i : i + length]]) > 1})
        for i in starts:
            if out and (last := max((s for s in out if s[0] == doc), default=None, key=lambda s: s[2])) and i <= last[2]:
                out.remove(last)
                out.add((doc, last[1], i + length))
            else:
                out.add((doc, i, i + length))
    return out


def found(spark, docs, length, gram, **more):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id bigint, text string, start string, doc int")
    return {tuple(r) for r in spans.shared_spans(df, "doc_id", "text", length, gram, **more).collect()}


def texts(seed, n=60, alphabet="abcdefgh日é🎬"):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices(alphabet, k=k))
    pool = [make(rng.randint(20, 90)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [make(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(pool)
            a = rng.randint(0, max(0, len(piece) - 20))
            parts += [piece[a : a + rng.randint(15, 70)], make(rng.randint(0, 20))]
        docs.append((i, "".join(parts)))
    return docs + [(100 + i, docs[i][1]) for i in range(0, n, 7)] + [(200, None), (201, ""), (202, "aaaa" * 30), (203, "b" + "a" * 60), (204, "short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = texts(seed)
    assert found(spark, docs, 30, 10) == brute(docs, 30)


def test_repetition_in_one_record_is_none(spark):
    block = "".join(random.Random(1).choices("abcdefghij", k=50))
    assert found(spark, [(1, block + "x" + block)], 30, 10) == set()
    assert found(spark, [(1, block), (1, block)], 30, 10) == set()


def test_batches_and_compaction_make_no_difference(spark):
    docs = texts(3, 30)
    assert found(spark, docs, 30, 12, batches=1) == found(spark, docs, 30, 12, batches=4) == brute(docs, 30)


def test_empty_table(spark):
    assert found(spark, [], 30, 10) == set()


def test_index_reports_each_batch(spark):
    index = spans.FingerprintIndex(spark, 30, 10, fan_in=2, buckets=4)
    block = "".join(random.Random(2).choices("abcdefghij", k=60))
    docs = spark.createDataFrame([(1, block)], "doc bigint, text string"), spark.createDataFrame([(2, "zz" + block)], "doc bigint, text string")
    assert index.add(docs[0]).isEmpty()
    assert not index.add(docs[1]).isEmpty()
    index.compact()
    assert len(index.runs) == 1
    index.drop()
    with pytest.raises(ValueError):
        spans.FingerprintIndex(spark, 10, 30)


def test_index_survives_the_call_and_a_failed_change(spark, monkeypatch):
    docs = [d for d in texts(5, 40) if d[1]]
    frame = lambda rows: spark.createDataFrame(rows, "doc bigint, text string")
    index = spans.FingerprintIndex(spark, 30, 10, fan_in=2, buckets=4)
    folder, known, want = index.folder, [], brute(docs, 30)
    for begin in range(0, len(docs), 15):
        batch = docs[begin : begin + 15]
        for name in index.runs:  # as in another session, whose catalogue knows nothing of the runs
            spark.sql(f"DROP TABLE {name}")
        if begin:
            index = spans.FingerprintIndex.open(spark, folder)
            assert len(index.places) == begin // 15
        got = {tuple(r) for r in index.new_spans(frame(batch), frame(known)).collect()}
        known += batch
        ids = {d for d, _ in batch}
        assert got == {s for s in brute(known, 30) if s[0] in ids}
    monkeypatch.setattr(spans, "materialise", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(frame([(900, docs[0][1])]))
    assert spans.FingerprintIndex.open(spark, folder).places == index.places and want
    index.drop()
    with pytest.raises(FileNotFoundError):
        spans.FingerprintIndex.open(spark, folder)


def test_amounts(spark):
    found_ = spark.createDataFrame([(1, 0, 30), (1, 40, 80)], "doc_id bigint, span_start int, span_end int")
    df = spark.createDataFrame([(1, "x" * 100), (2, None), (3, ""), (3, "abc"), (None, "y")], "doc_id bigint, text string")
    assert sorted(map(tuple, spans.shared_amounts(found_, df, "doc_id", "text").collect())) == [(1, 100, 70, 0.7), (2, 0, 0, 0.0), (3, 3, 0, 0.0)]


def test_equal_windows_have_equal_hashes():
    rng = np.random.default_rng(0)
    text = "".join(chr(int(c)) for c in rng.integers(97, 105, 500))
    t = spans.Texts(["xyz" + text, text])
    assert t.hashes(50, np.array([3])) == t.hashes(50, np.array([503])) and t.hashes(50, np.array([2])) != t.hashes(50, np.array([503]))


def test_query_agrees_with_brute_force_on_the_data(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.p8_found(spark, folder).collect()} == brute(docs, 300)
