"""Leak search against cases made by hand and by rule."""

from __future__ import annotations

import random

import numpy as np

from spoolworks.llm import leak, queries

WORDS = [a + b + c for a in ("ka", "to", "mi", "re", "su") for b in ("lo", "ne", "bi", "du") for c in ("n", "r", "x", "sh")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def search(spark, docs, items, **case):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, covered string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, words string")
    return {(r.item_id, r.doc_id) for r in leak.find_leaks(d, "doc_id", "text", i, "item_id", "passage", leak.Case(**case)).collect()}


def test_words():
    assert leak.words_of("L’Été <b>naïve</b> [12] don&#39;t—stop​! ＡＢＣ") == ["lete", "naive", "dont", "stop", "abc"]
    assert leak.words_of(None) == leak.words_of("") == leak.words_of(" …") == []
    assert leak.words_of(f'a <p class="{"x" * 900}" id=1> b <br/> [1234] c') == ["a", "b", "c"]
    assert leak.words_of("if a <b and c> d, 1 < 2 > 0") == ["if", "a", "b", "and", "c", "d", "1", "2", "0"]


def test_cases_and_decoys(spark):
    rng = random.Random(3)
    p = passage(rng, 32)
    filler = lambda n: " ".join(passage(rng, n))
    text = " ".join
    replaced = [w if i % 8 != 3 else "zzz" for i, w in enumerate(p)]
    docs = {
        1: text(p), 2: filler(300) + " " + text(p).upper() + " " + filler(2000), 3: filler(9) + " " + text(p[:16]) + " " + filler(5), 4: text(p[:8]) + " q " + text(p[20:28]),
        5: text(replaced), 6: " <i>" .join(p), 7: "\n* ".join(p[4:24]),
        11: text(p[:12]) + " " + filler(50), 12: text(sorted(p)), 13: filler(500), 14: text(p[:7]) + " x " + text(p[8:15]) + " y y y " + text(p[20:27]), 15: "", 16: None, 17: "?",
        18: text(p[20:32]) + " " + filler(9) + " " + text(p[:12]),
    }
    rows = [(k, v, "clash") for k, v in docs.items()] + [(1, docs[1], "clash"), (None, docs[1], None)]
    got = search(spark, rows, [(5, text(p), None), (6, "too short", None), (7, None, None), (8, "", None)])
    # of 14, the gap of one word joins two runs of seven to a stretch of 15 words, one less than half
    assert got == {(5, d) for d in (1, 2, 3, 4, 5, 6, 7, None)}


def simulated(rng, n, case):
    """A passage and the least text that is a true case of it."""
    p = np.array([rng.getrandbits(60) for _ in range(n)], np.uint64)
    doc, at, covered = [], 0, 0
    while covered < case.needed(n) and at + 8 <= n:
        size = min(rng.choice((8, 8, 8, 9, 12, 16, 20)), n - at)
        stretch = p[at : at + size].copy()
        for place in rng.sample(range(1, size - 1), size // 8):
            stretch[place] = rng.getrandbits(40)
        doc += [*stretch, *[rng.getrandbits(41) for _ in range(3)]]
        covered, at = covered + size, at + size
    return p, np.array(doc, np.uint64), covered >= case.needed(n)


def test_least_whole_shingles_is_a_lower_bound_that_sketches_respect():
    rng, case = random.Random(9), leak.Case()
    for n in (8, 15, 23, 30, 36, 43, 80, 500):
        _, spared, need = case.size_class(n)
        assert need >= 1 and spared + need <= case.whole_shingles(n)
        for _ in range(100):
            p, doc, is_case = simulated(rng, n, case)
            if is_case:
                assert np.isin(leak.shingles(p), leak.shingles(doc)).sum() >= case.whole_shingles(n)
                assert leak.Document(doc).leak(p, case)


def every_alignment(document, words, case):
    """The rule itself, without shingles: all alignments of the passage, the stretches in order."""
    stretches, n = [], len(words)
    for shift in range(-n + 1, len(document)):
        equal = np.array([0 <= i + shift < len(document) and words[i] == document[i + shift] for i in range(n)], bool)
        if equal.sum() >= 7:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], case.covered(equal), [False]])))
            stretches += [(b, e, b + shift) for b, e in zip(edges[::2], edges[1::2])]
    return leak.in_order(stretches) >= case.needed(n)


def test_verification_against_every_alignment():
    rng, case = random.Random(12), leak.Case()
    for _ in range(150):
        p = np.array([rng.randrange(12) for _ in range(rng.randint(8, 30))], np.uint64)
        cut = rng.randrange(len(p))
        doc = np.array([*[rng.randrange(12) for _ in range(9)], *p[:cut], *[rng.randrange(12) for _ in range(rng.randint(0, 5))], *p[rng.randrange(len(p)) :]], np.uint64)
        assert bool(leak.Document(doc).leak(p, case)) == every_alignment(doc, p, case)


def test_sketches_leave_shingles_out_and_common_ones_first(spark):
    rng = random.Random(8)
    common = passage(rng, 9)
    items = [(i, " ".join(passage(rng, 30) + common), None) for i in range(40)]
    df = spark.createDataFrame(items, "item_id bigint, passage string, words string")
    with leak.Scratch(spark) as scratch:
        _, sketches = leak.sketch_items(df, "item_id", "passage", leak.Case(), scratch)
        rows = sketches.collect()
    words = np.array([leak.xxhash.xxh3_64_intdigest(w) for w in common], np.uint64)
    shared = set(leak.shingles(words).view(np.int64).tolist())
    assert {r.item for r in rows} and len(rows) / 40 <= 37 - leak.Case().size_class(39)[1]
    assert sum(r.hash in shared for r in rows) < 0.75 * 7 * 40


def test_items_of_any_size_and_a_hot_shingle(spark):
    rng = random.Random(4)
    long = [f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(6000)]
    hot = "one of the many "
    items = [(1, " ".join(long), None), (2, " ".join(long[:1000]), None)] + [(10 + i, hot + " ".join(passage(rng, 25)), None) for i in range(150)]
    docs = [(1, " ".join(long[1000:4500]), None), (2, " ".join(long[:2000]), None)] + [(100 + i, hot * 40 + text, None) for i, (_, text, _) in enumerate(items[2:])]
    got = search(spark, docs, items)
    assert {(1, 1), (2, 2)} | {(10 + i, 100 + i) for i in range(150)} <= got and not {(1, 2), (2, 1)} & got
    assert all(d - i == 90 for i, d in got if i >= 10)


def test_candidates_beyond_a_group_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leak, "AT_ONCE", 5)
    monkeypatch.setattr(leak, "SLICE", 40)
    rng = random.Random(6)
    items = [passage(rng, 25) for _ in range(12)]
    docs = [(i, " ".join(p), None) for i, p in enumerate(items)] + [(50, " ".join(sum(items, [])), None), (51, "a " * 3000, None)]
    assert search(spark, docs, [(i, " ".join(p), None) for i, p in enumerate(items)]) == {(i, i) for i in range(12)} | {(i, 50) for i in range(12)}
    assert search(spark, [], [(1, "a b", None)]) == search(spark, docs, []) == set()
    assert search(spark, docs, [(7, "a " * 200, None)]) == {(7, 51)}


def test_query_agrees_with_every_pair_of_the_data(spark):
    folder, case, hashes = "/root/testdata/sf0.001", leak.Case(), leak.WordHashes()
    items = [(r.item_id, hashes(r.passage)) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        document = hashes(r.text)
        grams = {document[i : i + 2].tobytes() for i in range(len(document) - 1)}
        for item, words in items:  # a stretch of eight words of which one is replaced has five pairs of words whole
            if sum(words[i : i + 2].tobytes() in grams for i in range(len(words) - 1)) >= 5 and every_alignment(document, words, case):
                want.add((item, r.doc_id))
    got = [tuple(r) for r in queries.p7_found(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)
