"""Term frequencies and target sampling against brute force, and their edge cases."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from spoolworks.llm import queries, quota_sample, terms

MISSING = {"", "nan", "none", "null", "[]", "{}"}


def clean(text):
    term = unicodedata.normalize("NFKC", text).strip().lower() if text is not None else ""
    return None if term in MISSING else term


def test_frequencies_against_brute_force(spark):
    rows = [
        ("a", ["Drama", " drama ", None, "ＤＲＡＭＡ"], "en", "clash"), ("a", ["Drama", "x" * 100_000], "EN", "clash"), ("b", [], "nan", None), ("c", None, None, None),
        (None, ["Drama", "only"], "fr", None), ("d", ["NULL", "[]", "ﬁlm"], " fr", None),
    ]
    df = spark.createDataFrame(rows, "record string, genres array<string>, lang string, term string")
    want_n, want_r = Counter(), defaultdict(set)
    for record, genres, lang, _ in rows:
        for field, values in (("genres", genres or []), ("lang", [lang])):
            for term in map(clean, values):
                if term:
                    want_n[field, term] += 1
                    want_r[field, term] |= {record} - {None}
    got = {(r.field_name, r.term): (r.occurrences, r.records) for r in terms.term_frequencies(df, "record", ["genres", "lang"]).collect()}
    assert got == {k: (n, len(want_r[k])) for k, n in want_n.items()}


def test_hot_term_and_marks(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS e", "CASE WHEN id % 3 = 0 THEN array('hot', CAST(id AS STRING)) ELSE array('warm') END AS g")
    total = df.selectExpr("count(DISTINCT e)")
    marked = {r.term: (r.records, r.marks) for r in terms.mark_terms(terms.term_frequencies(df, "e", ["g"]), total).collect()}
    assert marked["hot"] == (1000, ["common"]) and marked["3"] == (1, ["rare"]) and len(marked) == 1002


def test_no_terms(spark):
    df = spark.createDataFrame([], "e string, g array<string>")
    assert terms.term_frequencies(df, "e", ["g"]).isEmpty()


def sets_of(spark, rows):
    return quota_sample.read_targets(spark.createDataFrame(rows, "target_set string, dimension string, category string, share_permille int, min_rows int, sample_permille int"))


def test_samples_meet_what_can_be_met(spark):
    people = spark.range(10_000).selectExpr("CAST(id AS STRING) AS e", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 50 = 1 THEN 'c' ELSE 'b' END AS kind", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS side").cache()
    sets = sets_of(spark, [
        ("one", "kind", "a", 500, 10, 100), ("one", "kind", "c", 100, 90, 100), ("one", "kind", "zz", 10, 5, 100),
        ("two", "kind", "a", 700, 10, 200), ("two", "side", "x", 200, 10, 200), ("two", "side", "x", 200, 10, 200), ("gone", "kind", None, 1, 1, 1),
    ])
    plan = quota_sample.plan_samples(people, "e", sets)
    report = {(r[0], r[2]): r for r in plan.report}
    assert report["one", "a"][6] == 500 and report["one", "c"][6] == 100 and report["one", "zz"][7] == "supply"
    assert report["two", "a"][6] == 1400 and report["two", "x"][6] == 400
    drawn = quota_sample.draw(people, "e", sets, plan).join(people, "e").collect()
    by_set = Counter(r.target_set for r in drawn)
    assert by_set == {"one": 1000, "two": 2000} and len({(r.target_set, r.e) for r in drawn}) == 3000
    assert sum(r.kind == "a" and r.target_set == "one" for r in drawn) == 500 and sum(r.side == "x" and r.target_set == "two" for r in drawn) == 400


def some_counts(rng, categories=(3, 2, 4)):
    """A target set over some dimensions, its known counts, and the members of each target as a matrix."""
    names = [f"d{i}" for i in range(rng.integers(1, len(categories) + 1))]
    targets = [quota_sample.Target(d, f"c{c}", 0, 0) for d, n in zip(names, categories) for c in range(n) if rng.random() < 0.7] or [quota_sample.Target("d0", "c0", 0, 0)]
    one = quota_sample.TargetSet("s", 100, targets)
    signatures = sorted({"\u0001".join(rng.choice([t.category for t in targets if t.dimension == d] + [quota_sample.OTHER]) for d in one.dimensions) for _ in range(20)})
    known = quota_sample.Counts(one, signatures, rng.integers(0, 60, len(signatures)))
    parts = [dict(zip(one.dimensions, s.split("\u0001"))) for s in signatures]
    return known, np.array([[p[t.dimension] == t.category for p in parts] for t in targets])


def test_repair_never_breaks_floors_and_ends_where_no_exchange_improves():
    rng = np.random.default_rng(1)
    for _ in range(150):
        known, member = some_counts(rng)
        available, targets = known.available, len(member)
        supply = member.astype(int) @ available
        assert (known.held(available) == supply).all()
        floors, wanted = np.minimum(rng.integers(0, 5, targets), supply), rng.integers(0, 50, targets)
        size = int(rng.integers(0, available.sum() + 1))
        start = quota_sample.start_counts(known, floors, size, rng)
        counts, _ = quota_sample.repair(known, start, wanted, floors)
        assert start.sum() == counts.sum() == min(size, available.sum()) and (counts >= 0).all() and (counts <= available).all()
        before, after = member.astype(int) @ start, member.astype(int) @ counts
        assert np.abs(after - wanted).sum() <= np.abs(before - wanted).sum()
        assert (after >= np.minimum(floors, before)).all()
        for a in np.flatnonzero(counts > 0):  # brute force over single exchanges
            for b in np.flatnonzero(counts < available):
                then = after - member[:, a] + member[:, b]
                if a != b and (then >= np.minimum(floors, after)).all():
                    assert np.abs(then - wanted).sum() >= np.abs(after - wanted).sum()


def test_draws_of_any_size_are_whole_and_even():
    rng = np.random.default_rng(3)
    for free in ([5, 0, 7, 1], [10**15, 3, 10**16], [0, 0], []):
        free = np.array(free, np.int64)
        for n in (0, 1, 3, int(free.sum()), int(free.sum()) + 9, int(free.sum()) // 3):
            got = quota_sample.draw_counts(free, n, rng)
            assert got.sum() == min(n, free.sum()) and (got >= 0).all() and (got <= free).all()
    sums = sum(quota_sample.draw_counts(np.array([10, 20, 70]), 10, rng) for _ in range(2000)) / 2000
    assert np.abs(sums - [1, 2, 7]).max() < 0.1


def test_unmet_targets_are_found_by_the_repair(monkeypatch):
    one = quota_sample.TargetSet("s", 100, [quota_sample.Target("d", "few", 500, 0), quota_sample.Target("d", "many", 600, 0)])
    known, rng = quota_sample.Counts(one, ["few", "many", quota_sample.OTHER], [30, 900, 70]), np.random.default_rng(2)
    assert quota_sample.reachable(known, 0, 50, 100, rng) == 30 and quota_sample.reachable(known, 1, 60, 100, rng) >= 60
    assert quota_sample.reachable(known, 0, 20, 10, rng) >= 20  # a sample as large as what is wanted
    monkeypatch.setattr(quota_sample, "repair", lambda known, counts, *_: (counts, 0))
    assert quota_sample.reachable(known, 0, 20, 100, rng) < 20  # a random sample alone would report what can be met


def test_empty_population(spark):
    people = spark.createDataFrame([], "e string, kind string")
    sets = sets_of(spark, [("one", "kind", "a", 500, 3, 100)])
    plan = quota_sample.plan_samples(people, "e", sets)
    assert [(r[5], r[6], r[7]) for r in plan.report] == [(0, 0, "supply")]
    assert quota_sample.draw(people, "e", sets, plan).isEmpty()


@pytest.mark.parametrize("name", ["p3_found", "p5_found"])
def test_queries_have_the_stated_columns(spark, name):
    columns = {"p3_found": ["target_set", "category"], "p5_found": ["field_name", "term", "mark"]}
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == columns[name] and df.count() == df.distinct().count()
