"""Titles, soft-logic inference and linkage."""

from __future__ import annotations

import random

import pytest

from spoolworks.llm import link, titles

STAGED = "source_id bigint, title string, original_title string, alternative_titles array<string>, release_year int, media_type string, value string"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Tezagi Kete Nisowapa", "てざぎけてニソワパ"), ("Sedozako to Nezugu Furaku Part 4", "セドザコとねずぐふらく パート4"), ("The Echo of Shikekyaro", "Shikekyaro's Echo"),
        ("Echo of Shikekyaro, The", "ＥＣＨＯ  ＯＦ ＳＨＩＫＥＫＹＡＲＯ"), ("Misshitakya no Higi", "ミッシタキャ・のひぎ"), ("Biyape Gesa Shôruyaso", "びやぺげさショルヤソ"),
        ("Fusazeso: Kuhe Yoku 2", "『フサゼソ くへよく 第2部』"), ("X no Hipo 2nd Seson", "X no Hipo II"), ("Gekijouban Rapa no Higi", "Rapa no Higi the Movie"), ("Some Vineyard (TV)", "some vineyard"),
    ],
)
def test_forms_of_one_title(a, b):
    x, y = titles.parse(a), titles.parse(b)
    assert (x.flat == y.flat or x.bag == y.bag) and x.number == y.number and x.movie == y.movie


@pytest.mark.parametrize("text", [None, "", "  ", "...", "the"])
def test_titles_that_name_nothing(text):
    assert titles.parse(text) is None


def test_short_forms_count_where_nothing_longer_is_known():
    flats = lambda *texts: {(x.flat, x.number) for x in titles.parse_all(texts)}
    assert flats("Hunter X") == {("hunter", 10)} and flats("Agent Z", None) == {("agentz", None)} and flats("Mr X") == {("mr", 10)}
    assert flats("Kasub V", "Kasubari Vema") == {("kasubarivema", None)}  # short for the other title
    assert flats("Hunter X", "Another Name") == {("hunter", 10), ("anothername", None)} and flats("Hunter X", "Hunter X") == {("hunter", 10)}


def linked(spark, left, right):
    a, b = (spark.createDataFrame([(*row, "clash") for row in rows], STAGED) for rows in (left, right))
    return {(r.l, r.r): r.value for r in link.link(a, b).collect()}


def test_linkage(spark):
    left = [
        (1, "Electric Cathedral Nisowapa", "てざぎけてニソワパ", [], 2012, "tv"), (2, "Electric Cathedral Nisowapa 4", None, None, 2017, "tv"), (3, "Station of Pigogupe, The", "x", [], 2023, "movie"),
        (4, "Zakegupo and the Emebr", "Zakegupo and the Emebr", [], 2003, "tv"), (5, None, None, None, None, None), (None, "Nobody", None, None, 2000, "tv"), (1, "Electric Cathedral Nisowapa", None, [], 2012, "tv"),
    ]
    right = [
        (11, "Tezagi Kete Nisowapa", "Tezagi Kete Nisowapa", ["てざぎけてニソワパ", "Nisow C"], 2012, "anime_tv"), (12, "Tezagi Kete Nisowapa Part IV", None, ["Electric Cathedral Nisowapa 4th Season"], 2018, "ona"),
        (13, "The Station of Pigogupe", None, [], 2003, "anime_movie"), (14, "Zakegupo and the Ember", "Zakegupo and the Ember", [], 2003, "ova"), (15, "", "", [], 2000, "ona"),
        (16, "Electric Cathedral Nisowapa: Paper Puppet", None, [], 2012, "special"),
    ]
    got = linked(spark, left, right)
    assert set(got) == {(1, 11), (2, 12), (4, 14)} and all(0.5 <= v <= 1 for v in got.values())


def test_each_record_is_linked_once_and_ties_go_to_the_least(spark):
    left = [(i, "The Oath of Gemashibi", None, [], 2000, "tv") for i in (1, 2, 3)]
    right = [(i, "Gemashibi's Oath", None, [], 2000, "ova") for i in (7, 8)]
    assert set(linked(spark, left, right)) == {(1, 7)}


def test_classes_keep_every_record(spark):
    rows = [(i, "The Oath of Gemashibi", None, [], 2000, "tv", "clash") for i in (4, 1, 3)] + [(2, "The Oath of Gemashibi", None, [], None, "tv", ""), (9, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, STAGED)
    assert {(r.id, r.class_id) for r in link.classes(df).collect()} == {(1, 1), (3, 1), (4, 1), (2, 2)}


def test_short_titles_are_linked(spark):
    assert set(linked(spark, [(1, "Hunter X", None, None, 2000, "tv")], [(2, "Hunter X", "Hunter X", [], 2000, "anime_tv")])) == {(1, 2)}


@pytest.mark.parametrize("most", [30_000, 7])
def test_candidates_are_all_pairs_of_near_years(spark, monkeypatch, most):
    monkeypatch.setattr(link, "MOST_FORMS", most)
    rng = random.Random(11)
    make = lambda first: [(first + i, ["".join(rng.choices("ab", k=rng.randint(1, 9)))], [], 1, False, rng.choice([None, *range(1990, 2012)]), None) for i in range(120)]
    schema = "id bigint, flats array<string>, bags array<string>, number int, movie boolean, year int, kind string"
    left, right = make(0), make(1000)
    got = {tuple(r) for r in link.candidate_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {
        (x[0], y[0]) for x in left for y in right
        if 5 * apart(x[1][0], y[1][0]) < max(len(x[1][0]), len(y[1][0])) and (x[5] is None or y[5] is None or abs(x[5] - y[5]) <= 2)
    }
    assert got == want


def test_exclusivity_prefers_the_better_pair(spark):
    truth = spark.createDataFrame([(1, 11, 1.0, 1.0, 1.0, 1.0), (1, 12, 0.8, 1.0, 0.5, 0.5), (2, 12, 1.0, 1.0, 0.9, 1.0)], "l bigint, r bigint, similar double, number double, near double, kind double")
    values = {(r.l, r.r): r.value for r in link.infer(truth, rounds=40).collect()}
    assert values[1, 11] > 0.8 and values[2, 12] > 0.8 and values[1, 12] < 0.3
    assert values[1, 11] + values[1, 12] < 1.1 and values[1, 12] + values[2, 12] < 1.1


def test_empty_tables(spark):
    assert linked(spark, [], []) == {} == linked(spark, [(1, "Oath", None, [], 2000, "tv")], [])


def test_forms_of_few_edits_meet_wherever_the_edits_lie(spark):
    left = [(1, "Bozaasa's Ivvory", None, [], 1981, "tv"), (2, "Tamuzzego's Hemit", None, [], 1990, "tv"), (3, "Korin Pevato", None, [], None, "tv"), (4, "Pigogupe", None, [], 2001, "tv")]
    right = [(11, "Bozasasa's Ivory", None, [], 1981, "anime_tv"), (12, "Tamuzego's Hermit", None, [], 1991, "anime_tv"), (13, "Krin Pevaato", None, [], 1999, "anime_tv"), (14, "Pikokupe", None, [], 2001, "anime_tv")]
    assert {(1, 11), (2, 12), (3, 13)} == set(linked(spark, left, right))


def test_similar_forms_leaves_out_no_pair():
    rng, alphabet = random.Random(7), "abcde "
    for _ in range(3000):
        form = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        other, most = form, len(form) // 6 if len(form) > 5 else 0
        for _ in range(rng.randint(0, most)):  # insertions keep edits few against the longer form
            at = rng.randrange(len(other) + 1)
            other = rng.choice((other[:at] + rng.choice(alphabet) + other[at:], other[:at] + rng.choice(alphabet) + other[at + 1 :]))
        assert sum(len(i) for i, _ in link.similar_forms([form], [other])) == 1 == sum(len(i) for i, _ in link.similar_forms([other], [form])), (form, other)


def test_rivals_of_near_years_are_solved(spark):
    rows = [(1, 11, 1.0, 1.0, 1.0, 1.0), (1, 12, 1.0, 1.0, 0.9, 1.0), *((i, j, 1.0, 1.0, 1.0, 1.0) for i in (2, 3) for j in (21, 22))]
    truth = spark.createDataFrame(rows, "l bigint, r bigint, similar double, number double, near double, kind double")
    values = link.infer(truth)
    got = {(r.l, r.r): r.value for r in values.collect()}
    assert got[1, 11] > 0.5 > got[1, 12] and abs(got[1, 11] + got[1, 12] - 1) < 1e-3
    assert all(abs(got[i, j] - 0.5) < 1e-3 for i in (2, 3) for j in (21, 22))
    assert (1, 11) in {(r.l, r.r) for r in link.choose(values).collect()}


def test_large_groups_are_solved_by_rounds_over_all_executors(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, 100 + j, rng.choice([0.8, 1.0]), 1.0, rng.choice([0.5, 0.9, 1.0]), rng.choice([0.5, 1.0])) for i in range(4) for j in range(4) if rng.random() < 0.8] + [(50, 150, 1.0, 1.0, 1.0, 1.0), (50, 151, 1.0, 1.0, 0.9, 1.0)]
    truth = spark.createDataFrame(rows, "l bigint, r bigint, similar double, number double, near double, kind double")
    monkeypatch.setattr(link, "SETTLED", 0.02)
    values = lambda: {(r.l, r.r): r.value for r in link.infer(truth, rounds=12).collect()}
    in_tasks = values()
    monkeypatch.setattr(link, "SOLVED_AT_ONCE", 3)  # the group of 50 is small enough, the other is not
    by_rounds = values()
    assert by_rounds.keys() == in_tasks.keys() and all(abs(by_rounds[k] - in_tasks[k]) <= 2e-4 for k in in_tasks)
