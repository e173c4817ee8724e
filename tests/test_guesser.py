"""Predicates, questions, scores and games on small populations."""

from __future__ import annotations

import inspect
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolworks import cli
from spoolworks.operators import predicates, questions, registry, simulate
from spoolworks.plans import figures

ENTITY = "entity_id string, title string, media_type string, genres array<string>, release_year double, original_language string, origin_country array<string>, runtime double, num_episodes double, rating double"


def population(spark, rows):
    return spark.createDataFrame(rows, ENTITY)


@pytest.fixture(scope="module")
def four(spark):
    return population(spark, [
        ("A", "a", "movie", ["Action", None], 2010.0, "en", ["US"], 90.0, None, 7.5), ("B", "b", "Movie ", ["Drama"], 1990.0, "nan", [], math.nan, 3.0, 6.0),
        ("C", "c", "tv", [], None, None, ["JP"], 30.0, 24.0, None), ("D", "d", None, None, 2021.0, "ja", None, None, 1.0, 8.5),
    ])


def states(df, *predicate):
    return {r.entity_id: r.state for r in df.select("entity_id", predicates.state(df, *predicate).alias("state")).collect()}


T, N, U, X = predicates.KNOWN_TRUE, predicates.KNOWN_FALSE, predicates.UNKNOWN, predicates.NOT_APPLICABLE


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (("media_type", "equals", " MOVIE"), {"A": T, "B": T, "C": N, "D": U}), (("genres", "contains", "action"), {"A": T, "B": N, "C": U, "D": U}),
        (("title", "contains", "A"), {"A": T, "B": N, "C": N, "D": N}), (("release_year", ">", 2000), {"A": T, "B": N, "C": U, "D": T}),
        (("release_year", "lt", 1990), {"A": N, "B": N, "C": U, "D": N}), (("runtime", "gte", 90), {"A": T, "B": U, "C": N, "D": U}),
        (("release_year", "between", [1990, 2010]), {"A": T, "B": T, "C": U, "D": N}), (("release_year", "between", [1990]), dict.fromkeys("ABCD", U)),
        (("original_language", "in", ["EN", "fr"]), {"A": T, "B": U, "C": U, "D": N}), (("original_language", "in", "en"), {"A": N, "B": U, "C": U, "D": N}),
        (("num_episodes", "equals", 3), {"A": X, "B": T, "C": N, "D": N}), (("title", "gte", 3), dict.fromkeys("ABCD", U)), (("rating", "gte", "high"), dict.fromkeys("ABCD", U)),
        (("media_type", "equals", 5), {"A": N, "B": N, "C": N, "D": U}), (("rating", "equals", "7.5"), {"A": N, "B": N, "C": U, "D": N}), (("genres", "contains", 3), {"A": N, "B": N, "C": U, "D": U}),
        (("mood", "equals", "x"), dict.fromkeys("ABCD", U)), (("rating", "like", 3), dict.fromkeys("ABCD", U)),
    ],
)
def test_states(four, predicate, want):
    assert states(four, *predicate) == want


def test_missing_values(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", "  ", "NaN", " null", "[]", "{}", "none", "Action", "0")], "v string")
    assert [r[0] for r in df.select(predicates.is_missing(F.col("v"), df.schema["v"].dataType)).collect()] == [True] * 8 + [False] * 2


def test_registry():
    known = registry.DEFAULT
    assert len(known.features()) == 37 and known.leaks("title") and known.leaks("whatever") and known.askable("genres") and not known.askable("popularity")
    for feature, start in (("entity_id", "LEAKAGE PROTECTION ERROR"), ("popularity", "GAMEPLAY RESTRICTION ERROR")):
        with pytest.raises(ValueError, match=start):
            questions.Question("?", feature, "equals", 1, "x")
    with pytest.raises(KeyError):
        known.check("whatever")


def test_generation_round_trip_and_ids(spark):
    df = population(spark, [(str(i), "t", "movie" if i % 2 else "tv", ["Action"] if i % 2 else ["Drama", "Action "], 2000.0 + i, "en", ["us"], 100.0, 2.0, 7.0) for i in range(12)])
    found = questions.generate(df)
    texts = [q.text for q in found]
    assert texts[:2] == ["Is it a movie?", "Is it a TV series?"] and "Is it an Action title?" in texts and "Is it a Drama title?" not in texts
    assert "Is the primary language English?" in texts and "Is it produced in or associated with the United States?" in texts and len(found) == 2 + 1 + 1 + 1 + 18 + 3 + 4 + 2
    assert all(q.question_id.startswith(f"q_{q.family}_") for q in found) and len({q.question_id for q in found}) == len(found)
    genre = next(q for q in found if q.family == "genre")
    assert questions.genre_questions(df).first().question_id == genre.question_id
    assert questions.from_frame(questions.to_frame(spark, found)) == [q.__class__(**{**q.__dict__}) for q in found]


def test_values_are_read_by_feature():
    assert questions.read_value("genres", "1984") == "1984" and questions.read_value("release_year", "[1970, 1979]") == [1970, 1979]
    assert questions.read_value("runtime", "60.0") == 60.0 and questions.read_value("release_year", "1980") == 1980


def test_no_entities(spark):
    empty = population(spark, [])
    assert questions.generate(empty) == []
    q = questions.Question("?", "genres", "contains", "Drama", "genre")
    row = questions.profile(empty, [q]).first()
    assert (row.coverage, row.balance, row.missingness) == (0.0, 0.0, 1.0)
    assert questions.split_scores(questions.answer_counts(empty, [q])).isEmpty()
    assert questions.answer_counts(empty, []).isEmpty()


def forty(spark):
    kinds = ["movie"] * 40 + ["tv"] * 40 + [None] * 20
    return population(spark, [(f"{i:03}", "t", k, None, None, None, None, None, None, None) for i, k in enumerate(kinds)])


def test_split_score_of_the_known_population(spark):
    movie = questions.Question("?", "media_type", "equals", "movie", "media")
    row = questions.split_scores(questions.answer_counts(forty(spark), [movie])).first()
    assert (row.yes, row.no, row.unknown) == (40, 40, 20)
    assert row.expected_remaining == pytest.approx(52) and row.expected_reduction == pytest.approx(0.48)
    assert row.entropy == pytest.approx(-(0.4 * math.log2(0.4) * 2 + 0.2 * math.log2(0.2)))


def test_ranking_and_ties(spark):
    df = population(spark, [("A", "a", "movie", ["x"], 2000.0, None, None, None, None, None), ("B", "b", "tv", ["x"], 1980.0, None, None, None, None, None)])
    found = [questions.Question("1", "genres", "contains", "x", "genre"), questions.Question("2", "media_type", "equals", "movie", "media", 0.8), questions.Question("3", "media_type", "equals", "tv", "media", 0.9), questions.Question("4", "release_year", "greater_than", 1990, "time", 0.9)]
    scores = questions.split_scores(questions.answer_counts(df, found))
    ranked = lambda **k: [r.text for r in questions.ranked(scores, questions.to_frame(spark, found), **k).collect()]
    assert ranked() == ["3", "4", "2", "1"] and ranked(asked=[found[2].question_id]) == ["4", "2", "1"]


def test_redundancy(spark):
    df = forty(spark)
    found = [questions.Question(t, "media_type", "equals", v, "media") for t, v in (("a", "movie"), ("b", "tv"), ("c", " MOVIE"))]
    assert {r.pos: r.redundancy_group for r in questions.redundancy(df, found).collect()} == {0: "rg_001", 1: "rg_002", 2: "rg_001"}
    kept = questions.qualify(df, [*found, questions.Question("d", "rating", "gte", 7, "rating")])
    assert [q.text for q in kept] == ["a", "b", "c"] and kept[0].coverage == 0.8 and kept[0].balance == 1.0


def test_elimination_keeps_all_without_an_answer(four):
    q = questions.Question("?", "media_type", "equals", "movie", "media")
    ids = lambda a: {r.entity_id for r in questions.eliminate(four, q, a).collect()}
    assert ids(predicates.YES) == {"A", "B"} and ids(predicates.NO) == {"C"} and ids(predicates.NO_ANSWER) == {"A", "B", "C", "D"}


def test_games(spark):
    rng = random.Random(1)
    rows = [(f"{i:03}", "t", rng.choice(["movie", "tv", None]), [g for g in ("Action", "Drama", "Crime") if rng.random() < 0.5], 1970.0 + rng.randrange(50), rng.choice(["en", "ja"]), ["US"], 60.0 + rng.randrange(90), 1.0 + rng.randrange(30), rng.randrange(100) / 10) for i in range(80)]
    df = population(spark, rows).cache()
    found = questions.qualify(df, questions.generate(df))
    results = simulate.run_games(df, found, seeds=(1, 2), games=12).cache()
    assert results.count() == 3 * 2 * 12
    again = simulate.run_games(df, found, seeds=(1, 2), games=12).drop("history")
    assert results.drop("history").exceptAll(again).isEmpty()
    for r in results.collect():
        left = [h.remaining_candidates for h in r.history]
        assert left == sorted(left, reverse=True) and r.remaining_candidates >= 1 and r.terminated_reason != "empty_candidate_set"
        assert len({h.question_id for h in r.history}) == len(r.history) == r.questions_asked <= 25
        assert r.correct == (r.guessed_entity_id == r.target_entity_id)
    first = {r.history[0].question_id for r in results.where("policy = 'entropy'").collect()}
    scores = questions.split_scores(questions.answer_counts(df, found))
    assert first == {questions.ranked(scores.withColumn("entropy", F.round("entropy", 12)), questions.to_frame(spark, found)).first().question_id}
    figures = {r.policy: r for r in simulate.across_seeds(simulate.rates(results)).collect()}
    assert figures["entropy"].mean_questions_mean <= figures["random"].mean_questions_mean


KNOWN_GAMES = [
    ("p", 1, 1, "a", "a", True, 2, 1, "single_candidate", [(1, "q1", "media", 1, 40), (2, "q2", "time", 0, 1)], None),
    ("p", 1, 2, "b", "c", False, 25, 4, "max_questions_reached", [(1, "q1", "media", 1, 40)], None),
    ("p", 1, 3, "d", None, False, 1, 0, "empty_candidate_set", [(1, "q1", "media", 0, 0)], (1, "q1", "media", 0, 100, 0)),
]


def test_figures_of_the_known_games(spark):
    results = spark.createDataFrame(KNOWN_GAMES, simulate.RESULT)
    row = simulate.rates(results).first()
    assert row.accuracy == pytest.approx(1 / 3) and row.failure_rate == pytest.approx(2 / 3) and row.zero_candidate_rate == pytest.approx(1 / 3)
    emptied = simulate.emptied(results).first()
    assert simulate.difficult(results).count() == 2 and (emptied.question_id, emptied.candidates_before, emptied.candidates_after) == ("q1", 100, 0)
    curve = {r.step: r for r in simulate.reduction_curve(results, 100).collect()}
    assert curve[0].mean_remaining == 100 and curve[1].games == 3 and curve[2].mean_remaining == 1
    family = {r.question_family: r for r in simulate.family_use(results, 100).collect()}
    assert family["media"].uses == 3 and family["media"].share == 0.75 and family["time"].mean_reduction == pytest.approx(39 / 40)


def test_summary_document(spark):
    results = spark.createDataFrame(KNOWN_GAMES, simulate.RESULT)
    document = json.loads(simulate.summary(results, 100, steps=1, most=1).first().summary)
    assert document["rates"]["games"] == 3 and document["rates"]["least_questions"] == 1 and [c["step"] for c in document["curve"]] == [0, 1]
    assert [f["question_family"] for f in document["families"]] == ["media", "time"]
    assert [d["game"] for d in document["difficult"]] == [2] and document["emptied"][0]["candidates_before"] == 100
    whole = json.loads(simulate.summary(results.where("game = 1"), 100).first().summary)
    assert whole["difficult"] == whole["emptied"] == []


def test_a_game_tells_which_step_left_no_candidate():
    catalogue = [questions.Question("?", "media_type", "equals", "movie", "media")]
    m = simulate.Matrix(["a", "b"], np.array([[predicates.YES, predicates.NO]], np.int8), catalogue)
    m.question_ids, m.families = ["q", "r"], ["media", "time"]
    m.answers = np.array([[predicates.YES, predicates.YES, predicates.NO], [predicates.YES, predicates.YES, predicates.NO]], np.int8)
    m.ids = ["a", "b"]  # the target, the third, is no candidate
    guess, asked, left, reason, history, emptied = simulate.play(m, 2, "entropy", 5, random.Random(1), lambda path, candidates, asked: 0)
    assert (guess, asked, left, reason) == (None, 1, 0, "empty_candidate_set")
    assert emptied == {"step": 1, "question_id": "q", "question_family": "media", "answer": predicates.NO, "candidates_before": 2, "candidates_after": 0}


def test_popular_targets_are_weighted_by_popularity_and_votes(spark):
    rows = [("a", 1000.0, 1000), ("b", None, None), ("c", float("nan"), -5), ("d", 0.0, 50)]
    df = spark.createDataFrame(rows, "entity_id string, popularity double, vote_count bigint")
    got = {r[0]: r[1] for r in df.select("entity_id", simulate.target_weight()).collect()}
    assert got == {"a": pytest.approx(math.log1p(2000)), "b": 0.0, "c": 0.0, "d": pytest.approx(math.log1p(50))}
    m = simulate.Matrix(list("abcd"), np.zeros((1, 4), np.int8), [], np.array([got[i] for i in "abcd"]))
    rng = random.Random(5)
    picks = [simulate.pick_targets(m, rng, "popularity") for _ in range(4000)]
    share = math.log1p(2000) / (math.log1p(2000) + math.log1p(50) + 0.002)
    assert abs(picks.count(0) / 4000 - share) < 0.03 and picks.count(1) < 20


def test_too_large_a_matrix_is_refused(spark, four, monkeypatch):
    monkeypatch.setattr(simulate, "MOST_MATRIX_BYTES", 3)
    with pytest.raises(ValueError):
        simulate.matrix(four, [questions.Question("?", "media_type", "equals", "movie", "media")])


def test_benchmark_population_is_drawn_from_all_sources(spark):
    top = cli.parser()
    every = cli._population(spark, top.parse_args(["--root", "/root/testdata/sf0.001", "benchmark", "--sample", "0"]))
    total, mal = every.count(), every.where("entity_id LIKE 'mal%'").count()
    args = top.parse_args(["--root", "/root/testdata/sf0.001", "benchmark", "--sample", str(mal)])
    got, again = ({r[0] for r in cli._population(spark, args).select("entity_id").collect()} for _ in range(2))
    share = sum(i.startswith("mal") for i in got) / len(got)
    assert got == again and len(got) == mal and abs(share - mal / total) < 0.2


def test_registered_games_are_the_whole_workload():
    defaults = inspect.signature(simulate.run_games).parameters
    assert all(sorted(figures.GAMES[n]) == sorted(defaults[n].default) for n in ("policies", "seeds")) and figures.GAMES["games"] == defaults["games"].default
