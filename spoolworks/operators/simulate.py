"""Games of candidate elimination, and the figures of their results.

Games are independent given the answers of all entities to all questions, which are numbers of one byte. The matrix is
packed once and sent to the executors if it is no larger than MOST_MATRIX_BYTES; games then run in parallel. Larger
populations are sampled first, as the number of candidates of a game is a parameter of the benchmark.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolworks.operators import questions
from spoolworks.operators.predicates import NO, NO_ANSWER, YES
from spoolworks.session import Sent

MOST_MATRIX_BYTES = 256_000_000
POLICIES = ("random", "entropy", "expected_reduction")

STEP = "step:int,question_id:string,question_family:string,answer:int,remaining_candidates:int"
EMPTIED = "step:int,question_id:string,question_family:string,answer:int,candidates_before:int,candidates_after:int"
RESULT = (
    "policy string, seed int, game int, target_entity_id string, guessed_entity_id string, correct boolean, questions_asked int, remaining_candidates int, "
    f"terminated_reason string, history array<struct<{STEP}>>, emptied struct<{EMPTIED}>"
)
COLUMNS = (
    "policy", "seed", "game", "target_entity_id", "guessed_entity_id", "correct", "questions_asked", "remaining_candidates", "terminated_reason", "history", "emptied",
)


class Matrix:
    """The answers of all entities, a row for each question, with what the policies need of the questions."""

    def __init__(self, ids: list[str], answers: np.ndarray, catalogue: Sequence[questions.Question], weights: np.ndarray | None = None) -> None:
        self.ids, self.answers, self.weights = ids, answers, weights
        self.question_ids = [q.question_id for q in catalogue]
        self.families = [q.family for q in catalogue]
        self.reliability = np.array([q.reliability for q in catalogue])

    def splits(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Yes, no and unknown answers of the candidates, by question."""
        part = self.answers[:, candidates]
        yes, no = (part == YES).sum(1), (part == NO).sum(1)
        return yes, no, part.shape[1] - yes - no

    def best(self, candidates: np.ndarray, asked: np.ndarray, policy: str) -> int:
        """The question a policy asks next: best score, more answered, less unknown, more reliable, first in the catalogue."""
        counts = np.stack(self.splits(candidates)).astype(float)
        total = len(candidates)
        share = counts / total
        if policy == "entropy":
            score = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(0)
        else:
            score = 1 - (share[0] * counts[0] + share[1] * counts[1] + share[2] * total) / total
        order = np.lexsort((np.arange(len(score)), -self.reliability, share[2], -(share[0] + share[1]), -np.round(score, 12)))
        return int(next(q for q in order if not asked[q]))


def matrix(entities: DataFrame, catalogue: Sequence[questions.Question], key: str = "entity_id", weight: str | None = None) -> Matrix:
    """The packed answers of a population whose ids are unique; refused if it is too large."""
    n = entities.count()
    if n * max(1, len(catalogue)) > MOST_MATRIX_BYTES:
        raise ValueError(f"{n} entities and {len(catalogue)} questions are too many; sample the entities first")
    ready, columns = questions.answers(entities, catalogue)
    packed = F.concat(F.lit(""), *[a.cast("string") for a in columns])
    rows = ready.select(F.col(key).alias("id"), packed.alias("answers"), *([F.col(weight).cast("double").alias("w")] if weight else [])).toPandas().sort_values("id")
    answers = np.frombuffer("".join(rows["answers"]).encode(), np.uint8).reshape(n, len(catalogue)) - ord("0")
    return Matrix(rows["id"].tolist(), np.ascontiguousarray(answers.T).astype(np.int8), catalogue, rows["w"].to_numpy() if weight else None)


def target_weight() -> Column:
    """The weight of an entity as a popular target: ``log1p`` of popularity and votes; missing and negative ones are 0."""
    plus = lambda c: F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return F.log1p(plus("popularity") + plus("vote_count"))


def pick_targets(m: Matrix, rng: random.Random, mode: str) -> int:
    """A game's target: uniform, or weighted by :func:`target_weight`; weight 0 counts as 0.001."""
    if mode == "popularity":
        upto = np.cumsum(np.where(m.weights > 0, m.weights, 0.001))
        return int(np.searchsorted(upto, rng.random() * upto[-1]))
    return rng.randrange(len(m.ids))


def play(m: Matrix, target: int, policy: str, most: int, rng: random.Random, choose=None) -> tuple:
    """One game: (guess, asked, remaining, reason, history, emptied). The guess is the first remaining candidate.

    ``emptied`` is the step that left no candidate, with the numbers before and after it, else null.
    """
    emptied = None
    candidates, asked, history, reason = np.arange(len(m.ids)), np.zeros(len(m.question_ids), bool), [], "max_questions_reached"
    for step in range(1, most + 1):
        if len(candidates) <= 1:
            break
        if asked.all():
            reason = "no_more_questions"
            break
        path = tuple((h[1], h[3]) for h in history)
        q = int(rng.choice(np.flatnonzero(~asked).tolist())) if policy == "random" else choose(path, candidates, asked)
        asked[q] = True
        answer, before = int(m.answers[q, target]), len(candidates)
        if answer != NO_ANSWER:
            candidates = candidates[m.answers[q, candidates] == answer]
        if before and not len(candidates):
            emptied = dict(zip(_names(EMPTIED), (step, m.question_ids[q], m.families[q], answer, before, 0)))
        history.append((step, m.question_ids[q], m.families[q], answer, len(candidates)))
    if len(candidates) == 1:
        reason = "single_candidate"
    elif not len(candidates):
        reason = "empty_candidate_set"
    guess = m.ids[candidates[0]] if len(candidates) else None
    return guess, len(history), len(candidates), reason, history, emptied


def _names(fields: str) -> list[str]:
    return [f.split(":")[0] for f in fields.split(",")]


def run_games(entities: DataFrame, catalogue: Sequence[questions.Question], policies: Sequence[str] = POLICIES, seeds: Sequence[int] = (42, 123, 999), games: int = 1000, most: int = 25, mode: str = "uniform") -> DataFrame:
    """Results of ``games`` games for each policy and seed, by :data:`RESULT`.

    The game's number and seed decide its target and a random policy's questions, however the games are distributed. The
    question that a deterministic policy asks depends only on the answers so far, so each task remembers it by these.
    """
    spark = entities.sparkSession
    weighted = entities.withColumn("_weight", target_weight()) if mode == "popularity" else entities
    sent = Sent(spark, matrix(weighted, catalogue, weight="_weight" if mode == "popularity" else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Matrix = sent.get()
        known: dict = {}

        def chooser(policy: str):
            def choose(path, candidates, asked):
                key = (policy, path)
                if key not in known:
                    known[key] = m.best(candidates, asked, policy)
                return known[key]

            return choose

        for batch in batches:
            rows = []
            for policy, seed, game in batch.itertuples(index=False):
                rng = random.Random(seed * 1_000_003 + game)
                target = pick_targets(m, rng, mode)
                guess, asked, left, reason, history, emptied = play(m, target, policy, most, rng, chooser(policy))
                steps = [dict(zip(_names(STEP), h)) for h in history]
                rows.append((policy, seed, game, m.ids[target], guess, guess == m.ids[target], asked, left, reason, steps, emptied))
            yield pd.DataFrame(rows, columns=COLUMNS)

    plan = spark.range(games).select(F.explode(F.array(*map(F.lit, policies))).alias("policy"), F.col("id").cast("int").alias("game"))
    plan = plan.select("policy", F.explode(F.array(*map(F.lit, seeds))).alias("seed"), "game")
    return plan.repartition("policy", "seed", "game").mapInPandas(run, RESULT)


# --- figures --------------------------------------------------------------------------------------------------------


def rates(results: DataFrame, by: Sequence[str] = ("policy", "seed")) -> DataFrame:
    """Games, accuracy, failure rate, rate of empty candidate sets, mean and median of questions and remaining candidates."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("games"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg((~F.col("correct")).cast("int")).alias("failure_rate"),
        F.avg((F.col("terminated_reason") == "empty_candidate_set").cast("int")).alias("zero_candidate_rate"), F.avg("questions_asked").alias("mean_questions"),
        F.median("questions_asked").alias("median_questions"), F.avg("remaining_candidates").alias("mean_remaining"), F.median("remaining_candidates").alias("median_remaining"),
    )


def reduction_curve(results: DataFrame, universe: int, by: Sequence[str] = ("policy",)) -> DataFrame:
    """``by..., step, mean_remaining, median_remaining, games``; step 0 is the universe."""
    steps = results.select(*by, F.explode("history").alias("h")).select(*by, F.col("h.step").alias("step"), F.col("h.remaining_candidates").alias("n"))
    start = results.select(*by, F.lit(0).alias("step"), F.lit(universe).alias("n"))
    return start.unionByName(steps).groupBy(*by, "step").agg(F.avg("n").alias("mean_remaining"), F.median("n").alias("median_remaining"), F.count(F.lit(1)).alias("games"))


def family_use(results: DataFrame, universe: int, by: Sequence[str] = ("policy",)) -> DataFrame:
    """``by..., question_family, uses, share, mean_reduction``: how often each family is asked and how much it removes."""
    steps = results.select(*by, "seed", "game", F.explode("history").alias("h")).select(*by, "seed", "game", "h.*")
    game = Window.partitionBy(*by, "seed", "game").orderBy("step")
    before = F.lag("remaining_candidates", 1, universe).over(game)
    reduced = steps.withColumn("reduction", F.try_divide(before - F.col("remaining_candidates"), before))
    uses = reduced.groupBy(*by, "question_family").agg(F.count(F.lit(1)).alias("uses"), F.avg("reduction").alias("mean_reduction"))
    return uses.select(*by, "question_family", "uses", (F.col("uses") / F.sum("uses").over(Window.partitionBy(*by))).alias("share"), "mean_reduction")


def difficult(results: DataFrame, least: int = 20) -> DataFrame:
    """Games that failed or took ``least`` questions."""
    return results.where(~F.col("correct") | (F.col("questions_asked") >= least))


def emptied(results: DataFrame) -> DataFrame:
    """The steps that left no candidate, with their games' targets and the candidates before and after."""
    return results.where(F.col("emptied").isNotNull()).select("policy", "seed", "game", "target_entity_id", "emptied.*")


def summary(results: DataFrame, universe: int, steps: int = 10, families: int | None = None, most: int = 20) -> DataFrame:
    """``policy, summary``: the figures of each policy as one JSON document.

    It holds the games, rates and questions, the first ``steps`` of the reduction curve, the families by usage, and at most
    ``most`` difficult games and emptied ones, first by seed and game.
    """
    by = ["policy"]
    figures = rates(results, by).join(results.groupBy(*by).agg(F.min("questions_asked").alias("least_questions"), F.max("questions_asked").alias("most_questions")), by)
    documents = [
        figures.select("policy", F.struct(*[c for c in figures.columns if c != "policy"]).alias("rates")),
        _listed(reduction_curve(results, universe, by).where(F.col("step") <= steps), ["step"], "curve"),
        _listed(family_use(results, universe, by), ["-uses", "question_family"], "families", families),
        _listed(difficult(results).drop("history", "emptied"), ["seed", "game"], "difficult", most), _listed(emptied(results), ["seed", "game"], "emptied", most),
    ]
    one = reduce(lambda a, b: a.join(b, "policy", "left"), documents)
    return one.select("policy", F.to_json(F.struct("rates", *[F.coalesce(c, F.array()).alias(c) for c in ("curve", "families", "difficult", "emptied")])).alias("summary"))


def _listed(df: DataFrame, order: Sequence[str], name: str, most: int | None = None) -> DataFrame:
    """``policy`` and the rows of each policy as an ordered list, of which there are few or at most ``most``."""
    keys = [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in order]
    if most is not None:
        df = df.withColumn("_place", F.row_number().over(Window.partitionBy("policy").orderBy(*keys))).where(F.col("_place") <= most).drop("_place")
    rest = F.struct(*[c for c in df.columns if c != "policy"])
    listed = F.array_sort(F.collect_list(F.struct(*[k.alias(f"_{i}") for i, k in enumerate(keys)], rest.alias("row"))))
    return df.groupBy("policy").agg(F.transform(listed, lambda x: x["row"]).alias(name))


def across_seeds(figures: DataFrame) -> DataFrame:
    """Mean and population standard deviation over seeds of the figures of :func:`rates`, by policy."""
    names = ("accuracy", "mean_questions", "mean_remaining", "failure_rate")
    return figures.groupBy("policy").agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))])
