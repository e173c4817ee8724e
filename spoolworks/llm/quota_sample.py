"""Samples whose category shares match targets, by swap repair over category signatures.

The records are counted by signature, the combination of their targeted categories; there are at most as many signatures as
combinations of targets, whatever the number of records. Over these counts a random sample that satisfies the floors is
repaired: counts are exchanged between signatures while that lowers the deviation from the targets. A target that the
repaired sample misses is then repaired for alone, in a sample large enough for it: what even that cannot reach is not there.
Each signature's count is then drawn at random, as its records with the smallest hashes. The hash at which to cut comes from
a histogram of hash ranges, so that only the records of one range per signature are ever ordered, and no signature is
gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "\u0000"
#: Most target rows, and most signatures of one target set, that the driver takes; the repair's memory is linear in both.
MOST_TARGETS, MOST_SIGNATURES = 10_000, 1_000_000
#: Hash ranges of a signature are told apart by so many bits.
RANGE_BITS = 12


@dataclass(frozen=True)
class Target:
    """A target: a share of the sample, in thousandths, of a category, and the least number of records."""

    dimension: str
    category: str
    share_permille: int
    min_rows: int


@dataclass
class TargetSet:
    """The targets of one sample and its size in thousandths of all records."""

    name: str
    sample_permille: int
    targets: list[Target] = field(default_factory=list)

    @property
    def dimensions(self) -> list[str]:
        """The targeted dimensions in order."""
        return list(dict.fromkeys(t.dimension for t in self.targets))

    def size(self, records: int) -> int:
        """The sample's size out of so many records."""
        return self.sample_permille * records // 1000

    def wanted(self, target: Target, records: int) -> int:
        """How many records the target asks for."""
        return max(target.min_rows, -(-target.share_permille * self.size(records) // 1000))


def read_targets(targets: DataFrame) -> list[TargetSet]:
    """The target sets of a table ``target_set, dimension, category, share_permille, min_rows, sample_permille``.

    Rows with a null in any of these state no target; repeated rows count once. More than :data:`MOST_TARGETS` are refused.
    """
    names = ["target_set", "dimension", "category", "share_permille", "min_rows", "sample_permille"]
    rows = targets.select(*names).dropna().distinct().limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    sets: dict[str, TargetSet] = {}
    for row in sorted(rows):
        one = sets.setdefault(row.target_set, TargetSet(row.target_set, row.sample_permille))
        one.targets.append(Target(row.dimension, row.category, row.share_permille, row.min_rows))
    return list(sets.values())


class Counts:
    """The records of a target set by signature, and which targets each signature counts for."""

    def __init__(self, one: TargetSet, signatures: Sequence[str], available: Sequence[int]) -> None:
        self.available = np.array(available, dtype=np.int64)
        codes = [{OTHER: 0} for _ in one.dimensions]
        parts = [s.split("\u0001") for s in signatures]
        #: category of each signature in each dimension, and (dimension, category) of each target
        self.cats = np.array([[codes[d].setdefault(c, len(codes[d])) for d, c in enumerate(p)] for p in parts], dtype=np.int64).reshape(len(parts), len(codes))
        at = {name: d for d, name in enumerate(one.dimensions)}
        self.targets = [(at[t.dimension], codes[at[t.dimension]].setdefault(t.category, len(codes[at[t.dimension]]))) for t in one.targets]
        self.sizes = [len(c) for c in codes]

    def __len__(self) -> int:
        return len(self.available)

    def members(self, target: int) -> np.ndarray:
        """Which signatures count for a target."""
        dimension, code = self.targets[target]
        return self.cats[:, dimension] == code

    def held(self, counts: np.ndarray) -> np.ndarray:
        """How many of so many records by signature count for each target."""
        sums = [np.bincount(self.cats[:, d], counts, size).astype(np.int64) if len(counts) else np.zeros(size, np.int64) for d, size in enumerate(self.sizes)]
        return np.array([sums[d][c] for d, c in self.targets], dtype=np.int64)

    def by_category(self, values: np.ndarray) -> list[np.ndarray]:
        """The sum of values of targets over each dimension's categories."""
        out = [np.zeros(size, np.int64) for size in self.sizes]
        for (d, c), v in zip(self.targets, values):
            out[d][c] += v
        return out


def draw_counts(free: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` records drawn from so many by signature each one gives: a systematic draw in random order.

    Every record is as likely to be drawn, no signature gives more than it has, and the integers may be of any size.
    """
    total = int(free.sum())
    n, out = min(n, total), np.zeros(len(free), np.int64)
    if n <= 0:
        return out
    order, offset, below, before = rng.permutation(len(free)), int(rng.integers(2**32)), 0, 0
    for s in order:
        below += int(free[s])
        upto = -((offset * total - below * n * 2**32) // (total * 2**32))  # points (k + offset) * total / n under ``below``
        out[s], before = min(n, upto) - before, min(n, upto)
    return out


def start_counts(known: Counts, floors: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A random sample, as counts by signature, that satisfies every floor the records can meet.

    Floors first, in random order, the rest drawn without replacement from all.
    """
    taken = np.zeros(len(known), np.int64)
    for t in rng.permutation(len(floors)):
        members = known.members(t)
        lacking = min(int(floors[t]) - int(taken[members].sum()), size - int(taken.sum()))
        taken += draw_counts(np.where(members, known.available - taken, 0), lacking, rng)
    return taken + draw_counts(known.available - taken, size - int(taken.sum()), rng)


def best_exchange(known: Counts, counts: np.ndarray, less: list[np.ndarray], more: list[np.ndarray], stuck: list[np.ndarray]) -> tuple[int, int, int]:
    """(change, from, to) of the exchange of one record between signatures that lowers the deviation most.

    ``less`` and ``more`` are the changes when a record leaves or joins a category, ``stuck`` says that none may leave it. In
    dimensions where both signatures have the same category nothing changes. For each set of dimensions the best pair that
    agrees there comes from the best of either side by the agreed categories; the other dimensions' changes are never
    under-estimated, so the best over all sets is the best pair, in memory linear in the signatures.
    """
    dimensions = range(len(known.sizes))
    gone = [less[d][known.cats[:, d]] for d in dimensions]
    come = [more[d][known.cats[:, d]] for d in dimensions]
    held = [stuck[d][known.cats[:, d]] for d in dimensions]
    leaves, joins, best = np.flatnonzero(counts > 0), np.flatnonzero(known.available > counts), (0, -1, -1)
    for n in range(len(known.sizes)):
        for agreed in combinations(dimensions, n):
            rest = [d for d in dimensions if d not in agreed]
            a = leaves[~np.any([held[d][leaves] for d in rest], axis=0)]
            if not len(a) or not len(joins):
                continue
            loss, gain = sum(gone[d][a] for d in rest), sum(come[d][joins] for d in rest)
            _, group = np.unique(known.cats[np.concatenate([a, joins])][:, list(agreed)], axis=0, return_inverse=True) if agreed else (None, np.zeros(len(a) + len(joins), np.int64))
            group = group.ravel()
            at_a, at_b = _least(loss, group[: len(a)], group.max() + 1), _least(gain, group[len(a) :], group.max() + 1)
            both = np.flatnonzero((at_a >= 0) & (at_b >= 0))
            if len(both):
                change = loss[at_a[both]] + gain[at_b[both]]
                k = int(np.argmin(change))
                if change[k] < best[0]:
                    best = (int(change[k]), int(a[at_a[both[k]]]), int(joins[at_b[both[k]]]))
    return best


def _least(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The place of the least value of each group, -1 for a group without one."""
    order, out = np.lexsort((-values, group)), np.full(groups, -1, np.int64)
    out[group[order]] = order  # the last of a group, which is the least value, stays
    return out


def repair(known: Counts, counts: np.ndarray, wanted: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, int]:
    """Exchange counts between signatures until none lowers the summed deviation from ``wanted``; (counts, exchanges).

    Each step makes the exchange that lowers the deviation most for one record, for as many records as it stays so: until a
    target is met, a floor is reached, or one signature is used up. Floors that hold are kept.
    """
    counts, steps = counts.copy(), 0
    while len(counts) > 1:
        have = known.held(counts)
        gap = have - wanted
        less, more = known.by_category(np.where(gap > 0, -1, 1)), known.by_category(np.where(gap < 0, -1, 1))
        stuck = [s > 0 for s in known.by_category(have <= floors)]
        change, a, b = best_exchange(known, counts, less, more, stuck)
        if change >= 0:
            break
        n = min(counts[a], known.available[b] - counts[b])
        for t, (d, c) in enumerate(known.targets):
            leaves, joins = known.cats[a, d] == c, known.cats[b, d] == c
            if leaves and not joins:
                n = min(n, gap[t] if gap[t] > 0 else n, have[t] - floors[t] if have[t] > floors[t] else n)
            elif joins and not leaves:
                n = min(n, -gap[t] if gap[t] < 0 else n)
        counts[a], counts[b], steps = counts[a] - n, counts[b] + n, steps + 1
    return counts, steps


def reachable(known: Counts, target: int, wanted: int, size: int, rng: np.random.Generator) -> int:
    """How many records of a target's category swap repair gets into a sample that is repaired for this target alone.

    The sample has ``size`` records, or as many as are wanted if that is more, so only the supply can stop the repair.
    """
    one = Counts.__new__(Counts)
    one.available, one.cats, one.sizes, one.targets = known.available, known.cats, known.sizes, [known.targets[target]]
    start = draw_counts(known.available, max(size, wanted), rng)
    counts, _ = repair(one, start, np.array([wanted]), np.array([0]))
    return int(one.held(counts)[0])


@dataclass
class Plan:
    """What :func:`plan_samples` found: the report rows, and the numbers to draw by target set and signature."""

    records: int
    report: list[tuple[str, str, str, int, int, int, int, str | None]]
    quotas: list[tuple[int, str, int]]
    steps: int


REPORT = "target_set string, dimension string, category string, sample_size bigint, wanted bigint, supply bigint, drawn bigint, unmet string"


def _signature(one: TargetSet):
    parts = []
    for name in one.dimensions:
        known = [t.category for t in one.targets if t.dimension == name]
        parts.append(F.when(F.col(name).isin(*known), F.col(name)).otherwise(F.lit(OTHER)))
    return F.concat_ws("\u0001", *parts)


def _long(entities: DataFrame, record: str, sets: Sequence[TargetSet], seed: int) -> DataFrame:
    """Rows ``record, set_no, signature, hash``: every record once for each target set."""
    pairs = F.array(*[F.struct(F.lit(i).alias("set_no"), _signature(one).alias("signature")) for i, one in enumerate(sets)])
    return entities.select(F.col(record).alias("record"), F.inline(pairs)).withColumn("hash", F.xxhash64(F.lit(seed), "set_no", "record"))


def plan_samples(entities: DataFrame, record: str, sets: Sequence[TargetSet], seed: int = 42) -> Plan:
    """Count signatures, repair a random start for each target set, and report every target.

    ``entities`` has one row a record and a non-null category column for each dimension. ``unmet`` is null where the repaired
    sample meets the target; ``supply`` where a sample repaired for it alone does not either, as there are too few records;
    ``size`` where that one does, but the size or the other targets leave no room.
    """
    if not sets:
        return Plan(0, [], [], 0)
    rows = _long(entities, record, sets, seed).groupBy("set_no", "signature").count().limit(MOST_SIGNATURES * len(sets) + 1).collect()
    if len(rows) > MOST_SIGNATURES * len(sets):
        raise ValueError("too many signatures")
    found: dict[int, dict[str, int]] = {}
    for row in sorted(rows):
        found.setdefault(row.set_no, {})[row.signature] = row["count"]
    records = sum(found.get(0, {}).values())
    plan = Plan(records, [], [], 0)
    for i, one in enumerate(sets):
        signatures, rng = list(found.get(i, {})), np.random.default_rng([seed, i])
        known = Counts(one, signatures, [found[i][s] for s in signatures] if signatures else [])
        wanted = np.array([one.wanted(t, records) for t in one.targets], dtype=np.int64)
        supply = known.held(known.available)
        floors = np.minimum(np.array([t.min_rows for t in one.targets], dtype=np.int64), supply)
        size = one.size(records)
        counts, steps = repair(known, start_counts(known, floors, size, rng), wanted, floors)
        drawn = known.held(counts)
        plan.steps += steps
        plan.quotas += [(i, s, int(n)) for s, n in zip(signatures, counts) if n]
        for t, (target, w, d) in enumerate(zip(one.targets, wanted, drawn)):
            unmet = None
            if d < w:
                unmet = "supply" if reachable(known, t, int(w), size, rng) < w else "size"
            plan.report.append((one.name, target.dimension, target.category, size, int(w), int(supply[t]), int(d), unmet))
    return plan


def draw(entities: DataFrame, record: str, sets: Sequence[TargetSet], plan: Plan, seed: int = 42) -> DataFrame:
    """The planned samples: ``target_set, record, signature``, the records of smallest hash of each signature."""
    spark = entities.sparkSession
    quotas = F.broadcast(spark.createDataFrame(plan.quotas, "set_no int, signature string, quota bigint"))
    names = F.broadcast(spark.createDataFrame([(i, s.name) for i, s in enumerate(sets)], "set_no int, target_set string"))
    long = _long(entities, record, sets, seed).withColumn("range", F.shiftrightunsigned("hash", 64 - RANGE_BITS))
    upto = Window.partitionBy("set_no", "signature").orderBy("range")
    ranges = long.groupBy("set_no", "signature", "range").count().withColumn("upto", F.sum("count").over(upto))
    cuts = (
        ranges.join(quotas, ["set_no", "signature"])
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("count") < F.col("quota")))
        .select("set_no", "signature", F.col("range").alias("cut"), (F.col("quota") - F.col("upto") + F.col("count")).alias("rest"))
    )
    near = long.join(F.broadcast(cuts), ["set_no", "signature"]).where(F.col("range") <= F.col("cut"))  # one cut a signature
    whole = near.where(F.col("range") < F.col("cut"))
    order = Window.partitionBy("set_no", "signature").orderBy("hash", "record")
    part = near.where(F.col("range") == F.col("cut")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("rest"))
    columns = ["set_no", "record", "signature"]
    return whole.select(*columns).unionByName(part.select(*columns)).join(names, "set_no").select("target_set", F.col("record").alias(record), "signature")
