"""Soft-logic linkage of two tables without a common key.

Candidate pairs are all pairs of equal number and near years of which two forms are similar enough; their forms are met
through pieces that so few edits cannot all touch. On them weighted rules say what a match should satisfy, in Lukasiewicz
logic over truth values in [0, 1]:

* similar titles, and similar titles with agreeing number, near year or compatible kind, imply a match;
* a match implies similar titles, an agreeing number, a near year and a compatible kind; and no match is the default;
* *exclusivity* and *transitivity*: a record matches at most one of the other table. (Were x the same as y and as y', then
  y would be the same as y', and two ids of one table never are.) Rows that repeat an id share one variable, which is
  transitivity over known equals, substituted.

Each grounded rule is a hinge of the pair's truth value, so the most probable values solve a convex problem. It is solved by
consensus ADMM: every rule has a copy of each value it speaks of, improves its copies by itself in closed form, and the
copies are averaged, until the residuals are small. Pairs that share records, directly or through others, are solved
together, other pairs apart. The value is the confidence of the match.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spoolworks.llm.titles import parse_all
from spoolworks.session import Scratch

#: Pairs less similar than this are no candidates (a fifth of the letters of the nearest forms differ).
LEAST_SIMILAR = 0.5
#: Years at most so far apart are near; unknown years are near all. Forms of so many years are compared in one group.
YEARS, SPAN = 2, 5
#: Lengths of forms that are compared in one group, which bounds its size.
LENGTHS = 4
#: Forms of one side that are compared in one task at most, about; groups of more are split.
MOST_FORMS = 30_000
#: Classes of letters that are counted before two forms are compared, and pairs counted at once.
LETTERS, AT_ONCE = 32, 1 << 17
#: Contested pairs that are solved in one task, about; a group of more is solved by all executors.
SOLVED_AT_ONCE = 20_000
#: Residuals under which values count as solved, and decimals they are then good for, so that ties stay ties.
SETTLED, DECIMALS = 1e-6, 4

def _forms(titles: list[str | None]) -> tuple[list[str], list[str], int, bool]:
    """The comparable forms of all titles of a record, its number, and whether it is a film."""
    known = parse_all(titles)
    flats, bags = sorted({x.flat for x in known}), sorted({x.bag for x in known})
    numbers = Counter(x.number for x in known if x.number is not None)
    number = min(numbers, key=lambda n: (-numbers[n], n)) if numbers else 1
    return flats, bags, number, any(x.movie for x in known)


def forms_of(df: DataFrame, identity: str = "source_id") -> DataFrame:
    """One row for each id: titles' forms, number, year, kind.

    Rows that repeat an id are one record with the titles of all of them; its year and kind are the greatest of theirs. Rows
    without an id, and records without a title that names anything, match nothing.
    """
    titles = F.concat(F.array("title", "original_title"), F.coalesce("alternative_titles", F.array().cast("array<string>")))
    rows = df.where(F.col(identity).isNotNull()).select(F.col(identity).alias("id"), F.explode(titles).alias("one"), F.col("release_year").cast("int").alias("year"), F.col("media_type").alias("kind"))
    merged = rows.groupBy("id").agg(F.collect_set("one").alias("titles"), F.max("year").alias("year"), F.max("kind").alias("kind"))
    kept = merged.select("id", "year", "kind", "titles")
    texts = T.ArrayType(T.StringType())
    forms = {"flats": texts, "bags": texts, "number": T.IntegerType(), "movie": T.BooleanType()}
    schema = T.StructType([*kept.schema.fields[:3], *[T.StructField(n, t) for n, t in forms.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = list(zip(*map(_forms, batch.column(3).to_pylist())))
            if parsed:
                columns = [pa.array(list(c), f.type) for c, f in zip(parsed, list(arrow)[3:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], schema=arrow)

    return kept.mapInArrow(run, schema).where(F.size("flats") > 0)


ALIKE = ("flats", "bags", "number", "movie", "year", "kind")


def records(forms: DataFrame) -> DataFrame:
    """One row for each class of records that nothing tells apart, under their least ``id``."""
    return forms.groupBy(*ALIKE).agg(F.min("id").alias("id")).select("id", *ALIKE)


def members(forms: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, class_id``: the class of every record, whose least id stands for it."""
    mark = F.xxhash64(*ALIKE)  # narrows the join; the columns decide
    a, b = forms.withColumn("mark", mark).alias("a"), classes.withColumn("mark", mark).alias("b")
    same = F.col("a.mark") == F.col("b.mark")
    for c in ALIKE:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(F.col("a.id"), F.col("b.id").alias("class_id"))


@dataclass(frozen=True)
class Weights:
    """Weights of the rules; exclusivity is certain."""

    similar: float = 0.4
    numbered: float = 1.0
    dated: float = 0.6
    kind: float = 0.4
    not_similar: float = 1.0
    not_numbered: float = 2.0
    not_dated: float = 2.0
    not_kind: float = 0.4
    default: float = 0.3

    def needs_number(self) -> bool:
        """Whether pairs of unequal number want 0 whatever else holds, so that they need not be candidates."""
        return self.not_numbered + self.default > self.similar + self.dated + self.kind

    def needs_year(self) -> bool:
        """Whether pairs of far years want 0 whatever else holds."""
        return self.not_dated + self.default > self.similar + self.numbered + self.kind


def edits(length: int) -> int:
    """Most edits between two forms, the longer of that length, of which less than a fifth of the letters differ."""
    return (length - 1) // 5


@cache
def pieces(length: int, count: int) -> list[tuple[int, int]]:
    """Start and length of ``count`` pieces of a form; the later ones are longer by one where it does not divide."""
    short, longer = divmod(length, count)
    out, start = [], 0
    for i in range(count):
        size = short + (i >= count - longer)
        out.append((start, size))
        start += size
    return out


@cache
def longest(length: int) -> int:
    """Length of the longest form that can be similar to one of that length."""
    other = length
    while other + 1 - length <= edits(other + 1):
        other += 1
    return other


def shortest(length: int) -> int:
    """Length of the shortest form that can be similar to one of that length."""
    return length - edits(length)


def similar_forms(left: list[str], right: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of forms, none of less than ``edits`` edits left out; the pairs are yet to be compared.

    At most t edits leave one of t + 1 pieces of a form whole. The pieces of the right forms are kept by length, t, order and
    text, and looked up at those starts in a left form where, by the number of edits before and after, one of the whole
    pieces must lie (the multi-match-aware selection of Pass-Join). Pairs whose counts of letters are too far apart are
    dropped: an edit changes at most one letter each way.
    """
    known: dict[tuple[int, int, int], dict[str, list[int]]] = defaultdict(dict)  # by length, t and place of the piece
    for j, form in enumerate(right):
        size = len(form)
        for t in range(edits(size), edits(longest(size)) + 1):
            for i, (start, long) in enumerate(pieces(size, t + 1)):
                known[size, t, i].setdefault(form[start : start + long], []).append(j)
    sizes = {size for size, _, _ in known}

    def counts(forms: list[str]) -> np.ndarray:
        letters = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
        owner = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
        return np.bincount(owner * LETTERS + letters, minlength=len(forms) * LETTERS).reshape(-1, LETTERS).astype(np.int32)

    l_counts, r_counts = counts(left), counts(right)
    plans: dict[int, list[tuple[dict[str, list[int]], int, int]]] = {}

    def plan(length: int) -> list[tuple[dict[str, list[int]], int, int]]:
        out = []
        for size in range(shortest(length), longest(length) + 1):
            if size in sizes:
                t, apart = edits(max(length, size)), length - size
                for i, (start, long) in enumerate(pieces(size, t + 1)):
                    first, last = max(start - i, start + apart - (t - i), 0), min(start + i, start + apart + (t - i), length - long)
                    out += [(known[size, t, i], at, at + long) for at in range(first, last + 1)]
        return out

    def alike(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.array(a), np.array(b)
        apart = l_counts[x] - r_counts[y]
        most = (np.maximum(l_counts[x].sum(1), r_counts[y].sum(1)) - 1) // 5
        kept = (np.maximum(apart, 0).sum(1) <= most) & (np.maximum(-apart, 0).sum(1) <= most)
        return x[kept], y[kept]

    a: list[int] = []
    b: list[int] = []
    for i, form in enumerate(left):
        if len(form) not in plans:
            plans[len(form)] = plan(len(form))
        met: set[int] = set()
        for of_piece, start, end in plans[len(form)]:
            of = of_piece.get(form[start:end])
            if of:
                met.update(of)
        a += [i] * len(met)
        b += met
        if len(a) >= AT_ONCE:
            yield alike(a, b)
            a, b = [], []
    if a:
        yield alike(a, b)


_PAIRS = pa.schema([("l", pa.int64()), ("r", pa.int64()), ("a", pa.string()), ("b", pa.string())])


def _met(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of forms of one group, of near or unknown years: ``l, r, a, b``."""
    found = []
    sides = [(t["form"].to_pylist(), t["id"].to_numpy(), t["year"].to_numpy()) for t in (left, right)]
    for kind in ("f", "b"):
        (x, x_id, x_year), (y, y_id, y_year) = (([f for f in forms if f[0] == kind], *(c[[f[0] == kind for f in forms]] for c in rest)) for forms, *rest in sides)
        if x and y:
            swapped = len(x) > len(y)  # looking a form up costs more than keeping its pieces
            for i, j in similar_forms([f[1:] for f in (y if swapped else x)], [f[1:] for f in (x if swapped else y)]):
                i, j = (j, i) if swapped else (i, j)
                near = (np.abs(x_year[i] - y_year[j]) <= YEARS) | (x_year[i] == UNKNOWN) | (y_year[j] == UNKNOWN)
                i, j = i[near], j[near]
                found.append(pa.table([x_id[i], y_id[j], [x[k] for k in i], [y[k] for k in j]], schema=_PAIRS))
    return pa.concat_tables(found) if found else _PAIRS.empty_table()


#: Stands for an unknown year; groups of records of unknown year, and of any year.
UNKNOWN = -1_000_000
WITHOUT, ANY = -1_000_000, -1_000_001


def candidate_pairs(left: DataFrame, right: DataFrame, numbered: bool = True, dated: bool = True) -> DataFrame:
    """Distinct pairs ``l, r`` of records with two flat forms, or two bags, of which less than a fifth of the letters differ.

    If ``numbered``, only those of equal number; if ``dated``, only those of near or unknown years. None of these is left out.
    """
    year, size = F.col("year"), F.col("size")
    group = lambda y: F.floor(y / SPAN).cast("int")

    def rows(side: DataFrame, at: Column, sizes: Column) -> DataFrame:
        forms = F.concat(F.transform("flats", lambda f: F.concat(F.lit("f"), f)), F.transform("bags", lambda f: F.concat(F.lit("b"), f)))
        number = F.col("number") if numbered else F.lit(0)
        out = side.select("id", number.alias("number"), "year", F.explode(forms).alias("form"))
        out = out.withColumn("at", F.explode(at if dated else F.array(F.lit(0))))
        out = out.withColumn("size", F.length("form") - 1).withColumn("sizes", F.explode(sizes))
        return out.select("id", "number", "at", "sizes", "form", F.coalesce(year, F.lit(UNKNOWN)).alias("year") if dated else F.lit(UNKNOWN).alias("year"))

    least = F.greatest(size - F.floor((size - 1) / 5), F.lit(1))
    most = F.floor((size * 5 - 1) / 4)
    of = F.sequence(F.floor(least / LENGTHS), F.floor(most / LENGTHS))
    a = rows(left, F.when(year.isNotNull(), F.array(group(year), F.lit(WITHOUT))).otherwise(F.array(F.lit(ANY), F.lit(WITHOUT))), of)
    near = F.concat(F.sequence(group(year - YEARS), group(year + YEARS)), F.array(F.lit(ANY)))
    b = rows(right, F.when(year.isNotNull(), near).otherwise(F.array(F.lit(WITHOUT))), F.array(F.floor(size / LENGTHS)))
    keys = ["number", "at", "sizes"]
    # groups are split on both sides into parts of about MOST_FORMS, each of which meets every part of the other side
    numbers = {n: side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / MOST_FORMS).alias(n)) for n, side in (("a_parts", a), ("b_parts", b))}
    parts = numbers["a_parts"].join(numbers["b_parts"], keys)
    split = lambda side, own, other: side.join(parts, keys).withColumn(own, F.pmod(F.xxhash64("id", "form"), F.col(f"{own}_parts"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)))
    a, b, keys = split(a, "a", "b"), split(b, "b", "a"), [*keys, "a", "b"]
    columns = [*keys, "id", "form", "year"]
    pairs = a.select(*columns).groupBy(*keys).cogroup(b.select(*columns).groupBy(*keys)).applyInArrow(_met, "l bigint, r bigint, a string, b string")
    apart = F.levenshtein("a", "b")  # the mark of the kind, the same in both, is no letter
    return pairs.where(apart * 5 < F.greatest(F.length("a"), F.length("b")) - 1).select("l", "r").distinct()


def _best(left: str, right: str) -> Column:
    """How near the nearest of two lists of forms are, from 0 (two fifths of the letters differ) to 1."""

    def one(a: Column, b: Column) -> Column:
        apart = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
        return F.greatest(F.lit(0.0), 1 - 2.5 * apart)

    return F.array_max(F.transform(F.col(left), lambda a: F.array_max(F.transform(F.col(right), lambda b: one(a, b)))))


# Kinds of the two tables that go together.
COMPATIBLE = (("movie", "anime_movie"), ("tv", "anime_tv"), ("tv", "ona"), ("tv", "ova"), ("tv", "special"), ("movie", "special"), ("movie", "ova"))


def evidence(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Truth values of the pairs: ``l, r, similar, number, near, kind``."""
    columns = ["id", "flats", "bags", "number", "movie", "year", "kind"]
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in columns])
    both = pairs.join(a, pairs["l"] == a["l_id"]).join(b, F.col("r") == b["r_id"])
    apart = F.abs(F.col("l_year") - F.col("r_year"))
    near = F.when(apart.isNull(), 0.8).when(apart == 0, 1.0).when(apart == 1, 0.9).when(apart == 2, 0.5).otherwise(0.0)
    same = F.arrays_overlap("l_flats", "r_flats") | F.arrays_overlap("l_bags", "r_bags")
    close = F.when(same, 1.0).otherwise(F.greatest(_best("l_flats", "r_flats"), _best("l_bags", "r_bags")))
    kinds = [(F.col("l_kind") == x) & (F.col("r_kind") == y) for x, y in COMPATIBLE]
    kind = kinds[0]
    for k in kinds[1:]:
        kind |= k
    return both.select(
        "l", "r", close.alias("similar"), (F.col("l_number") == F.col("r_number")).cast("double").alias("number"),
        near.alias("near"), F.when(kind, 1.0).when(F.col("l_kind").isNull() | F.col("r_kind").isNull(), 0.8).otherwise(0.5).alias("kind"),
    )


def ground(truth: DataFrame, w: Weights) -> tuple[DataFrame, list[tuple[str, float]]]:
    """The rules of each pair: columns of the points at which their hinges bend, and (column, weight).

    A positive weight pulls the value up to the point, a negative one down to it.
    """
    both = lambda a, b: F.greatest(F.lit(0.0), F.col(a) + F.col(b) - 1)
    points = {
        "up_similar": F.col("similar"), "up_numbered": both("similar", "number"), "up_dated": both("similar", "near"), "up_kind": both("similar", "kind"),
        "down_similar": F.col("similar"), "down_numbered": F.col("number"), "down_dated": F.col("near"), "down_kind": F.col("kind"), "down_default": F.lit(0.0),
    }
    weights = [w.similar, w.numbered, w.dated, w.kind, -w.not_similar, -w.not_numbered, -w.not_dated, -w.not_kind, -w.default]
    return truth.select("l", "r", "similar", *[c.alias(n) for n, c in points.items()]), list(zip(points, weights))


def own_value(rules: list[tuple[str, float]]) -> Column:
    """The value that a pair's own rules want: their loss is least at one of the points; of equal ones the greatest counts."""
    points = [F.lit(0.0), *[F.col(n) for n, _ in rules]]

    def loss(y: Column) -> Column:
        parts = (F.greatest(F.lit(0.0), F.col(n) - y if w > 0 else y - F.col(n)) * abs(w) for n, w in rules)
        return sum(parts, F.lit(0.0))

    return -F.array_min(F.array(*[F.struct(F.round(loss(y), 9).alias("loss"), (-y).alias("y")) for y in points]))["y"]


def infer(truth: DataFrame, weights: Weights = Weights(), rounds: int | None = None, step: float = 1.0) -> DataFrame:
    """``l, r, similar, value``: the values of the pairs that solve the hinge-loss problem.

    Exclusivity only lowers values, so a pair whose own rules want 0 has 0 and takes nothing from others, and a pair without
    rivals among the rest has the value that its own rules want. Both are exact; ADMM solves what is contested, until it
    settles or, if given, for ``rounds`` rounds at most.
    """
    grounded, rules = ground(truth, weights)
    with Scratch(truth.sparkSession) as scratch:
        wanted = scratch.keep(grounded.withColumn("own", own_value(rules)), "wanted")
        hopeful = wanted.where(F.col("own") > 0)
        rivals = {side: hopeful.groupBy(side).agg(F.count(F.lit(1)).alias(f"n_{side}")) for side in ("l", "r")}
        counted = scratch.keep(hopeful.join(rivals["l"], "l").join(rivals["r"], "r"), "rivals")
        contested = (F.col("n_l") > 1) | (F.col("n_r") > 1)
        columns = ["l", "r", "similar"]
        solved = _admm(counted.where(contested).drop("own", "n_l", "n_r"), rules, rounds, step)
        alone = counted.where(~contested).select(*columns, F.col("own").alias("value"))
        return scratch.hand_over(solved.unionByName(alone).unionByName(wanted.where(F.col("own") <= 0).select(*columns, F.lit(0.0).alias("value"))), "values")


def _groups(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``group``, the least l that is reached through shared records: groups have no record in common."""
    with Scratch(pairs.sparkSession) as scratch:
        now = pairs.withColumn("group", F.col("l"))
        while True:
            by_l = now.groupBy("l").agg(F.min("group").alias("of_l"))
            by_r = now.groupBy("r").agg(F.min("group").alias("of_r"))
            least = F.least("of_l", "of_r")
            now = scratch.keep(now.join(by_l, "l").join(by_r, "r").withColumn("moved", least < F.col("group")).withColumn("group", least).drop("of_l", "of_r"), "groups")
            scratch.clear(but=1)
            if now.where("moved").isEmpty():
                return scratch.hand_over(now.drop("moved"), "groups")
            now = now.drop("moved")


def solve(points: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, start: np.ndarray, rounds: int | None = None, step: float = 1.0) -> np.ndarray:
    """The values of pairs by consensus ADMM: a row of ``points`` for each rule, the numbers of the pairs' two records.

    The rounds end when no copy is more than ``SETTLED`` from its mean (primal residual) and no mean moves by more (dual).
    """
    pull, up = np.abs(weights)[:, None] / step, weights[:, None] > 0
    sides = [(of, np.bincount(of)) for of in (left, right)]
    z, u, done = start.astype("float64"), np.zeros((len(weights) + 2, len(start))), 0
    while rounds is None or done < rounds:
        v = z - u
        own = v[:-2]
        x = np.where(up, np.maximum(own, np.minimum(own + pull, points)), np.minimum(own, np.maximum(own - pull, points)))
        once = [w - np.maximum((np.bincount(of, w) - 1) / n, 0.0)[of] for w, (of, n) in zip(v[-2:], sides)]
        x = np.vstack([x, *once])
        new = np.clip((x + u).mean(axis=0), 0.0, 1.0)
        u += x - new
        settled = np.abs(x - new).max() < SETTLED and step * np.abs(new - z).max() < SETTLED
        z, done = new, done + 1
        if settled:
            break
    return z.round(DECIMALS)


def _admm(grounded: DataFrame, rules: list[tuple[str, float]], rounds: int | None, step: float) -> DataFrame:
    """``l, r, similar, value`` of contested pairs. Groups of pairs that share records are solved many at once in one task;
    those of more than ``SOLVED_AT_ONCE`` pairs by rounds over all executors. Both go through the same values."""
    names, weights = [n for n, _ in rules], np.array([w for _, w in rules])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l", "r"])
        left, right = pd.factorize(rows["l"])[0], pd.factorize(rows["r"])[0]
        value = solve(rows[names].to_numpy("float64").T, weights, left, right, rows["up_numbered"].to_numpy(), rounds, step)
        return rows[["l", "r", "similar"]].assign(value=value)

    with Scratch(grounded.sparkSession) as scratch:
        groups = _groups(grounded)
        sizes = scratch.keep(groups.groupBy("group").agg(F.count(F.lit(1)).alias("pairs")), "sizes")
        large = sizes.where(F.col("pairs") > SOLVED_AT_ONCE).select("group")
        small = groups.join(large, "group", "left_anti")
        tasks = max(1, -(-(sizes.where(F.col("pairs") <= SOLVED_AT_ONCE).agg(F.sum("pairs")).first()[0] or 0) // SOLVED_AT_ONCE))
        solved = small.groupBy(F.pmod(F.xxhash64("group"), F.lit(tasks))).applyInPandas(one, "l bigint, r bigint, similar double, value double")
        if not large.isEmpty():
            solved = solved.unionByName(_admm_rounds(groups.join(large, "group", "left_semi"), rules, rounds, step))
        return scratch.hand_over(solved, "solved")


def _admm_rounds(pairs: DataFrame, rules: list[tuple[str, float]], rounds: int | None, step: float) -> DataFrame:
    """``l, r, similar, value``: :func:`solve` over all executors, for groups that no task should hold.

    Every round a pair improves its rules' copies by itself; the copies of exclusivity need the sums over a record, which are
    combined before they are shuffled. The state is written each round, so lost executors cost no more than that.
    """
    duals = [f"u_{n}" for n, _ in rules] + ["u_l", "u_r"]
    state = pairs.select("l", "r", "similar", *[n for n, _ in rules], F.col("up_numbered").alias("z"), *[F.lit(0.0).alias(u) for u in duals])
    with Scratch(pairs.sparkSession) as scratch:
        now, done = scratch.keep(state, "state"), 0
        while rounds is None or done < rounds:
            sums = {s: now.groupBy(s).agg(F.sum(F.col("z") - F.col(f"u_{s}")).alias(f"sum_{s}"), F.count(F.lit(1)).alias(f"n_{s}")) for s in ("l", "r")}
            met = now.join(sums["l"], "l").join(sums["r"], "r")
            copies: dict[str, Column] = {}
            for name, weight in rules:
                v, pull = F.col("z") - F.col(f"u_{name}"), abs(weight) / step
                copies[f"u_{name}"] = F.greatest(v, F.least(v + pull, F.col(name))) if weight > 0 else F.least(v, F.greatest(v - pull, F.col(name)))
            for s in ("l", "r"):
                copies[f"u_{s}"] = F.col("z") - F.col(f"u_{s}") - F.greatest((F.col(f"sum_{s}") - 1) / F.col(f"n_{s}"), F.lit(0.0))
            improved = met.withColumns({f"x_{u}": x for u, x in copies.items()})
            mean = sum((F.col(f"x_{u}") + F.col(u) for u in duals), F.lit(0.0)) / len(duals)
            averaged = improved.withColumn("new", F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))
            residual = F.greatest(*[F.abs(F.col(f"x_{u}") - F.col("new")) for u in duals], step * F.abs(F.col("new") - F.col("z")))
            columns = ["l", "r", "similar", *[n for n, _ in rules], F.col("new").alias("z"), *[(F.col(u) + F.col(f"x_{u}") - F.col("new")).alias(u) for u in duals]]
            now, done = scratch.keep(averaged.select(*columns, residual.alias("residual")), "state"), done + 1
            scratch.clear(but=1)
            if now.agg(F.max("residual")).first()[0] < SETTLED:
                break
            now = now.drop("residual")
        return scratch.hand_over(now.select("l", "r", "similar", F.round("z", DECIMALS).alias("value")), "solved")


def choose(values: DataFrame, least: float = 0.5) -> DataFrame:
    """The matches ``l, r, value``: pairs of at least that value that are the best of both their records.

    Ties go to the more similar pair and then to the lesser id.
    """
    rank = F.struct("value", "similar", -F.col("l"), -F.col("r")).alias("rank")
    good = values.where(F.col("value") >= least).withColumn("rank", rank)
    best_l = good.groupBy("l").agg(F.max("rank").alias("top_l"))
    best_r = good.groupBy("r").agg(F.max("rank").alias("top_r"))
    kept = good.join(best_l, "l").join(best_r, "r").where((F.col("rank") == F.col("top_l")) & (F.col("rank") == F.col("top_r")))
    return kept.select("l", "r", "value")


def link(left: DataFrame, right: DataFrame, identity: str = "source_id", weights: Weights = Weights(), least: float = 0.5) -> DataFrame:
    """``l, r, value``: records of two tables that describe the same thing, with the confidence of each match.

    The tables have ``identity`` (a number), title, original_title, alternative_titles, release_year and media_type; any of
    them may be null, and other columns are not read. An empty table has no matches. Records that nothing tells apart are
    one, of which the least id is linked; :func:`classes` has the ids of each.
    """
    with Scratch(left.sparkSession) as scratch:
        a, b = (scratch.keep(records(forms_of(side, identity)), "records") for side in (left, right))
        pairs = candidate_pairs(a, b, weights.needs_number(), weights.needs_year())
        truth = scratch.keep(evidence(pairs, a, b).where(F.col("similar") > LEAST_SIMILAR), "truth")
        return scratch.hand_over(choose(infer(truth, weights), least), "links")


def classes(df: DataFrame, identity: str = "source_id") -> DataFrame:
    """``id, class_id``: which records of a table nothing tells apart, as :func:`link` sees them; the least id is linked."""
    with Scratch(df.sparkSession) as scratch:
        forms = scratch.keep(forms_of(df, identity), "forms")
        return scratch.hand_over(members(forms, records(forms)), "classes")
