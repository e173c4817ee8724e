"""Normalisation, linking, sampling, statistics, sources and streaming."""

from __future__ import annotations

import difflib
import inspect
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from spoolworks.operators import audit, normalize, resolve, stats, strata
from spoolworks.plans import pipeline
from spoolworks.session import Scratch
from spoolworks.sources import jsonl, rest
from spoolworks.streaming import ingest


def test_keep_first_and_merge(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (2, 2, None), (None, 1, "z"), (1, 5, "y")], "id int, pos int, s string")
    assert {tuple(r) for r in normalize.keep_first(df, ["id"], ["pos"]).collect()} == {(1, 1, "y"), (2, 2, None)}
    assert {r.id: r["values"] for r in normalize.merge_in_order(df, "id", "s", "pos").collect()} == {1: ["y", "x"]}


def test_genres_years_and_groups(spark):
    df = spark.createDataFrame([(["Action & Adventure", " Sci-Fi ", None, "", "Action", "Odd"], "20", 1899), (None, "1999-12", 1994), ([], "x123", None)], "g array<string>, d string, y int")
    rows = df.select(normalize.unify_genres(F.col("g")).alias("g"), normalize.year_of(F.col("d"), F.lit("2005")).alias("y"), normalize.decade_label(F.col("y")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [(["Action", "Adventure", "Science Fiction", "Odd"], 2005, "Pre-1900"), ([], 1999, "1990s"), ([], 2005, "Unknown")]
    years = spark.createDataFrame([(y,) for y in (0, 1950, 1951, 2026, 2027, None)], "y int").select(normalize.year_bin(F.col("y")))
    assert [r[0] for r in years.collect()] == ["Before 1950", "Before 1950", "1950-1969", "2020+", None, None]


def test_combining_marks_that_compose_to_nothing_are_blanks(spark):
    df = spark.createDataFrame([("हिन्दी",), ("Cafe\u0301",), ("ย่าม!",), (None,)], "t string")
    got = [r[0] for r in df.select(normalize.normalize_title(F.col("t"))).collect()]
    assert got == ["ह न द", "café", "ย าม", ""]


def test_titles(spark):
    df = spark.createDataFrame([("Ｔｈｅ  Show: Part 2!",), ("Season 3 — 2nd Season",), (None,), ("Final MOVIE",)], "t string")
    rows = df.select(normalize.normalize_title(F.col("t")).alias("n")).withColumn("m", normalize.title_modifiers(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("the show part 2", ["num_2", "part_2"]), ("season 3 2nd season", ["num_3", "season_2", "season_3"]), ("", []), ("final movie", ["final", "movie"])]


def test_stage_first(spark):
    raw = spark.createDataFrame(
        [(1, "T", None, "O", None, "2001-02-03", None, [28, None, 99], "movie"), (2, None, "N", None, "M", None, "", None, "tv")],
        "id bigint, title string, name string, original_title string, original_name string, release_date string, first_air_date string, genre_ids array<bigint>, _media_type string",
    ).withColumns({c: F.lit(None).cast(t) for c, t in {"original_language": "string", "origin_country": "array<string>", "overview": "string", "vote_average": "double", "vote_count": "bigint", "popularity": "double", "_strategy": "string"}.items()})
    a, b = normalize.stage_first(raw, {28: "Action"}).orderBy("source_id").collect()
    assert (a.title, a.release_year, a.genres, a.discovered_from, a.studios) == ("T", 2001, ["Action", "Unknown(99)"], ["unknown"], [])
    assert (b.title, b.original_title, b.release_date, b.release_year) == ("N", "M", None, None)


def test_stage_second(spark):
    schema = ("id bigint, title string, alternative_titles struct<en:string,ja:string,synonyms:array<string>>, media_type string, start_date string, end_date string, start_season struct<year:string>, "
              "genres array<struct<name:string>>, studios array<struct<name:string>>, synopsis string, mean double, num_scoring_users bigint, popularity bigint, rank bigint, num_favorites bigint, num_list_users bigint, status string, average_episode_duration bigint, num_episodes bigint, source string, _strategy string")  # fmt: skip
    row = (1, "T", ("E", "", ["S"]), "tv", "", None, ("1998",), [("G",), ("",)], None, None, 7.5, 3, 4, 5, 6, 7, "done", 1500, 12, "manga", "ranking")
    one = normalize.stage_second(spark.createDataFrame([row], schema)).first()
    assert (one.original_title, one.alternative_titles, one.media_type, one.release_year, one.genres, one.studios, one.runtime) == ("T", ["E", "S"], "anime_tv", 1998, ["G"], [], 1500.0)


def staged(spark, rows):
    schema = "source_id bigint, title string, original_title string, alternative_titles array<string>, release_year int, media_type string, genres array<string>, original_language string, origin_country array<string>, popularity double, source string"
    return spark.createDataFrame([(i, t, None, [], y, m, ["Animation"], "ja", [], 1.0, s) for i, t, y, m, s in rows], schema)


def test_linking_and_canonical_table(spark):
    first = staged(spark, [(1, "Alpha Show", 2000, "tv", "tmdb"), (2, "Beta!", 2001, "movie", "tmdb"), (3, "Gamma Delta Story", 2003, "tv", "tmdb"), (4, "Lone", 1990, "tv", "tmdb")])
    second = staged(spark, [(11, "alpha show", 2001, "anime_tv", "mal"), (12, "Beta", 2001, "anime_tv", "mal"), (13, "Gamma Delta Storry", 2003, "anime_tv", "mal"), (14, "Other", 1990, "ova", "mal")])
    links = {(r.l, r.r): (r.match_confidence, r.match_method) for r in resolve.link_tables(first, second).collect()}
    assert links == {(1, 11): ("high", "exact_title"), (2, 12): ("medium", "exact_title"), (3, 13): ("medium", "fuzzy_title")}
    one = spark.createDataFrame([(1, 11, "high")], "l bigint, r bigint, match_confidence string")
    rows = {r.entity_id: r for r in resolve.canonical(first, second, one).collect()}
    assert len(rows) == 7 and rows["tmdb_1_mal_11"].media_type == "anime_tv" and rows["tmdb_1_mal_11"].source_presence == ["tmdb", "mal"] and rows["mal_14"].match_confidence == "unmatched"


def sequential(edges):
    """Record by record, as the reference states it."""
    held, out = set(), set()
    for l in sorted({e[0] for e in edges}):
        free = [e for e in edges if e[0] == l and e[1] not in held]
        if free:
            best = max(free, key=lambda e: (e[2], -e[1]))
            out.add(best)
            if best[2] >= 2:
                held.add(best[1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_assignment_equals_going_record_by_record(spark, seed):
    rng = random.Random(seed)
    edges = [(l, r, rng.randint(1, 3)) for l in range(9) for r in range(20, 27) if rng.random() < 0.4]
    got = {tuple(x) for x in resolve.assign(spark.createDataFrame(edges, "l bigint, r bigint, rank int"), ("rank",)).select("l", "r", "rank").collect()}
    assert got == sequential(edges)


def test_ratio_is_the_library_s(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), ("x" * 300, "y" + "x" * 250)], "a string, b string")
    assert [r[0] for r in df.select(resolve.ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in df.collect()]


def test_enrich_multiplies_nothing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    extra = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "k int, w array<string>")
    assert sorted((r.k or 0, tuple(r.w)) for r in resolve.enrich(df, extra, "k", ("w",)).collect()) == [(0, ()), (1, ("a",)), (1, ("a",)), (2, ())]


def in_turns(available, target):
    """Quotas by dealing what is left over one row at a time, in turns."""
    given = {g: min(available.get(g, 0), int(target * share)) for g, share in strata.SHARES.items()}
    while sum(given.values()) < min(target, sum(available.values())):
        for g in given:
            if given[g] < available.get(g, 0) and sum(given.values()) < target:
                given[g] += 1
    return given


def test_quotas():
    assert strata.quotas({"movie": 100, "tv": 5, "anime": 100, "other": 0}, 100) == {"movie": 53, "tv": 5, "anime": 42, "other": 0}
    assert strata.quotas({}, 10) == dict.fromkeys(strata.SHARES, 0) and strata.quotas({"tv": 3}, 0)["tv"] == 0
    for seed in range(500):
        rng = random.Random(seed)
        available = {g: rng.randrange(60) for g in strata.SHARES}
        target = rng.randrange(120)
        assert strata.quotas(available, target) == in_turns(available, target)


def test_sample_respects_targets(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.choice(["movie", "tv", "ova", "x"]), rng.choice([None, 1990, 2005]), rng.choice(["en", "ja", None, "qq"])) for i in range(900)]
    df = spark.createDataFrame(rows, "entity_id string, media_type string, release_year int, original_language string")
    given = strata.quotas(strata.group_counts(df), 300)
    targets = {(r.media_group, r.decade, r.lang_group): (r.size, r.target) for r in strata.stratum_targets(df, given).collect()}
    sample = strata.sample_diverse(df, 300)
    for r in sample.groupBy("media_group", "decade", "lang_group").count().collect():
        assert r["count"] == min(targets[r.media_group, r.decade, r.lang_group])
    assert strata.sample_diverse(df, 900).count() == 900 and sample.count() <= 300


def test_distances_and_quantiles(spark):
    rng = random.Random(2)
    a, b = [rng.gauss(0, 1) for _ in range(700)] + [1.0] * 300, [rng.gauss(0.5, 2) for _ in range(400)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, math.nan]], "v double")
    got = stats.distances(frame(a), frame(b), "v").first()
    points = sorted({*a, *b})
    cdf = lambda xs, p: sum(x <= p for x in xs) / len(xs)
    gaps = [abs(cdf(a, p) - cdf(b, p)) for p in points]
    assert got.ks == pytest.approx(max(gaps)) and got.wasserstein == pytest.approx(sum(g * (q - p) for g, p, q in zip(gaps, points, points[1:])))
    assert stats.ks_p_value(0.0, 50, 50) == 1.0 and stats.ks_p_value(0.9, 500, 500) < 1e-6 and stats.ks_p_value(0.5, 0, 3) == 1.0
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 2.0)], "v double, w double")
    want = {0.0: 1.0, 0.25: 1.5, 0.5: 2 + 2 * (0.5 - 0.375) / 0.375, 1.0: 4.0}
    assert {r.quantile: pytest.approx(r.value) for r in stats.weighted_quantiles(rows, "v", "w", list(want)).collect()} == want


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (2, "x")], "a int, b string")
    assert {r.name: r.duplicates for r in audit.duplicates(df, {"ab": ["a", "b"]}).collect()} == {"ab": 1}


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n[1]\n{"t": "no id"}\n{"id": 1, "t": "again"}\n{"id": 2}\n')
    lines = jsonl.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [(r.id, r.t) for r in jsonl.parse(lines, "id bigint, t string").orderBy("line_no").collect()] == [(1, "x"), (None, "no id"), (1, "again"), (2, None)]
    row = jsonl.profile(lines).first()
    assert (row.lines, row.unique_ids, row.duplicate_ids, row.null_ids, row.malformed) == (6, 2, 1, 1, 2)
    records = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "id bigint, t string")
    target = str(tmp_path / "out")
    assert jsonl.append_new(records, target) == 2 and jsonl.append_new(records, target) == 0
    assert jsonl.append_new(spark.createDataFrame([(3, "w")], "id bigint, t string"), target) == 1


def test_rest_client_waits_and_gives_up():
    waits, answers = [], [rest.HttpError(429, 7), rest.HttpError(500), ConnectionError(), {"results": [1], "total_pages": 1}]

    def get(url, params, headers):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    client = rest.Client(get, delay=0, sleep=waits.append, clock=lambda: 0.0)
    assert list(rest.pages(client, "u", {})) == [1] and waits == [7, 4.0, 8.0]
    answers += [rest.HttpError(404)]
    with pytest.raises(rest.HttpError):
        client.fetch("u", {})
    answers += [rest.HttpError(503)] * 6
    waits.clear()
    with pytest.raises(RuntimeError):
        client.fetch("u", {})
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0, 60.0]


def test_rest_paging():
    book = {1: [1, 2], 2: [3], 3: []}
    numbered = rest.Client(lambda u, p, h: {"results": book[p["page"]]}, delay=0)
    assert list(rest.pages(numbered, "u", {})) == [1, 2, 3] and list(rest.pages(numbered, "u", {}, most=1)) == [1, 2]
    by_offset = rest.Client(lambda u, p, h: {"data": [{"node": p["offset"]}], "paging": {"next": "x"} if p["offset"] < 200 else {}}, delay=0)
    assert list(rest.offsets(by_offset, "u", {})) == [0, 100, 200]
    made = []
    client = lambda of: lambda **options: made.append(options) or of
    read = lambda of, **options: [r for reader in [rest.RestReader(options, client(of))] for t in reader.partitions() for r in reader.read(t)]
    tasks = json.dumps([{"key": "k", "params": {"a": 1}}, {"key": "l", "endpoint": "v", "first": 2}])
    got = read(numbered, tasks=tasks, endpoint="u", headers='{"X": "y"}', token="t", delay="0.5", parallel="2")
    assert got == [("k", "1"), ("k", "2"), ("k", "3"), ("l", "3")] and made[0] == {"headers": {"X": "y", "Authorization": "Bearer t"}, "delay": 1.0}
    many = rest.Client(lambda u, p, h: {"data": [{"node": p["offset"]}], "paging": {"next": "x"} if p["offset"] < 900 else {}}, delay=0)
    assert len(read(many, tasks='[{"key": "k"}]', endpoint="u", paging="offset")) == 10
    assert len(read(many, tasks='[{"key": "k", "first": 500}]', endpoint="u", paging="offset", most="800")) == 3


def test_rest_source_in_spark(spark):
    class Recorded(rest.RestSource):  # a source whose client needs no network
        client = lambda **_: rest.Client(lambda u, p, h: {"results": [f"{u}{p['page']}"], "total_pages": 2}, delay=0)

    spark.dataSource.register(Recorded)
    rows = spark.read.format("rest").options(endpoint="u", tasks='[{"key": "a"}, {"key": "b", "endpoint": "v"}]').load().collect()
    assert sorted(map(tuple, rows)) == [("a", '"u1"'), ("a", '"u2"'), ("b", '"v1"'), ("b", '"v2"')]


def test_streaming_ingest_is_incremental(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = spark.createDataFrame([], "id bigint, t string").schema

    def run():
        ingest.ingest(ingest.first_seen(ingest.stream_records(spark, source, schema), "id"), target, check).awaitTermination(120)
        return spark.read.parquet(target).count()

    spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], schema).write.mode("append").json(source)
    assert run() == 1
    spark.createDataFrame([(1, "d"), (2, "e")], schema).write.mode("append").json(source)
    assert run() == 2


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    source, target, late, check = (str(tmp_path / n) for n in ("in", "out", "late", "check"))
    schema = spark.createDataFrame([], "id bigint, at timestamp").schema

    def run(rows):
        spark.sql("SELECT " + " UNION ALL SELECT ".join(f"{i}L AS id, {f"TIMESTAMP'2024-01-{d:02}'" if d else 'CAST(NULL AS TIMESTAMP)'} AS at" for i, d in rows)).write.mode("append").json(source)
        ingest.ingest_apart(ingest.stream_records(spark, source, schema), "at", "3 days", target, late, check).awaitTermination(120)
        return tuple({r.id for r in spark.read.parquet(p).collect()} for p in (target, late))

    assert run([(1, 1), (2, 10)]) == ({1, 2}, set())  # the first batch has none before it
    assert run([(3, 7), (4, 6), (5, None), (6, 20)]) == ({1, 2, 3, 5, 6}, {4})
    assert run([(7, 12)]) == ({1, 2, 3, 5, 6}, {4, 7})


def test_tasks(spark):
    assert audit.year_tasks(spark, 2000, 2001).count() == 4 and audit.genre_tasks(spark, [1, 2], [1990], ["tv"]).count() == 2


def test_validator_sees_faults(spark):
    schema = "entity_id string, source string, tmdb_id bigint, mal_id bigint, release_date string"
    good = spark.createDataFrame([("a", "tmdb", 1, None, None), ("b", "mal", None, 2, "x"), ("c", "tmdb+mal", 3, 4, "x")], schema)
    views, expected = audit.views(good), {"shared": 1, "null_dates": 1, "canonical": 3}
    failed = lambda v, sample=good, canonical=good: {r.name for r in audit.validate(v, sample, canonical, expected).collect() if not r.passed}
    assert failed(views) == set()
    bad = good.unionByName(spark.createDataFrame([("a", "odd", 1, None, None)], schema))
    assert failed(audit.views(bad)) == {"rows_equal_sample", "ids_unique", "null_dates", "inclusion"}
    assert failed(views | {"second": good.where("entity_id = 'b'")}) == {"shared_in_both", "inclusion"}  # a shared row that one view lacks
    assert failed(views | {"shared": good.where("entity_id = 'a'")}) == {"shared_in_both"}
    twice = good.unionByName(good.where("entity_id = 'c'"))
    assert {"first_ids_unique", "second_ids_unique", "tmdb_id_unique", "mal_id_unique", "shared_count"} <= failed(audit.views(twice))
    assert failed(views, canonical=good.where("entity_id != 'a'")) == {"ids_in_canonical", "canonical_count"}
    empty = audit.views(good.limit(0))
    assert failed(empty) == {"rows_equal_sample", "shared_count", "null_dates"}
    assert {r.view: r.rows for r in audit.view_counts(good).collect()} == {"all": 3, "first": 2, "second": 2, "shared": 1}


def test_queries_are_registered():
    assert set(pipeline.SQL) <= set(pipeline.QUERIES)


def test_assignment_of_a_hot_title_has_no_limit_of_rounds(spark):
    assert "most_rounds" not in inspect.signature(resolve.assign).parameters
    edges = spark.createDataFrame([(i, 10 + j, 3) for i in range(4) for j in range(4)], "l bigint, r bigint, rank int")
    assert {(r.l, r.r) for r in resolve.assign(edges, ("rank",)).collect()} == {(i, 10 + i) for i in range(4)}


def test_assignment_of_a_hot_title_takes_few_rounds(spark, monkeypatch):
    rounds, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: (rounds.append(label), keep(self, df, label))[1])
    edges = spark.range(40).crossJoin(spark.range(60).withColumnRenamed("id", "r")).selectExpr("id AS l", "100 + r AS r", "3 AS rank")
    assert {(r.l, r.r) for r in resolve.assign(edges, ("rank",)).collect()} == {(i, 100 + i) for i in range(40)}
    assert rounds.count("picks") <= 2


@pytest.mark.parametrize("joined", ["true", "false"])
def test_running_sums_and_percentiles_of_a_hot_value(spark, joined):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)  # with "false" there are several ranges
    values = [0.0] * 400 + [float(i % 37) for i in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    got = stats.running(df.withColumn("w", F.lit(1)), "v", ["w"], ["k"]).orderBy("v", "k").collect()
    assert [r.upto_w for r in got] == list(range(1, 601)) and [r.next_value for r in got] == [*sorted(values)[1:], None]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))))).first()[0]
    row = stats.describe(df, "v").first()
    assert [row.p25, row.p50, row.p75, row.p90, row.p95, row.p99] == pytest.approx(want) and row.n == 600
    assert stats.describe(df.limit(0), "v").first().p50 is None
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
