"""Lists in any container, staging of raw records, crawls, catalogues and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks import cli
from spoolworks.operators import audit, lists, predicates, questions, stats
from spoolworks.plans import catalogue
from spoolworks.sources import crawl, jsonl, rest, tables

TEXT = T.StringType()


def one(spark, value, schema):
    df = spark.createDataFrame([(value,)], f"v {schema}")
    return df.select(lists.as_list(F.col("v"), df.schema["v"].dataType)).first()[0]


@pytest.mark.parametrize(
    ("value", "schema", "want"),
    [
        ([" a", "", None, "b ", "  "], "array<string>", ["a", "b"]), (None, "array<string>", []), ([], "array<string>", []), ([3, None], "array<int>", ["3"]), ([["x"]], "array<array<string>>", []),
        ('["Fantasy", " Adventure", "", null]', "string", ["Fantasy", "Adventure"]), ("[]", "string", []), (" Drama ", "string", ["Drama"]), ("", "string", []), (None, "string", []),
        ('["cut"', "string", ['["cut"']), ("[cut]", "string", ["[cut]"]), ('["a"] ["b"]', "string", ['["a"] ["b"]']), ("[1, 2]", "string", ["1", "2"]), (2.5, "double", []),
    ],
)
def test_any_container(spark, value, schema, want):
    assert one(spark, value, schema) == want


def test_entities_with_json_lists(spark):
    rows = [("cm_123", '["Fantasy", "Adventure"]', '["JP"]', 2001.0), ("b", "[broken", None, None), ("c", "[broken]", "JP", 1.0), ("d", None, "[]", 2.0)]
    df = lists.load_entities(spark.createDataFrame(rows, "entity_id string, genres string, origin_country string, release_year double"))
    got = {r.entity_id: (r.genres, r.origin_country) for r in df.collect()}
    assert got == {"cm_123": (["Fantasy", "Adventure"], ["JP"]), "b": (["[broken"], None), "c": ([], ["JP"]), "d": (None, [])}
    state = {r[0]: r[1] for r in df.select("entity_id", predicates.state(df, "genres", "contains", "fant")).collect()}
    assert state["cm_123"] == predicates.KNOWN_FALSE  # a list's elements, not parts of its text
    state = {r[0]: r[1] for r in df.select("entity_id", predicates.state(df, "genres", "contains", "fantasy")).collect()}
    assert state == {"cm_123": predicates.KNOWN_TRUE, "b": predicates.KNOWN_FALSE, "c": predicates.UNKNOWN, "d": predicates.UNKNOWN}


def test_samples_by_hash(spark):
    df = spark.range(500).selectExpr("CAST(id AS STRING) AS entity_id", "'x' AS title")
    pick = lambda frame, n, **more: {r.entity_id for r in lists.load_entities(frame, n, **more).collect()}
    assert pick(df, 50) == pick(df.repartition(7), 50) != pick(df, 50, seed=1) and len(pick(df, 50)) == 50 and len(pick(df, 900)) == 500


def test_staging_of_raw_records(spark, tmp_path):
    columns = {
        "line_no": "bigint", "id": "bigint", "title": "string", "alternative_titles": "string", "media_type": "string", "start_date": "string", "end_date": "string", "start_season": "string", "genres": "string",
        "studios": "string", "synopsis": "string", "mean": "double", "num_scoring_users": "bigint", "popularity": "bigint", "rank": "bigint", "num_favorites": "bigint", "num_list_users": "bigint", "status": "string",
        "average_episode_duration": "bigint", "num_episodes": "bigint", "source": "string", "_strategy": "string", "_query": "string",
    }
    base = dict.fromkeys(columns)
    rows = [
        base | {"line_no": 2, "id": 7, "title": "T", "alternative_titles": '{"en": "E", "ja": "J", "synonyms": ["s", null]}', "media_type": "tv", "start_season": '"{\\"year\\": 1999}"', "genres": '[{"name": "A"}, "B"]', "studios": '[{"node": {"name": "S"}}]', "_strategy": "rank"},
        base | {"line_no": 5, "id": 7, "title": "late", "_strategy": "search"}, base | {"line_no": 1, "id": None, "title": "none"}, base | {"line_no": 3, "id": 8, "title": "U", "start_date": "2001-02", "genres": "[broken", "_strategy": None},
    ]
    schema = ", ".join(f"{n} {t}" for n, t in columns.items())
    spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema).write.parquet(f"{tmp_path}/discovery.parquet")
    got = {r.source_id: r for r in catalogue.staged_discovery_rows(spark, str(tmp_path)).collect()}
    a, b = got[7], got[8]
    assert set(got) == {7, 8} and a.title == "T" and a.original_title == "J" and a.alternative_titles == ["E", "s"] and a.release_year == 1999 and a.media_type == "anime_tv"
    assert a.genres == ["A", "B"] and a.studios == ["S"] and a.discovered_from == ["rank", "search"]
    assert b.release_year == 2001 and b.genres == [] and b.discovered_from == ["unknown"] and b.original_title == "U"


def test_quality_sections_and_means(spark):
    df = spark.createDataFrame([("a", ["x", "y"], 1.0, 2.0), (None, [], 3.0, 1.0), ("a", None, float("nan"), 1.0)], "t string, g array<string>, v double, w double")
    assert {r.field: (r.total, r.present) for r in audit.field_quality(df, ["t", "g", "absent"]).collect()} == {"t": (3, 2), "g": (3, 1)}
    rows = {(r.section, r.item): (r.n, r.place) for r in audit.sections(df, {"t": F.col("t")}, {"g": "g"}, 1).collect()}
    assert rows == {("t", "a"): (2, 1), ("g", "x"): (1, 1)}
    means = stats.weighted_mean(df, "v", "w").first()
    assert (means.sample, means.reweighted) == (2.0, pytest.approx(5 / 3)) and stats.weighted_mean(df.limit(0), "v", "w").first().reweighted is None


def test_catalogue_round_trip_and_access(spark, tmp_path):
    q = [questions.Question("a?", "media_type", "equals", "movie", "media"), questions.Question("b?", "release_year", "greater_than", 2000, "time"), questions.Question("c?", "genres", "contains", "Drama", "genre")]
    frame = questions.to_frame(spark, q)
    questions.save(frame, f"{tmp_path}/c.parquet", f"{tmp_path}/c.json")
    for name in ("c.parquet", "c.json"):
        assert questions.from_frame(questions.load(spark, f"{tmp_path}/{name}")) == q
    assert questions.by_id(q, q[1].question_id) is q[1] and questions.by_id(q, "q_none") is None and questions.by_family(q, "genre") == [q[2]]
    again = questions.Question("again?", "media_type", "equals", "movie", "media")
    assert questions.added(q, again) == [again, *q[1:]]



def test_crawls_resume_and_count(spark, tmp_path):
    class Source(rest.RestSource):
        client = lambda **_: rest.Client(lambda u, p, h: {"results": [{"id": p["year"] * 10 + p["page"]}, {"id": 1}], "total_pages": 2}, delay=0)

        @classmethod
        def name(cls):
            return "recorded"

    spark.dataSource.register(Source)
    tasks, progress, target = crawl.low_popularity_tasks(spark, [2000, 2001], ["m"]), crawl.Progress(spark, f"{tmp_path}/progress"), f"{tmp_path}/records"
    assert progress.pending(tasks).count() == 2 and progress.latest().isEmpty()
    progress.append(spark.createDataFrame([("low:2000:m", 1, False, 2, 1)], "task_key string, page int, complete boolean, total bigint, new bigint"))
    assert {r.task_key: r.first for r in progress.pending(tasks).collect()} == {"low:2000:m": 2, "low:2001:m": 1}
    assert crawl.crawl(spark, tasks, progress, target, "recorded", endpoint="u") == 4  # 20002, 20011, 20012 and 1
    assert crawl.crawl(spark, tasks, progress, target, "recorded", endpoint="u") == 0 and progress.pending(tasks).isEmpty()
    with open(f"{tmp_path}/progress/damaged.json", "w") as file:
        file.write('{"task_key": "low:2001:m", "page"\nnot json\n')
    row = progress.by_strategy(tasks).first()
    assert (row.tasks, row.complete, row.total, row.new) == (2, 2, 8, 5)


def test_search_tasks_and_enrichment(spark, tmp_path):
    words = spark.createDataFrame([("Abc ",), ("ab",), (None,), ("abc",)], "w string")
    assert [(r.task_key, json.loads(r.params)) for r in crawl.search_tasks(words, "w").collect()] == [("search:abc", {"q": "abc"})]

    def fetch(key):
        if key == 2:
            raise OSError("gone")
        return [f"k{key}"]

    keys, target = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "source_id bigint"), f"{tmp_path}/keywords"
    assert crawl.enrich_by_key(keys, "source_id", fetch, "keywords", target, most=2) == 2 and crawl.enrich_by_key(keys, "source_id", fetch, "keywords", target) == 1
    assert crawl.enrich_by_key(keys, "source_id", fetch, "keywords", target) == 0
    assert {r.source_id: r.keywords for r in spark.read.parquet(target).collect()} == {1: ["k1"], 2: [], 3: ["k3"]}


def test_runs_stop_between_steps():
    stop = crawl.Stop()
    assert crawl.run_all([("a", lambda: 1), ("b", lambda: stop(2, None) and 5), ("c", lambda: 9)], stop) == {"a": 1, "b": 5}
    with pytest.raises(KeyboardInterrupt):
        stop(2, None)


def test_command_line_has_every_job(tmp_path):
    top = cli.parser()
    more = {"discover": ["--endpoints", "u", "--target", "t"], "enrich": ["--endpoint", "u/{}", "--target", "t"], "query": ["p2_found"]}
    for name in cli.JOBS:
        assert top.parse_args(["--root", "r", name, *more.get(name, [])]).job == name


def test_jobs_write_their_tables(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    cli.main(["--root", root, "--output", f"{tmp_path}/a", "--output", f"{tmp_path}/b", "--format", "json", "analytics", "--canonical", "3"])
    checks = spark.read.json(f"{tmp_path}/b/checks")
    assert checks.count() == 12 and spark.read.json(f"{tmp_path}/a/view_all").count() > 100 and not spark.read.json(f"{tmp_path}/a/report").isEmpty()
    cli.main(["--root", root, "--output", f"{tmp_path}/p", "process", "--raw"])
    assert spark.read.parquet(f"{tmp_path}/p").where("source != 'tmdb'").count() > 0
    cli.main(["--root", root, "--output", f"{tmp_path}/e", "--format", "csv", "export"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/e/entities").count() > 100
    cli.main(["--root", root, "--output", f"{tmp_path}/g", "normalize-genres"])
    assert "genres" in spark.read.parquet(f"{tmp_path}/g").columns
    assert jsonl.read_lines(spark, f"{tmp_path}/a/checks").count() == 12


def test_folders_and_lookups(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "id int, name string").write.parquet(f"{tmp_path}/genres.parquet")
    row = tables.inspect(spark, str(tmp_path)).first()
    assert (row.name, row.rows) == ("genres", 4) and row.bytes > 0 and tables.inspect(spark, f"{tmp_path}/absent").isEmpty()
    assert tables.lookup(spark, f"{tmp_path}/genres.parquet", "id", "name") == {1: "a", 2: "c"}
    with pytest.raises(ValueError):
        tables.lookup(spark, f"{tmp_path}/genres.parquet", "id", "name", most=1)


@pytest.mark.parametrize(("d", "n", "m"), [(0.0, 5, 5), (0.1, 100, 80), (0.5, 30, 40), (0.03, 5000, 2000), (1.0, 10, 10)])
def test_p_value_as_a_column(spark, d, n, m):
    assert spark.range(1).select(stats.p_value(F.lit(d), F.lit(n), F.lit(m))).first()[0] == pytest.approx(stats.ks_p_value(d, n, m))
