"""Command line: run a registered query, or the jobs of the catalogue pipeline, on a data folder."""

from __future__ import annotations

import argparse
import signal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolworks.operators import audit, lists, normalize, questions, resolve, simulate, strata
from spoolworks.plans import catalogue, figures, guesser, pipeline, records
from spoolworks.session import Scratch, build_session
from spoolworks.sources import crawl, rest
from spoolworks.sources.tables import inspect, table

#: Seed of the benchmark's sample, the reference's.
SAMPLE_SEED = 42


def _second(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The staging rows of the second source: those of the folder, or with ``--raw`` made anew out of its raw records."""
    return catalogue.staged_discovery_rows(spark, a.root) if a.raw else table(spark, a.root, "mal_normalized")


def _match(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return resolve.link_tables(table(spark, a.root, "tmdb_normalized"), _second(spark, a))


def _process(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    links = _match(spark, a).where("match_confidence IN ('high', 'medium')")
    return resolve.canonical(table(spark, a.root, "tmdb_normalized"), _second(spark, a), links)


def _discover(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    spark.dataSource.register(rest.RestSource)
    progress = crawl.Progress(spark, f"{a.target}-progress")
    years = range(a.years[0], a.years[1] + 1)
    strategies = {
        "low_popularity": lambda: crawl.low_popularity_tasks(spark, years, a.endpoints), "ranking": lambda: crawl.ranking_tasks(spark, a.rankings, a.endpoints[0]),
        "search": lambda: crawl.search_tasks(catalogue.search_vocabulary(spark, a.root), "word", a.endpoints[0]),
    }
    options = {"paging": a.paging, "token": a.token or "", "endpoint": a.endpoints[0]}
    stop = crawl.Stop()
    signal.signal(signal.SIGINT, stop)
    tasks = {name: strategies[name]() for name in a.strategies}
    crawl.run_all([(name, lambda of=of: crawl.crawl(spark, of, progress, a.target, **options)) for name, of in tasks.items()], stop)
    return progress.by_strategy(reduce(DataFrame.unionByName, tasks.values()))


def _enrich(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    address, field = a.endpoint, a.field

    def fetch(key: int) -> list[str]:
        return [x["name"] for x in rest.Client().fetch(address.format(key), {})[field]]

    crawl.enrich_by_key(table(spark, a.root, a.table).select("source_id"), "source_id", fetch, a.field, a.target, a.most)
    return spark.read.parquet(a.target).orderBy("source_id")


def _genres(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = lists.parse_lists(table(spark, a.root, "canonical_entities"))
    return rows.withColumn("genres", normalize.unify_genres(F.col("genres")))


def _audit(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    names = ("raw_profile", "strategy_contribution", "top_queries", "duplicate_counts", "data_dictionary", "range_violations", "percentiles", "smd", "ks_wasserstein", "design_weights", "weighted_quantiles")
    more = ("quality_fields", "group_summary", "reweighted_mean")
    return {n: (pipeline.QUERIES | figures.QUERIES)[n](spark, a.root) for n in names} | {n: catalogue.QUERIES[n](spark, a.root) for n in more}


def _export(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {"entities": pipeline.canonical_rows(spark, a.root), "summary": figures.export_summary(spark, a.root)}


def _analytics(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    rows = pipeline.canonical_rows(spark, a.root)
    views = audit.views(rows)
    checks = audit.validate(views, rows, rows, {"shared": a.shared, "null_dates": a.null_dates, "canonical": a.canonical})
    return {f"view_{n}": v for n, v in views.items()} | {"checks": checks, "report": catalogue.development_report(spark, a.root)}


def _sample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return strata.sample_diverse(pipeline.canonical_rows(spark, a.root), a.target)


def _status(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {"tables": inspect(spark, a.root), "views": audit.view_counts(pipeline.canonical_rows(spark, a.root))}


def _population(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    entities = guesser.universe(spark, a.root)
    # the smallest hashes are a draw from all sources; the order of ids would take one source first
    return lists.load_entities(entities, a.sample, seed=SAMPLE_SEED)


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    entities = _population(spark, a)
    found = questions.qualify(entities, questions.generate(entities))
    if a.inspect:
        frame = questions.to_frame(spark, found)
        return questions.ranked(questions.split_scores(questions.answer_counts(entities, found)), frame).limit(a.inspect)
    results = simulate.run_games(entities, found, a.policies, a.seeds, a.games, a.most, a.mode)
    return simulate.summary(results, entities.count()) if a.json else simulate.rates(results)


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    known = records.QUERIES | guesser.QUERIES | pipeline.QUERIES | figures.QUERIES | catalogue.QUERIES
    return known[a.name](spark, a.root)


JOBS = {
    "discover": _discover, "enrich": _enrich, "normalize-genres": _genres, "process": _process, "match": _match, "audit": _audit, "sample": _sample, "status": _status,
    "export": _export, "analytics": _analytics, "benchmark": _benchmark, "query": _query,
}


def parser() -> argparse.ArgumentParser:
    """The command line's parser."""
    top = argparse.ArgumentParser(prog="spoolworks", description=__doc__)
    top.add_argument("--root", required=True, help="folder of the Parquet tables")
    top.add_argument("--output", action="append", help="folder to write the result to, once or more often; by default it is shown")
    top.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("status", "normalize-genres", "audit", "export"):
        jobs.add_parser(name)
    for name in ("match", "process"):
        jobs.add_parser(name).add_argument("--raw", action="store_true", help="stage the second source from its raw records")
    discover = jobs.add_parser("discover")
    discover.add_argument("--strategies", nargs="+", default=["low_popularity"], choices=("low_popularity", "ranking", "search"))
    discover.add_argument("--endpoints", nargs="+", required=True, help="addresses of the collections")
    discover.add_argument("--target", required=True, help="folder of the records; the progress lies beside it")
    discover.add_argument("--years", type=int, nargs=2, default=[1900, 2026])
    discover.add_argument("--rankings", nargs="+", default=["all"])
    discover.add_argument("--paging", choices=("page", "offset"), default="page")
    discover.add_argument("--token")
    enrich = jobs.add_parser("enrich")
    enrich.add_argument("--endpoint", required=True, help="address of a record, {} standing for its id")
    enrich.add_argument("--table", default="tmdb_normalized")
    enrich.add_argument("--field", default="keywords")
    enrich.add_argument("--target", required=True)
    enrich.add_argument("--most", type=int)
    analytics = jobs.add_parser("analytics")
    for name in ("--shared", "--null-dates", "--canonical"):
        analytics.add_argument(name, type=int, default=0, help="the number that the checks expect")
    jobs.add_parser("query").add_argument("name")
    jobs.add_parser("sample").add_argument("--target", type=int, default=100_000)
    games = jobs.add_parser("benchmark")
    games.add_argument("--games", type=int, default=1000)
    games.add_argument("--seeds", type=int, nargs="+", default=[42, 123, 999])
    games.add_argument("--policies", nargs="+", default=list(simulate.POLICIES), choices=simulate.POLICIES)
    games.add_argument("--most", type=int, default=25, help="questions of a game at most")
    games.add_argument("--mode", choices=("uniform", "popularity"), default="uniform")
    games.add_argument("--sample", type=int, default=10_000, help="entities, 0 for all")
    games.add_argument("--json", action="store_true", help="a JSON document for each policy")
    games.add_argument("--inspect", type=int, default=0, help="show so many of the best first questions instead")
    return top


def main(argv: list[str] | None = None) -> None:
    """Run a job."""
    a = parser().parse_args(argv)
    result = JOBS[a.job](build_session(), a)
    for name, df in result.items() if isinstance(result, dict) else [("", result)]:
        if a.output:
            _write(df, [f"{folder}/{name}".rstrip("/") for folder in a.output], a.format)
        else:
            print(name)
            df.show(50, truncate=False)


def _write(df: DataFrame, folders: list[str], kind: str) -> None:
    """Write a table to one or more folders; it is computed once. In text forms, lists become JSON."""
    with Scratch(df.sparkSession) as scratch:
        kept = scratch.keep(df, "output") if len(folders) > 1 else df
        if kind == "csv":
            nested = [f.name for f in kept.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
            kept = kept.withColumns({c: F.to_json(c) for c in nested}) if nested else kept
        for folder in folders:
            writer = kept.write.mode("overwrite").format(kind)
            (writer.option("header", "true") if kind == "csv" else writer).save(folder)


if __name__ == "__main__":
    main()
