"""Masks, issues of loads, divergences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spoolworks.operators import profile
from spoolworks.plans import records

RULES = {"v": profile.Rule(1, 100), "y": profile.Rule(1890, 2030, moved=8, relative=False)}


def issues(spark, rows):
    df = spark.createDataFrame(rows, "feed int, load int, v double, y double")
    return {tuple(r) for r in profile.load_issues(df, "feed", "load", RULES).collect()}


def test_masks(spark):
    values = ["Ab12", "2001-02-03", "12.5", "-3", "日本 7", "", None, "a  b"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(profile.mask(F.col("v"))).collect()] == ["Aa9", "9-9-9", "9.9", "-9", "A 9", "", None, "a a"]


def test_number_text(spark):
    df = spark.createDataFrame([(12.0,), (12.5,), (-3.0,), (math.nan,), (None,), (1e7,), (math.inf,), (1e20,)], "v double")
    assert [r[0] for r in df.select(profile.number_text(F.col("v"))).collect()] == ["12", "12.5", "-3", None, None, "10000000", "Infinity", "100000000000000000000"]


def test_integers_and_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT 1 AS k, 9007199254740993L AS i, CAST(1.50 AS DECIMAL(10,4)) AS d, CAST(100 AS DECIMAL(10,4)) AS e")
    got = {r.column_name: r.value for r in profile.value_histogram(df, ["k"], ["i", "d", "e"]).collect()}
    assert got == {"i": "9007199254740993", "d": "1.5", "e": "100"}


def test_dominant_masks_are_mined(spark):
    rows = [("a", "9", 50), ("a", "9.9", 60), ("a", "-9", 20), ("b", "9.9", 5), ("c", "a", 3), ("c", "A", 3), ("c", None, 90)]
    masks = spark.createDataFrame(rows, "column_name string, mask string, n int")
    mined = lambda *args: {r.column_name: sorted(r.dominant) for r in profile.dominant_masks(masks, *args).collect()}
    assert mined() == {"a": ["-9", "9"], "b": ["9.9"], "c": ["A"]}
    assert mined(profile.WHOLE) == {"a": ["-9", "9"]}


def test_a_pattern_is_violated_by_what_was_not_mined(spark, monkeypatch):
    rows = [(1, 1, float(-i), 2000.5) for i in range(1, 41)] + [(1, 1, 3.0, 2000.5)]
    assert {x for x in issues(spark, rows) if x[2] == "pattern"} == {(1, "y", "pattern")}  # signs are no violation
    monkeypatch.setattr(profile, "dominant_masks", lambda masks, admits=None: masks.select("column_name", F.array("mask").alias("dominant")).limit(0))
    assert {x for x in issues(spark, rows) if x[2] == "pattern"} == {(1, "v", "pattern"), (1, "y", "pattern")}


def test_each_issue(spark):
    plain = [(1, 1, float(i), 2000.0) for i in range(1, 41)]
    assert ("1", "v") not in {(str(x[0]), x[1]) for x in issues(spark, plain) if x[2] != "constant"}
    assert (1, "y", "constant") in issues(spark, plain)
    assert (1, "v", "range") in issues(spark, [*plain, (1, 1, 500.0, 2000.0)])
    assert (1, "v", "pattern") in issues(spark, [*plain, (1, 1, 2.5, 2000.0)])
    moved = plain + [(1, 2, float(i) + 20, 2009.0) for i in range(1, 41)]
    assert {(2, "v", "shift"), (2, "y", "shift")} <= issues(spark, moved)
    gone = plain + [(1, 2, math.nan if i % 2 else None, 2000.0) for i in range(10)]
    assert (2, "v", "null_rate") in issues(spark, gone) and (2, "v", "shift") not in issues(spark, gone)


def test_limits_are_not_issues(spark):
    base = [(1, 1, float(i % 50 + 1), 2000.0 + i % 3) for i in range(100)]
    at_two_percent = base[:98] + [(1, 1, 500.0, 2000.0)] * 2
    assert (1, "v", "range") not in issues(spark, at_two_percent)
    step = [(1, 1, 5.0 + i % 2, 2000.0 + i % 3) if i >= 20 else (1, 1, None, 2000.0 + i % 3) for i in range(100)]
    step += [(1, 2, 5.0 + i % 2, 2000.0 + i % 3) if i >= 5 else (1, 2, None, 2000.0 + i % 3) for i in range(100)]
    assert (2, "v", "null_rate") not in issues(spark, step)


def test_feeds_do_not_mix_and_rows_without_load_are_left_out(spark):
    rows = [(1, 1, 5.0, 2000.0), (2, 2, 90.0, 2020.0), (1, None, 1.0, 1900.0), (None, 3, 7.0, 2000.0)]
    found = issues(spark, rows)
    assert not {x for x in found if x[2] in ("shift", "null_rate")} and None not in {x[0] for x in found}


def test_empty_table_and_clashing_names(spark):
    assert issues(spark, []) == set()
    df = spark.createDataFrame([(1, 1, 5.0, 2000.0, 9, "x")], "feed int, load int, v double, y double, n int, value string")
    assert {tuple(r) for r in profile.load_issues(df, "feed", "load", RULES).collect()} == {(1, "v", "constant"), (1, "y", "constant")}


def test_divergence_and_rare_masks(spark):
    rows = [(1, 1, "a1")] * 98 + [(1, 1, "?")] * 2 + [(1, 2, "?")] * 50
    df = spark.createDataFrame(rows, "feed int, load int, c string")
    histogram = profile.value_histogram(df, ["feed", "load"], ["c"])
    assert 0.9 < profile.mask_divergence(histogram, "feed", "load").first().divergence <= 1
    assert profile.rare_masks(histogram, ["feed", "load"], 0.5).select("mask").distinct().first().mask == "?"
    assert profile.rare_masks(profile.value_histogram(df.where("load = 1"), ["feed", "load"], ["c"]), ["feed", "load"], 0.05).collect() == [(1, 1, "c", "?", 2)]


def test_every_column_is_profiled(spark):
    folder = "/root/testdata/sf0.001"
    columns = set(spark.read.parquet(f"{folder}/development_entities.parquet").columns) - {"feed_id", "load_id"}
    whole, seven = records.p2_profile_all(spark, folder), records.p2_profile(spark, folder)
    assert {r[0] for r in whole.select("column_name").distinct().collect()} == columns
    assert seven.exceptAll(whole).isEmpty()
    assert {r[0] for r in records.p2_divergence_all(spark, folder).select("column_name").distinct().collect()} == columns
