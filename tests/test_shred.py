"""Shredding against a plain walk of the documents, and its edge cases."""

from __future__ import annotations

import json

import pytest

from spoolworks.operators import shred
from spoolworks.plans import records


@pytest.mark.parametrize(
    ("text", "parsed"),
    [
        ('{"a": 1}', True), ("[]", True), (' "x" ', True), ("null", True), (None, False), ("", False), ("  ", False), ("[] null", False), ('{"a": 1}}', False), ('[{"a"', False),
        ("NaN", False), ("[NaN]", False), ("{'a': 1}", False), ('"[1, 2]"', True), ('"[1, 2"', False), ("<html>", False), ("[" * 100_000, False),
    ],
)
def test_only_whole_documents_parse(text, parsed):
    assert shred.parse_document(text)[0] is parsed


def test_quoted_documents_are_unquoted():
    text = json.dumps({"a": [1]})
    for _ in range(9):
        text = json.dumps(text)
        assert shred.parse_document(text) == (True, {"a": ["1"]})
    assert shred.parse_document(json.dumps(json.dumps("plain"))) == (True, "plain")


def rows_of(spark, lines):
    schema = "line_no bigint, alternative_titles string, genres string, studios string, name string"
    df = spark.createDataFrame([(i, *line, "clash") for i, line in enumerate(lines)], schema)
    edges = shred.shred(df, "line_no", records.JSON_FIELDS, tagged={"alternative_titles": records.TITLES})
    return edges, shred.entities(edges, "line_no", records.ENTITIES)


def found(spark, tmp_path, lines):
    schema = "line_no bigint, alternative_titles string, genres string, studios string"
    spark.createDataFrame([(i, *line) for i, line in enumerate(lines)], schema).write.parquet(f"{tmp_path}/discovery.parquet")
    return {(r.line_no, r.child_path): r.child_name for r in records.p1_found(spark, str(tmp_path)).collect()}


def test_paths_and_names(spark, tmp_path):
    studios = [{"name": " A ", "units": [{"name": None}, {"name": "u1", "leads": {"role": "x", "name": "L"}}]}, "B", {"node": {"id": 3, "name": "C"}}, {"name": " "}, 7]
    got = found(spark, tmp_path, [
        ('{"en": "E", "ja": "", "synonyms": ["s0", null, {"text": "s2", "lang": "xx"}, 12]}', '[{"name": "G"}, "H", {"id": 1}]', json.dumps(studios)),
        ('[{"type": "synonym", "title": "a"}, {"type": "en", "title": "b"}, {"type": "synonym", "title": "c"}, {"type": "en", "title": "b"}]', '{"name": "only"}', "{}"),
        (json.dumps('{"synonyms": "one"}'), "null", '[{"name": "cut"'),
        (None, "", "[] null"),
    ])
    assert got == {
        (0, "alternative_titles.en"): "E", (0, "alternative_titles.synonyms[0]"): "s0", (0, "alternative_titles.synonyms[2]"): "s2", (0, "alternative_titles.synonyms[3]"): "12",
        (0, "genres[0]"): "G", (0, "genres[1]"): "H", (0, "studios[0]"): "A", (0, "studios[0].units[1]"): "u1", (0, "studios[0].units[1].leads[0]"): "L", (0, "studios[1]"): "B",
        (0, "studios[2]"): "C", (0, "studios[4]"): "7", (1, "alternative_titles.synonyms[0]"): "a", (1, "alternative_titles.en"): "b", (1, "alternative_titles.synonyms[1]"): "c",
        (1, "genres[0]"): "only", (2, "alternative_titles.synonyms[0]"): "one",
    }


def test_children_know_their_parents(spark):
    _, entities = rows_of(spark, [(None, None, '[{"name": "A"}, {"name": "B", "units": [{"name": "u", "leads": [{"name": "x"}, {"name": "y"}]}]}]')])
    rows = {r.name: r for r in entities.collect()}
    assert rows["u"].parent == rows["B"].node and rows["x"].parent == rows["u"].node and rows["y"].ordinals == [1, 0, 1]


def test_the_first_of_several_scalars_counts(spark):
    _, entities = rows_of(spark, [(None, '[{"name": ["first", "second"], "text": "z"}]', None)])
    assert [r.name for r in entities.collect()] == ["first"]


def test_entity_tables_link_children_to_parents(spark):
    rows = records.p1_entities(spark, "/root/testdata/sf0.001").collect()
    nodes = {(r.line_no, r.field, r.node): r for r in rows}
    assert len(nodes) == len(rows) and {"units", "leads"} <= {r.label for r in rows} and any(r.role for r in rows)
    for r in rows:
        if r.label in ("units", "leads"):
            above = nodes[r.line_no, r.field, r.parent]
            assert above.label == {"units": "studios", "leads": "units"}[r.label] and r.place.startswith(above.place + ".")


def test_repeated_and_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(None, '[{"name": "A"}]'), (None, '[{"name": "B"}]'), (1, '[{"name": "C"}]'), (1, '[{"name": "D"}]')], "k bigint, genres string")
    wanted = [shred.Entity("genres", "genres", {"name": ("name",)})]
    assert sorted(r.name for r in shred.entities(shred.shred(df, "k", ["genres"]), "k", wanted).collect()) == ["A", "B", "C", "D"]


def test_empty_table_and_lone_surrogates(spark):
    edges, entities = rows_of(spark, [])
    assert edges.isEmpty() and entities.isEmpty()
    _, entities = rows_of(spark, [(None, '["\\ud83d"]', None)])
    assert [r.name for r in entities.collect()] == ["�"]


def test_very_long_list(spark):
    _, entities = rows_of(spark, [(None, json.dumps([{"name": str(i)} for i in range(20_000)]), None)])
    assert entities.count() == 20_000


def walk(field, value):
    """Names by path, as the task states them."""
    def names(path, entry):
        while isinstance(entry, dict) and set(entry) == {"node"}:
            entry = entry["node"]
        name = entry
        if isinstance(entry, dict):
            name = next((entry[k] for k in ("name", "text", "title") if entry.get(k) is not None), None)
        if isinstance(name, (str, int)) and str(name).strip():
            yield path, str(name).strip()
        if isinstance(entry, dict) and path.startswith("studios"):
            for child in ("units", "leads"):
                if child in entry:
                    below = entry[child] if isinstance(entry[child], list) else [entry[child]]
                    for i, e in enumerate(below):
                        yield from names(f"{path}.{child}[{i}]", e)

    for i, e in enumerate(value if isinstance(value, list) else [value]):
        yield from names(f"{field}[{i}]", e)


def test_agrees_with_a_plain_walk_of_the_data(spark):
    folder = "/root/testdata/sf0.001"
    want = set()
    for row in spark.read.parquet(f"{folder}/discovery.parquet").collect():
        for field in ("genres", "studios"):
            try:
                value = json.loads(row[field])
                value = json.loads(value) if isinstance(value, str) else value
            except (TypeError, ValueError):
                continue
            want |= {(row.line_no, p, n) for p, n in walk(field, value)}
    got = {tuple(r) for r in records.p1_found(spark, folder).collect() if not r.child_path.startswith("alternative")}
    assert got == want
