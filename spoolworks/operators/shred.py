"""Shredding of nested JSON into an adjacency table, and entity tables pivoted out of it.

Every text column that holds JSON becomes edges ``(key, field, doc, node, parent, label, ordinals, kind, scalar)``:

* a list is no node of its own; its elements carry the label of the list and their position, and one value that
  stands where a list is expected has position 0;
* ``ordinals`` is the path of positions from the root (a Dewey number), so a child finds its place below its
  ancestors without joining level by level;
* an object that only wraps another one (``{"node": {...}}``) is transparent, and JSON that was quoted once more is
  unquoted first.

Object nodes are then joined with their scalar children by grouping the edges on the owning node. The grouping combines
on the map side, where a document's edges lie side by side, so what is shuffled is about one row per object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Number(str):
    """A JSON number as it was written."""


def _constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _parse(text: str) -> object:
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_constant)


def parse_document(text: str | None) -> tuple[bool, object]:
    """(parsed, value) of a JSON text; quoted documents are unquoted, however often they are quoted.

    A text with anything but white space after the value, a part of a document, ``NaN`` and the like do not parse. A
    quoted text that is no JSON itself is an ordinary string, unless it begins as an object or list would.
    """
    if text is None:
        return False, None
    try:
        value = _parse(text)
    except (ValueError, RecursionError):
        return False, None
    while isinstance(value, str) and not isinstance(value, _Number):  # each time at least the two quotes go
        try:
            value = _parse(value)
        except (ValueError, RecursionError):
            return (False, None) if value.lstrip()[:1] in ("{", "[") else (True, value)
    return True, value


def _clean(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, become U+FFFD."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def edges_of(value: object, label: str, wrappers: Sequence[str] = ("node",)) -> list[tuple[int, int, str, list[int], str, str | None]]:
    """The edges (node, parent, label, ordinals, kind, scalar) of one parsed document, in document order."""
    out: list[tuple[int, int, str, list[int], str, str | None]] = []
    todo: list[tuple[object, int, str, tuple[int, ...]]] = [(value, 0, label, ())]
    while todo:
        value, parent, label, above = todo.pop()
        elements = value if isinstance(value, list) else [value]
        nested = []
        for position, element in enumerate(elements):
            while isinstance(element, dict) and len(element) == 1 and next(iter(element)) in wrappers:
                element = next(iter(element.values()))
            node, ordinals = len(out) + 1, [*above, position]
            if isinstance(element, dict):
                out.append((node, parent, label, ordinals, "object", None))
                nested += [(child, node, name, tuple(ordinals)) for name, child in element.items()]
            elif isinstance(element, list):
                out.append((node, parent, label, ordinals, "list", None))
                nested.append((element, node, label, tuple(ordinals)))
            elif element is None:
                out.append((node, parent, label, ordinals, "null", None))
            elif isinstance(element, bool):
                out.append((node, parent, label, ordinals, "boolean", str(element).lower()))
            else:
                kind = "number" if isinstance(element, _Number) else "string"
                out.append((node, parent, label, ordinals, kind, _clean(element)))
        todo += reversed(nested)
    return out


EDGE_FIELDS = "field string, doc bigint, node int, parent int, label string, ordinals array<int>, kind string, scalar string"


@dataclass(frozen=True)
class Tagged:
    """How a list of tagged entries (``[{"type": "en", ...}, ...]``) stands for an object with one list for each tag.

    ``labels`` gives each tag's label; entries with another tag keep the field's own label. For the labels in ``unique`` an
    entry equal to an earlier one is left out.
    """

    tag: str
    labels: dict[str, str]
    unique: tuple[str, ...] = ()

    def regroup(self, value: object, field: str) -> object:
        """The object that a list of tagged entries stands for; any other value as it is."""
        if not (isinstance(value, list) and any(isinstance(e, dict) and self.tag in e for e in value)):
            return value
        lists: dict[str, list] = {}
        for entry in value:
            tag = entry.get(self.tag) if isinstance(entry, dict) else None
            label = self.labels.get(tag.strip().lower() if isinstance(tag, str) else "", field)
            entries = lists.setdefault(label, [])
            if label not in self.unique or entry not in entries:
                entries.append(entry)
        return lists


def shred(df: DataFrame, key: str, fields: Sequence[str], wrappers: Sequence[str] = ("node",), tagged: dict[str, Tagged] | None = None) -> DataFrame:
    """The adjacency table of the JSON texts in ``fields``: ``key`` and :data:`EDGE_FIELDS`.

    ``tagged`` names the fields whose documents may also be lists of tagged entries.

    ``doc`` tells rows apart whose key is null or repeated. Null texts, texts that do not parse as a whole and an empty
    table give no edges. Other columns are not read. Elements that are null, blank or lists keep their position.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(EDGE_FIELDS).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, fields, wrappers, tagged = to_arrow_schema(schema), tuple(fields), tuple(wrappers), tagged or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = batch.column(0), batch.column(1)
            for number, field in enumerate(fields):
                rows, edges = [], []
                for row, text in enumerate(batch.column(2 + number).to_pylist()):
                    parsed, value = parse_document(text)
                    if parsed:
                        if field in tagged:
                            value = tagged[field].regroup(value, field)
                        found = edges_of(value, field, wrappers)
                        edges += found
                        rows += [row] * len(found)
                if rows:
                    at = pa.array(rows, pa.int32())
                    columns = [pa.array(list(c), t.type) for c, t in zip(zip(*edges), list(arrow)[3:])]
                    yield pa.RecordBatch.from_arrays([keys.take(at), pa.array([field] * len(rows), pa.string()), docs.take(at), *columns], schema=arrow)

    source = df.select(F.col(key), F.monotonically_increasing_id(), *[F.col(f).cast("string") for f in fields])
    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Entity:
    """An entity table to pivot out of the edges: objects (or plain scalars) of ``label`` in ``field``.

    ``scalars`` maps output columns to the labels of scalar children, the first present one counting, of several scalars of
    one label the first written; a plain scalar that stands for the object gives the first of them.
    """

    field: str
    label: str
    scalars: dict[str, tuple[str, ...]]


def entities(edges: DataFrame, key: str, wanted: Sequence[Entity]) -> DataFrame:
    """Entity rows: ``key, field, doc, label, node, parent, ordinals, kind`` and the union of the wanted scalar columns.

    One grouping serves all entity tables: an edge is sent to its own node if it is an entity, and to its parent if it is
    a scalar child. ``parent`` links an entity to the entity or object above it.
    """
    columns = list(dict.fromkeys(name for e in wanted for name in e.scalars))
    scalar = F.col("kind").isin("string", "number", "boolean")
    is_entity = F.lit(False)
    for e in wanted:
        is_entity |= (F.col("field") == e.field) & (F.col("label") == e.label)
    labels = sorted({label for e in wanted for names in e.scalars.values() for label in names})
    is_child = scalar & F.col("label").isin(*labels) & (F.size("ordinals") > 1)
    marked = edges.select(
        key, "field", "doc", "label", "ordinals", "kind", "parent", "scalar", is_entity.alias("own"),
        F.explode(F.array_compact(F.array(F.when(is_entity, F.col("node")), F.when(is_child, F.col("parent"))))).alias("at"),
        F.col("node"),
    )
    own = F.col("own") & (F.col("at") == F.col("node"))

    def of_own(value: Column) -> Column:
        return F.max(F.when(own, value))

    named = []
    for name in columns:
        choices: Column = F.lit(None).cast("string")
        ways = list(dict.fromkeys(label for e in wanted for label in e.scalars.get(name, ())))
        found = [F.min(F.when(~own & (F.col("label") == label), F.struct("node", "scalar")))["scalar"] for label in ways]
        plain = [e for e in wanted if next(iter(e.scalars)) == name]
        if plain:
            itself = F.lit(False)
            for e in plain:
                itself |= (F.col("field") == e.field) & (F.col("label") == e.label)
            found = [of_own(F.when(itself & scalar & (F.col("kind") != "boolean"), F.col("scalar"))), *found]
        named.append(F.coalesce(*found, choices).alias(name))
    return (
        marked.groupBy(key, "field", "doc", F.col("at").alias("entity"))
        .agg(
            of_own(F.col("label")).alias("label"), of_own(F.col("parent")).alias("parent"), of_own(F.col("kind")).alias("kind"),
            F.max(F.when(own, F.col("ordinals"))).alias("ordinals"), *named,
        )
        .where(F.col("label").isNotNull())
        .select(key, "field", "doc", "label", F.col("entity").alias("node"), "parent", "ordinals", "kind", *columns)
    )
