"""Nested JSON records to related flat tables through an adjacency table.

``shred`` stores every node of every record once: node, parent, label, ordinal, kind, scalar and the paths. Object nodes
then meet their scalar children, and the children are pivoted into the columns of an entity table: their codes alone
over all entities (``entities``), or every scalar below an element (``entity_table``). The join is one aggregation by
(record, object node) over a single pass of the adjacency table, so records are parsed once and one shuffle carries
only the nodes that an entity needs.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "doc long, node int, parent int, label string, ordinal int, kind string, scalar string, path string, owner_path string, shape string, element int"


#: About so many bytes of nodes are in memory at a time.
NODE_BYTES = 32 << 20


@dataclass(frozen=True)
class Shape:
    """How one family of records is laid out. Shapes are paths without positions, as ``data.oppHits.cfdaList``.

    lists: where a list is usual, so a lone value is position 0; splits: where a text is a joined list, and its
    separator; lone_root: (field, shape, markers): an object without ``field`` that has one of ``markers`` is itself
    an element of ``shape`` with path ``$``, which is left out of the paths below it.
    elements: shapes of the objects and scalars that nodes note as the nearest element at or above them.
    """

    lists: frozenset[str] = frozenset()
    splits: Mapping[str, str] = field(default_factory=dict)
    lone_root: tuple[str, str, tuple[str, ...]] | None = None
    elements: frozenset[str] = frozenset()


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
_WORD = re.compile("|".join(_WORDS))


def decode_deep(text: str) -> object:
    """The JSON value of a text nested beyond what the standard decoder's recursion holds, numbers as they are written."""
    blank = lambda i: _BLANK.match(text, i).end()
    open_: list[list | dict] = []
    names: list[str | None] = []  # the name that the next value of each open object gets
    i = blank(0)
    while True:
        # A name, or a value that may open further ones.
        if open_ and isinstance(open_[-1], dict):
            if text[i : i + 1] != '"':
                raise ValueError(f"no name at {i}")
            names[-1], i = scanstring(text, i + 1, True)
            i = blank(i)
            if text[i : i + 1] != ":":
                raise ValueError(f"no colon at {i}")
            i = blank(i + 1)
        c = text[i : i + 1]
        if c and c in "{[":
            value: object = {} if c == "{" else []
            i = blank(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                open_.append(value)
                names.append(None)
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif word := _WORD.match(text, i):
            value, i = _WORDS[word.group()], word.end()
        elif number := _NUMBER.match(text, i):
            value, i = number.group(), number.end()
        else:
            raise ValueError(f"no value at {i}")
        # The value goes into what is open, which may end with it.
        while True:
            i = blank(i)
            if not open_:
                if i < len(text):
                    raise ValueError(f"more at {i}")
                return value
            top = open_[-1]
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = blank(i + 1)
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise ValueError(f"no end at {i}")
            value = open_.pop()
            names.pop()
            i += 1


def decode(text: str | None) -> object:
    """The JSON value, numbers as they are written, at any depth; a text that is JSON again is opened, however often.

    None if it is broken. Texts within a record stay texts.
    """
    value: object = text
    while isinstance(value, str):
        inner = value.lstrip("\ufeff \t\r\n")
        try:
            try:
                value = json.loads(inner, parse_int=str, parse_float=str)
            except RecursionError:
                value = decode_deep(inner)
        except ValueError:
            return None
        if inner[:1] != '"' and isinstance(value, str):
            break  # a number, as it is written
    return value


def nodes_of(value: object, shape: Shape) -> Iterator[tuple]:
    """Rows (node, parent, label, ordinal, kind, scalar, path, owner_path, shape, element) of one record, parents first.

    owner_path is the path of the nearest object above, element the node of the nearest element at or above, or -1. Iterative, so no depth is too great.
    """
    counter = 0
    path, shape_path = "", ""
    if shape.lone_root and isinstance(value, dict):
        key, at, markers = shape.lone_root
        if key not in value and any(m in value for m in markers):
            path, shape_path = "$", at
    stack: list[tuple] = [(value, -1, "", None, path, "", shape_path, -1)]
    while stack:
        value, parent, label, ordinal, path, owner, shape_path, element = stack.pop()
        node = counter
        counter += 1
        if shape_path in shape.elements and not isinstance(value, list) and value not in (None, "", {}):
            element = node
        if isinstance(value, dict):
            yield node, parent, label, ordinal, "object" if value else "empty", None, path, owner, shape_path, element
            below = "" if path in ("", "$") else path + "."
            deeper = f"{shape_path}." if shape_path else ""
            for k, v in reversed(value.items()):
                at = deeper + k
                if at in shape.splits and isinstance(v, str):
                    v = v.split(shape.splits[at])
                if at in shape.lists and v is not None and not isinstance(v, list):
                    v = [v]
                stack.append((v, node, k, None, below + k, path, at, element))
        elif isinstance(value, list):
            yield node, parent, label, ordinal, "array" if value else "empty", None, path, owner, shape_path, element
            for i in range(len(value) - 1, -1, -1):
                stack.append((value[i], node, label, i, f"{path}[{i}]", owner, shape_path, element))
        else:
            text = {True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else value
            text = text.strip() if isinstance(text, str) else text if text is None else str(text)
            yield node, parent, label, ordinal, "scalar" if text else "empty", text or None, path, owner, shape_path, element


def shred(records: DataFrame, key: str, text: str, shape: Shape, keep: Sequence[str] | None = None) -> DataFrame:
    """The adjacency table of a JSON text column: ``key`` and the columns of ``NODE_SCHEMA``.

    Null, empty and broken texts have no nodes. ``keep`` limits the rows to nodes of these shapes, as a projection
    limits columns. doc tells delivered records apart, also where two share a key.
    """
    kept = None if keep is None else frozenset(keep)
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    key_type = dict(records.dtypes)[key]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            length = 0

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)  # noqa: B023
                keys = batch.column(0).take(pa.array(at, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["key", *names])

            for i, payload in enumerate(batch.column(1).to_pylist()):
                doc += 1
                value = decode(payload)
                if value is None:
                    continue
                for row in nodes_of(value, shape):
                    if kept is None or row[8] in kept:
                        rows.append((doc, *row))
                        at.append(i)
                        length += 100 + 3 * len(row[6])
                        if length > NODE_BYTES:  # the paths of a deep record are long
                            yield out()
                            rows, at, length = [], [], 0
            yield out()

    source = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"key {key_type}, {NODE_SCHEMA}")


def unreadable(records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) of the records that ``shred`` has no nodes for: ``missing``, ``empty`` or ``broken`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = ["missing" if t is None else "empty" if not t.strip() else "broken" if decode(t) is None else None for t in batch.column(1).to_pylist()]
            at = [i for i, r in enumerate(reasons) if r]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([reasons[i] for i in at], pa.string())], names=["key", "reason"])

    return records.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {dict(records.dtypes)[key]}, reason string")


@dataclass(frozen=True)
class Entity:
    """One kind of element: its name, its shapes, the field with its code, and whether a scalar element is its own code."""

    name: str
    shapes: tuple[str, ...]
    code: str
    scalar_is_code: bool = False


def entities(nodes: DataFrame, specs: Sequence[Entity]) -> DataFrame:
    """(key, entity, parent_path, node_path, node_code): non-empty elements of each entity with their parent's path.

    Elements join their scalar children by (doc, object node); the child named by the entity's code becomes its code,
    '' if it is absent.
    """
    of = {s: e for e in specs for s in e.shapes}
    name_of = F.create_map(*[F.lit(x) for s, e in of.items() for x in (s, e.name)])
    code_of = F.create_map(*[F.lit(x) for s, e in of.items() for x in (f"{s}.{e.code}", s)])
    own = [s for s, e in of.items() if e.scalar_is_code]
    element = F.col("shape").isin(list(of)) & F.col("kind").isin("object", "scalar")
    child = F.try_element_at(code_of, F.col("shape")).isNotNull() & (F.col("kind") == "scalar")
    pivoted = (
        nodes.where(element | child)
        .withColumn("object", F.when(element, F.col("node")).otherwise(F.col("parent")))
        .groupBy("doc", "object")
        .agg(
            F.max(F.when(element, F.struct("key", "shape", "path", "owner_path", "kind", "scalar"))).alias("e"),
            F.max(F.when(child, F.col("scalar"))).alias("code"),
        )
        .where("e is not null")
    )
    own_code = F.when(F.col("e.kind").eqNullSafe("scalar") & F.col("e.shape").isin(own), F.col("e.scalar"))
    return pivoted.select(
        F.col("e.key").alias("key"), F.element_at(name_of, F.col("e.shape")).alias("entity"), F.col("e.owner_path").alias("parent_path"),
        F.col("e.path").alias("node_path"), F.coalesce("code", own_code, F.lit("")).alias("node_code"),
    )


def entity_table(nodes: DataFrame, spec: Entity, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """(key, parent_path, node_path, text, a column for each of ``fields`` and ``lists``, more) of one entity's elements.

    The whole adjacency table is read, with the entity's shapes among ``Shape.elements``. Fields are the labels below the
    element, joined by points, and name their column with _ for them; ``lists`` become arrays. A scalar element has its
    value in text, and in its code if it is one. Every other scalar that has this element as its nearest is in
    ``more`` (field, path, value), as are the values of a list under a name of ``fields``.
    """
    itself = F.struct("key", "shape", "path", "owner_path", "scalar")
    below = (F.col("kind") == "scalar") & (F.col("node") != F.col("element"))
    # A group holds the scalars of one element, without those of the elements below it.
    grouped = (
        nodes.where((F.col("element") >= 0) & ((F.col("node") == F.col("element")) | below))
        .groupBy("doc", "element")
        .agg(F.max(F.when(F.col("node") == F.col("element"), itself)).alias("e"), F.sort_array(F.collect_list(F.when(below, F.struct("node", "shape", "ordinal", "path", "scalar")))).alias("kids"))
        .where(F.col("e.shape").isin(*spec.shapes))
    )
    start = F.when(F.col("e.shape") == "", F.lit(1)).otherwise(F.length("e.shape") + 2)
    kids = F.transform("kids", lambda k: F.struct(F.substring(k["shape"], start, F.length(k["shape"])).alias("field"), k["path"].alias("path"), k["scalar"].alias("value"), k["ordinal"].isNotNull().alias("listed")))
    rows = grouped.withColumn("kids", kids)
    of = lambda f, one: F.transform(F.filter("kids", lambda k: (k["field"] == f) & ~(F.lit(one) & k["listed"])), lambda k: k["value"])
    columns = {f.replace(".", "_"): F.try_element_at(of(f, True), F.lit(1)) for f in fields} | {f.replace(".", "_"): of(f, False) for f in lists}
    if spec.scalar_is_code:
        columns[spec.code] = F.coalesce(columns[spec.code], "e.scalar")
    rest = F.filter("kids", lambda k: ~k["field"].isin(*fields, *lists) | k["field"].isin(*fields) & k["listed"])
    more = F.transform(rest, lambda k: F.struct(k["field"].alias("field"), k["path"].alias("path"), k["value"].alias("value")))
    return rows.select(F.col("e.key").alias("key"), F.col("e.owner_path").alias("parent_path"), F.col("e.path").alias("node_path"), F.col("e.scalar").alias("text"), *[c.alias(n) for n, c in columns.items()], more.alias("more"))
