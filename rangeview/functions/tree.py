"""Structured documents as node tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeview.model import PreviewError
from rangeview.sources.structured import parse_structured

MAX_NODES, MAX_DEPTH = 100_000, 100
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def ordered(keys: list[str]) -> list[str]:
    """Object keys as a browser lists them: array indexes first, ascending, then the others as they came."""
    numeric = sorted((k for k in keys if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    chosen = set(numeric)
    return numeric + [k for k in keys if k not in chosen]


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(value), "number")


def nodes(value, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> list[tuple]:
    """(id, parent_id, key, type, value, child_count, depth) in pre-order; the root has no parent and no key."""
    out: list[tuple] = []
    stack = [(None, None, value, 0)]
    while stack:
        parent, key, v, depth = stack.pop()
        if depth > max_depth or len(out) >= max_nodes:
            raise PreviewError("RESOURCE_LIMIT", "the document is too deep or has too many nodes")
        t = kind(v)
        children = [(k, v[k]) for k in ordered(list(v))] if t == "object" else [(str(i), x) for i, x in enumerate(v)] if t == "array" else []
        scalar = None if t in ("object", "array", "null") else v if t == "string" else json.dumps(v)
        out.append((len(out), parent, key, t, scalar, len(children), depth))
        stack += [(len(out) - 1, k, x, depth + 1) for k, x in reversed(children)]
    return out


def node_table(docs: DataFrame, key: str, text: str, format: str = "json", max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The node table of a structured document per row; a null text has no nodes.

    A text that does not parse, or is over a limit, is one row without an id whose type is ``error`` and whose value is
    the code, so that one document does not end the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for k, t in zip(p["k"], p["t"]):
                if t is None:
                    continue
                try:
                    rows += [(k, *n) for n in nodes(parse_structured(format, t), max_nodes, max_depth)]
                except PreviewError as e:
                    rows.append((k, None, None, None, "error", e.code, None, None))
            yield pd.DataFrame(rows, columns=["k", "id", "parent_id", "key", "type", "value", "child_count", "depth"]).astype(dict.fromkeys(("id", "parent_id", "child_count", "depth"), "Int64"))

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, id long, parent_id long, key string, type string, value string, child_count long, depth long")
    return out.withColumnRenamed("k", key)


def _page(offset: int, limit: int) -> None:
    if not 1 <= limit <= 10_000 or offset < 0:
        raise PreviewError("INVALID_RANGE", "a page has 1 to 10000 rows")


def node_page(table: DataFrame, offset: int, limit: int) -> DataFrame:
    """Nodes [offset, offset + limit) of each document in pre-order; ids are their places, so no sort is needed."""
    _page(offset, limit)
    return table.where((F.col("id") >= offset) & (F.col("id") < offset + limit))


def children(table: DataFrame, node_id: int, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a node's children."""
    _page(offset, limit)
    return table.where(F.col("parent_id") == node_id).orderBy("id").offset(offset).limit(limit)


def array_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, fields) of the elements of a JSON array of objects; fields: name to text, as they stand in the document.

    Another value, or an array with an element that is no object, is one row with a null position.
    """
    value = F.try_parse_json(F.col(text))
    elements = F.try_variant_get(value, "$", "array<variant>")
    plain = elements.isNotNull() & F.forall(elements, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    maps = F.when(plain, F.from_json(F.col(text), "array<map<string,string>>"))
    good = docs.select(F.col(key).alias("_k"), maps.alias("_m"))
    rows = good.where("_m is not null").select("_k", F.posexplode("_m").alias("position", "fields"))
    bad = good.where("_m is null").select("_k", F.lit(None).cast("int").alias("position"), F.lit(None).cast("map<string,string>").alias("fields"))
    return rows.union(bad).select(F.col("_k").alias(key), F.col("position").cast("long").alias("position"), "fields")


def key_union(rows: DataFrame, key: str) -> DataFrame:
    """(name, first): all field names of array_rows(), by the place where they are first seen: (document, element, field)."""
    each = rows.where("position is not null").select(key, "position", F.posexplode(F.map_keys("fields")).alias("_n", "name"))
    return each.groupBy("name").agg(F.min(F.struct(key, "position", "_n")).alias("first")).orderBy("first")


def project_array(docs: DataFrame, key: str, text: str, offset: int = 0, limit: int | None = 100) -> DataFrame:
    """Arrays of objects as a table: (key, position, one column for each name of the union of keys); a missing field is null.

    An element that is no object is PARSE_FAILED. ``limit`` None takes all elements. The names are collected, as they are the
    schema; at most MAX_NODES of them.
    """
    if limit is not None:
        _page(offset, limit)
    rows = array_rows(docs, key, text)
    names = [r.name for r in key_union(rows, key).limit(MAX_NODES + 1).collect()]
    if len(names) > MAX_NODES:
        raise PreviewError("RESOURCE_LIMIT", "too many columns")
    if rows.where("position is null").limit(1).collect():
        raise PreviewError("PARSE_FAILED", "only arrays of objects can be projected as a table")
    rows = rows.where(F.col("position") >= offset)
    if limit is not None:
        rows = rows.where(F.col("position") < offset + limit)
    return rows.select(key, "position", *[F.element_at("fields", F.lit(n)).alias(n) for n in ordered(names) if n not in (key, "position")])
