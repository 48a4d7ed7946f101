"""Operators on text documents: lines, search, substrings. Offsets are characters (code points)."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeview.model import PreviewError

MAX_RESULTS, PREVIEW = 1000, 500
#: Rows of output that a task holds before it hands them on.
_STEP = 1 << 16


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def substring(text: Column, offset: int, length: int, strict: bool = False) -> Column:
    """``length`` characters from ``offset`` (0-based); ``strict``: a range that ends past the text is an error."""
    if offset < 0 or length < 0:
        raise PreviewError("INVALID_RANGE", "offset and length are not negative")
    part = F.substring(text, offset + 1, length)
    if not strict:
        return part
    return F.when(F.length(text) < offset + length, F.raise_error(F.lit("INVALID_RANGE: the range ends past the text")).cast("string")).otherwise(part)


def _expanded(docs: DataFrame, key: str, text: str, rows_of, names: list[tuple[str, pa.DataType]]) -> DataFrame:
    """(key, *names): the tuples that ``rows_of`` gives of each text, one pass over it; null texts have none."""
    kinds = {pa.int64(): "long", pa.string(): "string"}
    ddl = f"k {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` {kinds[t]}" for n, t in names)

    def run(batches):
        for b in batches:
            at, found = [], []

            def out():
                columns = list(zip(*found)) if found else [[] for _ in names]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(columns, names)]], names=["k", *[n for n, _ in names]])

            for i, x in enumerate(b.column(1).to_pylist()):
                if x is None:
                    continue
                rows = rows_of(x)
                found += rows
                at += [i] * len(rows)
                if len(found) >= _STEP:
                    yield out()
                    at, found = [], []
            if found:
                yield out()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, ddl).withColumnRenamed("k", key)


def _line_rows(x: str) -> list[tuple]:
    raw = x.split("\n")
    starts = accumulate((len(r) + 1 for r in raw[:-1]), initial=0)
    bodies = [r.removesuffix("\r") for r in raw]
    return [(k, t, s, s + len(t)) for k, (t, s) in enumerate(zip(bodies, starts), 1)]


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number from 1, text without its line end, start, end) of every line."""
    return _expanded(docs, key, text, _line_rows, [("number", pa.int64()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _checked(query: str, max_results: int) -> None:
    if not 1 <= len(query) <= 1024:
        raise PreviewError("INVALID_ARGUMENT", "a query has 1 to 1024 characters")
    if max_results < 1:
        raise PreviewError("INVALID_ARGUMENT", "max_results is at least 1")


def search(docs: DataFrame, key: str, query: str, text: str = "text", case_sensitive: bool = False, max_results: int = MAX_RESULTS) -> DataFrame:
    """Literal non-overlapping matches: (key, match from 1, start, end, line, preview); offsets are those of the folded
    text, the preview is the line they fall in, up to 500 characters."""
    _checked(query, max_results)
    needle = query if case_sensitive else query.lower()

    def rows_of(x: str) -> list[tuple]:
        folded, out, at = x if case_sensitive else x.lower(), [], 0
        starts = None
        while len(out) < max_results and (at := folded.find(needle, at)) >= 0:
            if starts is None:
                starts = [0, *(i + 1 for i, c in enumerate(x) if c == "\n")]
            line = bisect_right(starts, at)
            stop = starts[line] - 1 if line < len(starts) else len(x)
            out.append((len(out) + 1, at, at + len(query), line, x[starts[line - 1] : stop].removesuffix("\r")[:PREVIEW]))
            at += len(needle)
        return out

    return _expanded(docs, key, text, rows_of, [("match", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int64()), ("preview", pa.string())])


def search_count(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """How many non-overlapping matches a text has, in built-in functions."""
    _checked(query, 1)
    folded, needle = (text, query) if case_sensitive else (F.lower(text), query.lower())
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
