"""CSV and TSV by the exact dialect: missing is not empty, long records widen the schema, faults are recorded."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeview.model import PreviewError

MAX_DIAGNOSTICS = 1000
#: Rows that go to Spark at once.
STEP = 1 << 14


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    header: bool = True
    strict: bool = False

    def __post_init__(self):
        if len(self.delimiter) != 1 or not 0 < ord(self.delimiter) < 128 or self.delimiter in '\r\n"':
            raise PreviewError("INVALID_ARGUMENT", "a delimiter is one ASCII character other than NUL, CR, LF and the quote")


def records(data: bytes, delimiter: str = ",") -> Iterator[tuple[int, list[bytes], int | None]]:
    """(byte offset, fields, offset of the first malformed quote or None) of each record.

    Quotes enclose a field that starts with one; inside, two stand for one. Records end at LF, CR or CR LF outside quotes; lines
    without any byte are no records. A quote inside an unquoted field, text after a closing quote, and a quote still open at
    the end are malformed and taken as they stand.
    """
    at, n, d = (3 if data.startswith(b"\xef\xbb\xbf") else 0), len(data), ord(delimiter)
    ends = re.compile(b"[\r\n" + re.escape(delimiter.encode()) + b"]").search
    while at < n:
        if data[at] in b"\r\n":
            at += 1
            continue
        begin, fields, bad = at, [], None
        while True:
            if at < n and data[at] == 34:
                at += 1
                out = bytearray()
                while True:
                    end = data.find(b'"', at)
                    if end < 0:
                        out += data[at:]
                        bad = n if bad is None else bad
                        at = n
                        break
                    out += data[at:end]
                    if data[end + 1 : end + 2] == b'"':
                        out.append(34)
                        at = end + 2
                        continue
                    at = end + 1
                    break
                start = at
                stop = ends(data, at)
                at = stop.start() if stop else n
                if at > start:
                    bad = start if bad is None else bad
                    out += data[start:at]
                fields.append(bytes(out))
            else:
                start = at
                stop = ends(data, at)
                at = stop.start() if stop else n
                if bad is None and (quote := data.find(b'"', start, at)) >= 0:
                    bad = quote
                fields.append(data[start:at])
            if at < n and data[at] == d:
                at += 1
                continue
            break
        if data[at : at + 2] == b"\r\n":
            at += 2
        elif at < n:
            at += 1
        yield begin, fields, bad


@dataclass
class Parsed:
    names: list[str]
    rows: list[list[str | None]]
    diagnostics: list[tuple[str, int | None, int]]
    schema_version: int


def parse(data: bytes, dialect: Dialect = Dialect()) -> Parsed:
    """The whole text: names, rows padded with None, (kind, row, byte offset) of each fault, and the schema's version."""
    names: list[str] = []
    rows: list[list[str | None]] = []
    faults: list[tuple[str, int | None, int]] = []
    version, header = 0, dialect.header

    def fault(kind, row, offset):
        if dialect.strict:
            raise PreviewError("PARSE_FAILED", kind, kind=kind, row=row, byte_offset=offset)
        if len(faults) < MAX_DIAGNOSTICS:
            faults.append((kind, row, offset))

    for begin, fields, bad in records(data, dialect.delimiter):
        if bad is not None:
            fault("malformed-quote", None, bad)
        row = None if header else len(rows)
        texts: list[str | None] = []
        for f in fields:
            try:
                texts.append(f.decode())
            except UnicodeDecodeError:
                fault("invalid-utf8", row, begin)
                texts.append(f.decode("utf-8", "replace"))
        if header:
            names, version, header = [t if t.strip() else f"column_{i + 1}" for i, t in enumerate(texts)], 1, False
            continue
        if not version:
            names, version = [f"column_{i + 1}" for i in range(len(texts))], 1
        if len(texts) != len(names):
            fault("ragged-row", row, begin)
            if len(texts) > len(names):
                names += [f"column_{i + 1}" for i in range(len(names), len(texts))]
                version += 1
        rows.append(texts)
    return Parsed(names, [r + [None] * (len(names) - len(r)) for r in rows], faults, version)


def _well_formed(body: np.ndarray, delimiter: int) -> bool:
    """Whether every quote opens a field, closes one or is one of two inside one, so that all readers of quotes agree."""
    at = np.flatnonzero(body == 34)
    if len(at) % 2:
        return False
    edge = np.zeros(256, bool)
    edge[[delimiter, 10, 13, 34]] = True
    before, after = at[::2] - 1, at[1::2] + 1
    return bool((edge[body[np.maximum(before, 0)]] | (before < 0)).all() and (edge[body[np.minimum(after, len(body) - 1)]] | (after >= len(body))).all())


def fast_columns(data: bytes, dialect: Dialect = Dialect()) -> tuple[list[str], list[pa.Array]] | None:
    """(names, columns) of a text without any fault, by Arrow's vectorised reader; None where parse() has to look."""
    body = data[3:] if data.startswith(b"\xef\xbb\xbf") else data
    first = next(records(body, dialect.delimiter), None)
    if first is None or first[2] is not None or not _well_formed(np.frombuffer(body, np.uint8), ord(dialect.delimiter)):
        return None
    try:
        pa.array([body], pa.large_binary()).cast(pa.large_string())
        names = [f"f{i}" for i in range(len(first[1]))]
        table = csv.read_csv(
            pa.BufferReader(body),
            csv.ReadOptions(use_threads=False, block_size=len(body) + 1, column_names=names),
            csv.ParseOptions(delimiter=dialect.delimiter, newlines_in_values=True, ignore_empty_lines=True),
            csv.ConvertOptions(check_utf8=False, column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        ).combine_chunks()
    except (pa.ArrowInvalid, OverflowError):
        return None
    columns = [c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in table.columns]
    if not dialect.header:
        return [f"column_{i + 1}" for i in range(len(columns))], columns
    heads = [c[0].as_py() for c in columns]
    return [t if t.strip() else f"column_{i + 1}" for i, t in enumerate(heads)], [c.slice(1) for c in columns]


def parsed_columns(data: bytes, dialect: Dialect = Dialect()) -> tuple[list[str], list[pa.Array]]:
    """The names and columns of a text, by the fast reader where it may, else by parse()."""
    fast = fast_columns(data, dialect)
    if fast is not None:
        return fast
    got = parse(data, dialect)
    return got.names, [pa.array(c, pa.string()) for c in zip(*got.rows)] if got.rows else [pa.array([], pa.string())] * len(got.names)


def names_of(spark: SparkSession, path: str, dialect: Dialect = Dialect()) -> list[str]:
    """The column names of one file, or those of the widest file of a folder (the first by path, if several are)."""
    return (_shape(spark, path, dialect) or [("", 0, [])])[0][2]


def _shape(spark: SparkSession, path: str, dialect: Dialect) -> list[tuple[str, int, list[str]]]:
    """The (file, rows, names) with most names; one row, whatever the number of files."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                names, columns = parsed_columns(data.as_py(), dialect)
                yield pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([len(columns[0]) if columns else 0], pa.int64()), "names": pa.array([names], pa.list_(pa.string()))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "file string, rows long, names array<string>")
    return [(r.file, r.rows, r.names) for r in found.orderBy(F.size("names").desc(), "file").limit(1).collect()]


def unique_names(names: list[str], taken: tuple[str, ...] = ("file", "row")) -> list[str]:
    """Names that a frame can hold: one that is there already, whatever its case, gets its place as a suffix."""
    seen, out = set(taken), []
    for i, n in enumerate(names):
        while n.lower() in seen:
            n = f"{n}_{i + 1}"
        seen.add(n.lower())
        out.append(n)
    return out


def read(spark: SparkSession, path: str, dialect: Dialect = Dialect(), names: list[str] | None = None) -> DataFrame:
    """The rows of one delimited file or a folder of them as (file, row, its columns by their names); all nullable strings.

    A file is the unit of work, because a quoted line feed makes any other cut unsafe; files are parsed in parallel. The
    schema is that of the widest file, found by a first pass unless ``names`` gives it; a name that repeats gets a suffix.
    """
    names = unique_names(names if names is not None else names_of(spark, path, dialect))

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                _, columns = parsed_columns(data.as_py(), dialect)
                n = len(columns[0]) if columns else 0
                for k in range(0, n, STEP):
                    m = min(STEP, n - k)
                    own = [columns[i].slice(k, m) if i < len(columns) else pa.nulls(m, pa.string()) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, m), pa.array(range(k, k + m), pa.int64()), *own], names=["file", "row", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return files.mapInArrow(run, "file string, row long" + (", " + quoted if names else ""))


def diagnostics(spark: SparkSession, path: str, dialect: Dialect = Dialect()) -> DataFrame:
    """(file, kind, row, byte_offset) of the faults of each file, at most MAX_DIAGNOSTICS a file; with ``strict`` the one that ends the reading."""

    def run(batches):
        for p in batches:
            for name, data in zip(p["path"], p["content"]):
                try:
                    found = [] if fast_columns(bytes(data), dialect) else parse(bytes(data), dialect).diagnostics
                except PreviewError as e:
                    found = [(e.details["kind"], e.details["row"], e.details["byte_offset"])]
                yield pd.DataFrame([(name, *f) for f in found], columns=["file", "kind", "row", "byte_offset"]).astype({"row": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, kind string, row long, byte_offset long")


def fault_counts(spark: SparkSession, path: str, dialect: Dialect = Dialect()) -> DataFrame:
    """(kind, n) of the faults."""
    return diagnostics(spark, path, dialect).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def checkpoints(data: bytes, interval: int, dialect: Dialect = Dialect()) -> list[tuple[int, int]]:
    """(row, byte offset) of every ``interval``-th row, from which parse_from() can go on."""
    if interval < 1:
        raise PreviewError("INVALID_ARGUMENT", "an interval is at least 1")
    begins = (begin for begin, _, _ in records(data, dialect.delimiter))
    if dialect.header:
        next(begins, None)
    return [(k, at) for k, at in enumerate(begins) if k % interval == 0]


def parse_from(data: bytes, marks: list[tuple[int, int]], row_start: int, row_count: int, dialect: Dialect = Dialect()) -> list[list[str]]:
    """Rows [row_start, row_start + row_count) as they stand, read from the last checkpoint before them."""
    at = bisect_right(marks, (row_start, len(data))) - 1
    if at < 0 or row_count <= 0:
        return []
    row, offset = marks[at]
    rows = (([f.decode("utf-8", "replace") for f in fields]) for _, fields, _ in records(data[offset:], dialect.delimiter))
    return list(islice(rows, row_start - row, row_start - row + row_count))
