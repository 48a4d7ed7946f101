"""Arrow IPC files and streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from rangeview.model import PreviewError

MAGIC = b"ARROW1"


def container(data: bytes) -> str:
    """file if at least 12 bytes start and end with the magic, else stream."""
    return "file" if len(data) >= 12 and data[:6] == MAGIC and data[-6:] == MAGIC else "stream"


def open_ipc(data: bytes, only_schema: bool = False):
    """The schema and the record batches of a file or stream, faults with their stable codes."""
    try:
        schema, batches = _opened(data)
        return schema, [] if only_schema else list(batches)
    except pa.ArrowNotImplementedError as e:
        raise PreviewError("UNSUPPORTED_FEATURE", str(e)) from e
    except (pa.ArrowInvalid, OSError) as e:
        raise PreviewError("PARSE_FAILED", str(e)) from e


def _opened(data: bytes):
    """(schema, iterator of record batches) of a container; batches are decoded as they are asked for."""
    source = pa.BufferReader(data)
    if container(data) == "file":
        r = pa.ipc.open_file(source)
        return r.schema, (r.get_batch(i) for i in range(r.num_record_batches))
    r = pa.ipc.open_stream(source)
    return r.schema, iter(r)


def _plain(t: pa.DataType) -> pa.DataType:
    """The type that Spark can hold: dictionaries and run ends by their values, half floats as floats, nanoseconds as
    whole numbers, decimals of over 38 digits as text."""
    if pa.types.is_dictionary(t) or pa.types.is_run_end_encoded(t):
        return _plain(t.value_type)
    if pa.types.is_float16(t):
        return pa.float32()
    if (pa.types.is_timestamp(t) or pa.types.is_time(t) or pa.types.is_duration(t)) and t.unit == "ns" or pa.types.is_time64(t):
        return pa.int64()
    if pa.types.is_time32(t):
        return pa.int32()
    if pa.types.is_decimal256(t):
        return pa.string()
    return t


def read(spark: SparkSession, path: str, columns: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, row_name: str | None = None) -> DataFrame:
    """The rows of one IPC container or a folder of them with one schema; each container is read by one task.

    ``columns`` and ``rows``: half-open runs of places; only those columns are converted, and batches outside the rows
    are skipped. ``row_name``: a column with each row's place in its container. Values of types that Spark lacks come as _plain() says.
    """
    files = spark.read.format("binaryFile").load(path)
    schema = schema_of(spark, path)
    chosen = range(*(columns or (0, len(schema))))
    plain = pa.schema([pa.field(schema.field(i).name, _plain(schema.field(i).type)) for i in chosen])
    full = plain.append(pa.field(row_name, pa.int64())) if row_name else plain

    def run(batches):
        for b in batches:
            for data in b.column(0):
                try:
                    own, parts = _opened(data.as_py())
                    if not own.equals(schema):
                        raise PreviewError("PARSE_FAILED", "the containers differ in schema")
                    at = 0
                    for part in parts:
                        n = part.num_rows
                        low, high = (0, n) if rows is None else (min(max(rows[0] - at, 0), n), min(max(rows[1] - at, 0), n))
                        if low < high:
                            own_columns = [part.column(i).slice(low, high - low) for i in chosen]
                            own_columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(own_columns, plain)]
                            if row_name:
                                own_columns.append(pa.array(range(at + low, at + high), pa.int64()))
                            if own_columns:
                                yield pa.RecordBatch.from_arrays(own_columns, schema=full)
                        at += n
                        if rows is not None and at >= rows[1]:
                            break
                except pa.ArrowNotImplementedError as e:
                    raise PreviewError("UNSUPPORTED_FEATURE", str(e)) from e
                except (pa.ArrowInvalid, OSError) as e:
                    raise PreviewError("PARSE_FAILED", str(e)) from e

    return files.select("content").mapInArrow(run, from_arrow_schema(full, prefer_timestamp_ntz=True))


def schema_of(spark: SparkSession, path: str) -> pa.Schema:
    """The schema of the first container, read by a task: only the schema's message comes to the driver."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                yield pa.RecordBatch.from_pydict({"s": pa.array([open_ipc(data.as_py(), only_schema=True)[0].serialize().to_pybytes()], pa.binary())})

    first = spark.read.format("binaryFile").load(path).select("content").limit(1).mapInArrow(run, "s binary").collect()
    if not first:
        raise PreviewError("SOURCE_UNAVAILABLE", f"no file at {path}")
    return pa.ipc.read_schema(pa.BufferReader(bytes(first[0].s)))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, batch, row_start, rows) of every record batch."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                n = [p.num_rows for p in open_ipc(data.as_py())[1]]
                starts = [sum(n[:k]) for k in range(len(n))]
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(n), pa.string()), "batch": pa.array(range(len(n)), pa.int32()), "row_start": pa.array(starts, pa.int64()), "rows": pa.array(n, pa.int64())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, batch int, row_start long, rows long")
