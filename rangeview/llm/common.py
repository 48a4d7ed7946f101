"""What the operators of this subpackage share: scratch tables, row keys, Arrow batches, summed arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once: bounds its memory when documents are long.
BATCH_ROWS = 512


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches kept small enough for whole long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.sparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="rangeview-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = f"{scratch_root(df.sparkSession)}/rangeview/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rangeview_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    path = getattr(df, "_rangeview_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def byte_chunks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about ``limit`` bytes; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def summed(df: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, slices: int = 64) -> np.ndarray:
    """The sum over all partitions of the fixed-length float64 array that ``counts`` makes of each.

    Each task emits its array in slices, slices are added on the executors, and the driver gets one array of
    ``length`` numbers, whatever the size of the input.
    """
    step = -(-length // slices)

    def emit(batches):
        total = np.asarray(counts(batches), np.float64)
        if total.any():
            parts = [(k, total[k * step : (k + 1) * step]) for k in range(slices)]
            parts = [(k, p) for k, p in parts if p.any()]
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in parts], pa.int32()), "v": pa.array([pa.compress(p.astype("<f8").tobytes(), "zstd", asbytes=True) for _, p in parts], pa.binary()), "n": pa.array([len(p) for _, p in parts], pa.int32())})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v, n in zip(*(b.column(c).to_pylist() for c in ("k", "v", "n"))):
                part = np.frombuffer(pa.decompress(v, decompressed_size=8 * n, codec="zstd", asbytes=True), "<f8")
                totals[k] = totals[k] + part if k in totals else part.copy()
        if totals:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(totals), pa.int32()), "v": pa.array([t.tobytes() for t in totals.values()], pa.binary()), "n": pa.array([len(t) for t in totals.values()], pa.int32())})

    schema = "k int, v binary, n int"
    out = np.zeros(length)
    for row in df.mapInArrow(emit, schema).repartition(min(slices, 16), "k").mapInArrow(add, schema).collect():
        out[row.k * step : row.k * step + row.n] += np.frombuffer(row.v, "<f8")
    return out


def bitmap(df: DataFrame, name: str, bits: int, slices: int = 64) -> np.ndarray:
    """Bytes of 2^bits bits, set at the low bits of a long column's values; its size does not follow the input.

    Tasks send their slices compressed, executors join them, and the driver gets one bitmap.
    """
    step = (1 << bits) // 8 // slices

    def joined(parts):
        for k, v in parts.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([pa.compress(v.tobytes(), "zstd", asbytes=True)], pa.binary())})

    def unpack(v):
        return np.frombuffer(pa.decompress(v, decompressed_size=step, codec="zstd", asbytes=True), np.uint8)

    def emit(batches):
        total = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy() & ((1 << bits) - 1)
            np.bitwise_or.at(total, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield from joined({k: p for k in range(slices) if (p := total[k * step : (k + 1) * step]).any()})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals[k] = totals[k] | unpack(v) if k in totals else unpack(v)
        yield from joined(totals)

    schema, out = "k int, v binary", np.zeros((1 << bits) // 8, np.uint8)
    for row in df.select(name).mapInArrow(emit, schema).repartition(min(slices, 16), "k").mapInArrow(add, schema).collect():
        out[row.k * step : (row.k + 1) * step] |= unpack(row.v)
    return out


def collected(df: DataFrame, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Long columns of a frame of proven bounded size as arrays on the driver; they travel as bytes, not as rows."""

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({n: pa.array([b.column(n).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for n in names})

    rows = df.select(*[F.col(n).cast("long").alias(n) for n in names]).coalesce(16).mapInArrow(raw, ", ".join(f"{n} binary" for n in names)).collect()
    return {n: np.frombuffer(b"".join(r[n] for r in rows), "<i8").copy() for n in names}
