"""The facade: an engine opens datasets, datasets hold tables, tables answer ranges; closing one closes what it holds."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeview.functions import tree
from rangeview.functions.budget import DISPLAY_ONLY_BYTES
from rangeview.model import MAX_RANGE_CELLS, Extent, PreviewError, Range, RangeResult, budget, clamped
from rangeview.operators import window
from rangeview.sources import arrow_ipc, delimited, images, structured, xlsx
from rangeview.sources.sniff import sniff_preview, sniff_table

ADAPTERS = ("delimited", "arrow", "parquet", "excel")
#: The adapter for what sniff_table() says.
BY_FORMAT = {"csv": "delimited", "tsv": "delimited", "arrow": "arrow", "parquet": "parquet", "xlsx": "excel", "xls": "excel"}


def read_bytes(spark: SparkSession, path: str, most: int | None = None, from_end: bool = False) -> bytes:
    """The first or last ``most`` bytes of a file of any store that Spark reads; all of it without ``most``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise PreviewError("SOURCE_UNAVAILABLE", f"no file at {path}")
    if store.getFileStatus(where).isDirectory():
        raise PreviewError("INVALID_ARGUMENT", f"{path} is a folder")
    size = store.getFileStatus(where).getLen()
    n = size if most is None else min(most, size)
    stream = store.open(where)
    try:
        stream.seek(size - n if from_end else 0)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


class _Closing:
    """Something that is open until it is closed; closing again does nothing, any other use after it is HANDLE_CLOSED."""

    def __init__(self):
        self._held: list[_Closing] = []
        self.closed = False

    def _hold(self, other):
        self._held.append(other)
        return other

    def _open(self) -> None:
        if self.closed:
            raise PreviewError("HANDLE_CLOSED", f"the {type(self).__name__.lower()} is closed")

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            for other in self._held:
                other.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


@dataclass(frozen=True)
class TableInfo:
    id: str
    name: str
    visibility: str = "visible"


@dataclass(frozen=True)
class Metadata:
    id: str
    name: str
    columns: list[tuple[str, str]]
    rows: Extent
    schema_version: int = 1


@dataclass(frozen=True)
class Capabilities:
    """What an adapter can do; none sorts or filters, since Spark does that on the frames it gives."""

    adapter: str
    range_read: bool = True
    presentation: bool = False
    diagnostics: bool = False
    sort: bool = False
    filter: bool = False
    max_range_cells: int = MAX_RANGE_CELLS


@dataclass
class Sample:
    operation: str
    seconds: float
    cells: int = 0


@dataclass
class Cache:
    """Collected windows, the least recently used going first; only complete ones are kept."""

    most_bytes: int
    held: OrderedDict = field(default_factory=OrderedDict)
    size: int = 0

    def get(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        return None

    def put(self, key, value, n: int) -> None:
        if n > self.most_bytes:
            return
        self.drop(lambda k: k == key)
        self.held[key] = value, n
        self.size += n
        while self.size > self.most_bytes:
            self.size -= self.held.popitem(last=False)[1][1]

    def drop(self, which: Callable) -> None:
        for k in [k for k in self.held if which(k)]:
            self.size -= self.held.pop(k)[1]


class Engine(_Closing):
    """Opens sources; ``memory_bytes`` bounds the cache of collected windows by its share."""

    def __init__(self, spark: SparkSession, adapters: tuple[str, ...] = ADAPTERS, memory_bytes: int = 256 << 20):
        super().__init__()
        unknown = set(adapters) - set(ADAPTERS)
        if unknown:
            raise PreviewError("INVALID_ARGUMENT", f"no adapter is named {', '.join(sorted(unknown))}")
        self.spark, self.adapters = spark, adapters
        self.cache = Cache(budget(memory_bytes)["cache"])
        self.samples: list[Sample] = []
        self._listeners: list[Callable[[Sample], None]] = []

    def subscribe_performance(self, listener: Callable[[Sample], None]) -> Callable[[], None]:
        self._open()
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None

    def _timed(self, operation: str, began: float, cells: int = 0) -> None:
        sample = Sample(operation, time.perf_counter() - began, cells)
        self.samples.append(sample)
        del self.samples[:-1000]
        for listener in list(self._listeners):
            listener(sample)

    def detect(self, path: str) -> str:
        """The adapter for a file, by its content and name."""
        self._open()
        found = sniff_table(read_bytes(self.spark, path, 512), read_bytes(self.spark, path, 6, from_end=True), path)
        if found not in BY_FORMAT:
            raise PreviewError("UNSUPPORTED_FEATURE", f"{found} is no table")
        return BY_FORMAT[found]

    def open(self, path: str, adapter: str | None = None, **options) -> Dataset:
        """A dataset of the file at ``path``. Options: ``dialect`` (delimited), ``format`` (excel)."""
        self._open()
        began = time.perf_counter()
        adapter = adapter or self.detect(path)
        if adapter not in self.adapters:
            raise PreviewError("INVALID_ARGUMENT", f"the engine has no adapter {adapter}")
        made = {"delimited": DelimitedDataset, "arrow": ArrowDataset, "parquet": ParquetDataset, "excel": ExcelDataset}[adapter](self, path, options)
        self._timed("open", began)
        return self._hold(made)


class Dataset(_Closing):
    adapter = ""
    capabilities_of: dict = {}

    def __init__(self, engine: Engine, path: str, options: dict):
        super().__init__()
        self.engine, self.spark, self.path, self.options = engine, engine.spark, path, options
        self.id = uuid.uuid4().hex

    def tables(self) -> list[TableInfo]:
        self._open()
        return self._tables()

    def _tables(self) -> list[TableInfo]:
        return [TableInfo("table-1", self.path.rstrip("/").rsplit("/", 1)[-1])]

    def open_table(self, id: str | None = None) -> Table:
        """The table with this id, the first one without."""
        known = {t.id: t for t in self.tables()}
        info = known.get(id or next(iter(known), None))
        if info is None:
            raise PreviewError("INVALID_ARGUMENT", f"there is no table {id}")
        return self._hold(Table(self, info))

    def capabilities(self) -> Capabilities:
        self._open()
        return Capabilities(self.adapter, **self.capabilities_of)

    def diagnostics(self) -> list[tuple]:
        self._open()
        return []

    def close(self) -> None:
        super().close()
        self.engine.cache.drop(lambda k: k[0] == self.id)

    # what an adapter gives of a table
    policy = "columnar"

    def columns(self, info: TableInfo) -> list[tuple[str, str]]:
        raise NotImplementedError

    def row_count(self, info: TableInfo) -> int:
        raise NotImplementedError

    def rows(self, info: TableInfo, r: Range) -> DataFrame:
        raise NotImplementedError


class ParquetDataset(Dataset):
    adapter = "parquet"

    def __init__(self, engine, path, options):
        super().__init__(engine, path, options)
        if not path.endswith("/") and not engine.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(engine.spark._jsc.hadoopConfiguration()).getFileStatus(engine.spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
            window.preflight(read_bytes(engine.spark, path, 4), read_bytes(engine.spark, path, 4, from_end=True))
        self.files = window._files(engine.spark, path)
        self.schema = engine.spark.read.parquet(path).schema

    def columns(self, info):
        return [(f.name, f.dataType.simpleString()) for f in self.schema]

    def row_count(self, info):
        return sum(n for _, _, n in self.files)

    def rows(self, info, r):
        names = self.schema.names[r.column_start : r.column_start + r.column_count]
        return window.window(self.spark, self.path, r.row_start, r.row_start + r.row_count, names, self.files)


class ArrowDataset(Dataset):
    adapter = "arrow"

    def __init__(self, engine, path, options):
        super().__init__(engine, path, options)
        self.schema = arrow_ipc.schema_of(engine.spark, path)
        self._n = None

    def columns(self, info):
        return [(f.name, str(f.type)) for f in self.schema]

    def row_count(self, info):
        if self._n is None:
            self._n = arrow_ipc.row_counts(self.spark, self.path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return self._n

    def rows(self, info, r):
        df = arrow_ipc.read(self.spark, self.path, (r.column_start, r.column_start + r.column_count), (r.row_start, r.row_start + r.row_count), window.INDEX)
        return df.orderBy(window.INDEX).drop(window.INDEX)


class DelimitedDataset(Dataset):
    adapter, policy = "delimited", "record"
    capabilities_of = {"diagnostics": True}

    def __init__(self, engine, path, options):
        super().__init__(engine, path, options)
        tsv = path.lower().endswith((".tsv", ".tab"))
        self.dialect = options.get("dialect") or delimited.Dialect("\t" if tsv else ",")
        shape = delimited._shape(engine.spark, path, self.dialect)
        _, self._n, self.names = shape[0] if shape else ("", 0, [])

    def columns(self, info):
        return [(n, "string") for n in self.names]

    def row_count(self, info):
        return self._n

    def rows(self, info, r):
        df = delimited.read(self.spark, self.path, self.dialect, self.names)
        chosen = delimited.unique_names(self.names)[r.column_start : r.column_start + r.column_count]
        inside = df.where((F.col("row") >= r.row_start) & (F.col("row") < r.row_start + r.row_count))
        return inside.orderBy("row").select(*[F.col(window._quoted(c)) for c in chosen])

    def diagnostics(self):
        self._open()
        return [tuple(r) for r in delimited.diagnostics(self.spark, self.path, self.dialect).orderBy("byte_offset").select("kind", "row", "byte_offset").limit(delimited.MAX_DIAGNOSTICS).collect()]


class ExcelDataset(Dataset):
    adapter, policy = "excel", "record"
    capabilities_of = {"presentation": True, "diagnostics": True}

    def __init__(self, engine, path, options):
        super().__init__(engine, path, options)
        self.book = xlsx.Workbook(read_bytes(engine.spark, path), options.get("format", "auto"))
        self._content: dict[str, xlsx.Content] = {}

    def _tables(self):
        return [TableInfo(s.id, s.name, s.visibility) for s in self.book.sheets]

    def content(self, id: str) -> xlsx.Content:
        if id not in self._content:
            self._content[id] = self.book.read(next(s for s in self.book.sheets if s.id == id))
        return self._content[id]

    def columns(self, info):
        from rangeview.functions.sheet import column_label

        return [(column_label(k), "string") for k in range(self.content(info.id).extent[1])]

    def row_count(self, info):
        return self.content(info.id).extent[0]

    def rows(self, info, r):
        return xlsx.wide(xlsx.cells(self.spark, self.path, info.id), *self.content(info.id).extent, r.row_start, r.row_count, r.column_start, r.column_count)

    def diagnostics(self):
        self._open()
        return self.book.diagnostics + [x for c in self._content.values() for x in c.diagnostics]


class Table(_Closing):
    def __init__(self, dataset: Dataset, info: TableInfo):
        super().__init__()
        self.dataset, self.info, self.revision = dataset, info, 1

    def metadata(self) -> Metadata:
        self._open()
        d = self.dataset
        return Metadata(self.info.id, self.info.name, d.columns(self.info), Extent("exact", d.row_count(self.info)))

    def read_range(self, row_start: int, row_count: int, column_start: int, column_count: int, display_only: bool = False) -> RangeResult:
        """Rows [row_start, +row_count) by columns [column_start, +column_count); ``display_only``: as display text of at most 16 KiB a cell."""
        self._open()
        d, began = self.dataset, time.perf_counter()
        request = Range(row_start, row_count, column_start, column_count).checked()
        names = [n for n, _ in d.columns(self.info)]
        got, complete = clamped(request, d.row_count(self.info), len(names), d.policy)
        df = d.rows(self.info, got)
        if display_only:
            df = window.displayed(df, DISPLAY_ONLY_BYTES)
        d.engine._timed("read_range", began, got.row_count * got.column_count)
        return RangeResult(df, got, complete, names[got.column_start : got.column_start + got.column_count])

    def rows(self, row_start: int, row_count: int, column_start: int, column_count: int, display_only: bool = False) -> list[tuple]:
        """The cells of a range as tuples; complete ranges are kept in the engine's cache."""
        self._open()
        cache = self.dataset.engine.cache
        key = (self.dataset.id, self.info.id, self.revision, row_start, row_count, column_start, column_count, display_only)
        held = cache.get(key)
        if held is None:
            got = self.read_range(row_start, row_count, column_start, column_count, display_only)
            held = got.rows()
            if got.complete:
                cache.put(key, held, sum(len(str(v)) + 64 for r in held for v in r))
        return held

    def presentation(self) -> dict | None:
        """How a sheet is shown: visibility, frozen rows and columns, sizes of columns and rows, styles; None for other tables."""
        self._open()
        d = self.dataset
        if not isinstance(d, ExcelDataset):
            return None
        c = d.content(self.info.id)
        return {"visibility": self.info.visibility, "frozen_rows": c.frozen[0], "frozen_columns": c.frozen[1], "columns": c.columns, "rows": c.rows, "styles": d.book.styles()}

    def presentation_range(self, row_start: int, row_count: int, column_start: int, column_count: int) -> dict | None:
        """Of a window: the style of each cell that has one, the merged regions it meets, and its sizes of rows and columns."""
        self._open()
        d = self.dataset
        if not isinstance(d, ExcelDataset):
            return None
        Range(row_start, row_count, column_start, column_count).checked()
        c = d.content(self.info.id)
        r1, c1 = row_start + row_count, column_start + column_count
        xlsx.masked(c)
        return {
            "styles": {p: s for p, s in c.styles.items() if row_start <= p[0] < r1 and column_start <= p[1] < c1},
            "merges": [m for m in c.merges if m[0] < r1 and row_start < m[1] and m[2] < c1 and column_start < m[3]],
            "rows": [x for x in c.rows if row_start <= x[0] < r1], "columns": [x for x in c.columns if column_start <= x[0] < c1],
        }

    def cancel(self, tag: str) -> None:
        """Stop the running jobs that the caller began under ``spark.addTag(tag)``; stopping twice does nothing more."""
        self.dataset.spark.interruptTag(tag)


class Preview(_Closing):
    """A text, structured or image file, opened by its content and name."""

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = 64 << 20):
        super().__init__()
        data = read_bytes(spark, path, max_bytes + 1)
        if len(data) > max_bytes:
            raise PreviewError("RESOURCE_LIMIT", f"a preview reads at most {max_bytes} bytes")
        self.spark, self.path = spark, path
        self.format = sniff_preview(data[:4096], path)
        self.image = self.encoding = self._text = self._nodes = None
        if self.format is None or self.format == "pdf":
            raise PreviewError("UNSUPPORTED_FEATURE", f"{self.format or 'this content'} has no preview")
        if self.format in ("png", "jpeg", "gif", "webp", "svg", "bmp", "tiff", "heic"):
            self.kind, self.image = "image", images.inspect(self.format, data)
            return
        self._text, self.encoding = structured.decode_text(data)
        self.kind = "structured" if self.format in ("json", "jsonl", "yaml", "xml", "toml") else "text"
        if self.kind == "structured":
            self._nodes = tree.nodes(structured.parse_structured(self.format, self._text))

    def text(self, offset: int = 0, length: int | None = None) -> str:
        self._open()
        n = len(self._text) - offset if length is None else length
        if offset < 0 or n < 0 or offset + n > len(self._text):
            raise PreviewError("INVALID_RANGE", "the range ends past the text")
        return self._text[offset : offset + n]

    def nodes(self, offset: int = 0, limit: int = 100) -> list[tuple]:
        self._open()
        tree._page(offset, limit)
        return self._nodes[offset : offset + limit]

    def children(self, node_id: int, offset: int = 0, limit: int = 100) -> list[tuple]:
        self._open()
        tree._page(offset, limit)
        return [n for n in self._nodes if n[1] == node_id][offset : offset + limit]
