"""The core query: a rectangular window of a table, by position."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeview.functions.display import display
from rangeview.model import MAX_RANGE_CELLS, PreviewError, Range, RangeResult, clamped

INDEX = "__row"


#: Files whose footers the driver reads one after the other; of more, a job counts the rows.
FOOTERS = 1000


@dataclass(frozen=True)
class RowGroup:
    file: str
    group: int
    row_start: int
    rows: int
    bytes: int


def row_groups(spark: SparkSession, files: list[str]) -> list[RowGroup]:
    """The row groups of Parquet files in order, with the rows before each over all files; only footers are read."""
    jvm, conf, out, before = spark._jvm, spark._jsc.hadoopConfiguration(), [], 0
    for f in files:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
        try:
            for k, block in enumerate(reader.getFooter().getBlocks()):
                out.append(RowGroup(f, k, before, block.getRowCount(), block.getTotalByteSize()))
                before += block.getRowCount()
        finally:
            reader.close()
    return out


def row_group_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, group, row_start, rows, bytes) of every row group of a table of at most FOOTERS files."""
    files = sorted(spark.read.parquet(path).inputFiles())
    if len(files) > FOOTERS:
        raise PreviewError("RESOURCE_LIMIT", f"footers of at most {FOOTERS} files are listed")
    found = [(g.file, g.group, g.row_start, g.rows, g.bytes) for g in row_groups(spark, files)]
    return spark.createDataFrame(found, "file string, group int, row_start long, rows long, bytes long")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, rows before it, rows) of a Parquet table, by path: from the footers, or by a job where there are very many."""
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    if len(files) <= FOOTERS:
        sizes = dict.fromkeys(files, 0)
        for g in row_groups(spark, files):
            sizes[g.file] += g.rows
        pairs = list(sizes.items())
    else:
        rows = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect()
        pairs = [(r.f, r.n) for r in rows]
    starts = [0, *accumulate(n for _, n in pairs)]
    return [(f, at, n) for (f, n), at in zip(pairs, starts)]


def extent(spark: SparkSession, path: str) -> tuple[int, int]:
    """Exact rows and columns; the row count comes from the footers."""
    return sum(n for _, _, n in _files(spark, path)), len(spark.read.parquet(path).columns)


def window(spark: SparkSession, path: str, row_start: int, row_end: int, names: list[str], files: list[tuple[str, int, int]]) -> DataFrame:
    """Rows [row_start, row_end) in order. Only files that hold some of them are opened, and only ``names`` are scanned; a
    file's own row index does the rest, so what is read beyond the window is at most the files at its two ends."""
    schema = spark.read.parquet(path).schema
    out = None
    for f, before, n in files:
        if before < row_end and row_start < before + n:
            index = F.col("_metadata.row_index")
            one = spark.read.schema(schema).parquet(f).select(*[F.col(_quoted(c)) for c in names], (index + before).alias(INDEX)).where((index >= row_start - before) & (index < row_end - before))
            out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], schema).select(*[F.col(_quoted(c)) for c in names])
    return out.orderBy(INDEX).drop(INDEX)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def read_range(spark: SparkSession, path: str, row_start: int, row_count: int, column_start: int, column_count: int, policy: str = "columnar", max_cells: int = MAX_RANGE_CELLS) -> RangeResult:
    """Rows [row_start, +row_count) by columns [column_start, +column_count) in file order; only those columns are scanned."""
    request = Range(row_start, row_count, column_start, column_count).checked(max_cells)
    files, all_names = _files(spark, path), spark.read.parquet(path).columns
    got, complete = clamped(request, sum(n for _, _, n in files), len(all_names), policy)
    names = all_names[got.column_start : got.column_start + got.column_count]
    return RangeResult(window(spark, path, got.row_start, got.row_start + got.row_count, names, files), got, complete, names)


def preflight(head: bytes, tail: bytes) -> None:
    """Refuse what is no readable Parquet file by its first four and last four bytes: encrypted footers are unsupported."""
    if tail == b"PARE" or head == b"PARE":
        raise PreviewError("UNSUPPORTED_FEATURE", "encrypted footers are not read")
    if head != b"PAR1" or tail != b"PAR1":
        raise PreviewError("PARSE_FAILED", "the file does not begin and end as Parquet does")


def displayed(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All columns as display text."""
    return df.select(*[display(F.col(f"`{f.name}`"), f.dataType, max_bytes).alias(f.name) for f in df.schema])


def tiles(rows: int, columns: int, tile_rows: int, tile_columns: int, spark: SparkSession) -> DataFrame:
    """The grid of tiles that cover a table, cut at multiples of the tile's size."""
    r = spark.range(-(-rows // tile_rows)).select((F.col("id") * tile_rows).alias("row_start"))
    c = F.explode(F.sequence(F.lit(0), F.lit(max(columns - 1, 0)), F.lit(tile_columns))).alias("c")
    if not columns:
        r = r.limit(0)
    return r.select("row_start", c).select("row_start", F.col("c").cast("long").alias("column_start")).select(
        "row_start", F.least(F.lit(tile_rows), F.lit(rows) - F.col("row_start")).cast("long").alias("row_count"),
        "column_start", F.least(F.lit(tile_columns), F.lit(columns) - F.col("column_start")).cast("long").alias("column_count"),
    )


def tsv(df: DataFrame) -> DataFrame:
    """One text per row: fields parted by tabs, null as nothing, quoted if they hold a tab, CR, LF or a quote."""
    # display texts first, so that each is worked out once and the quoting looks at a column
    shown = df.select(*[display(F.col(_quoted(f.name)), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)])
    return shown.select(F.concat_ws("\t", *[tsv_field(F.col(c)) for c in shown.columns]).alias("line"))


def tsv_field(c):
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[\t\r\n"]'), quoted).otherwise(c), F.lit(""))
