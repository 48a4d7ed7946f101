"""Spreadsheet arithmetic: names, dates, references, geometry, selection."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangeview.model import PreviewError


def column_name(index: Column) -> Column:
    """A, B, ..., Z, AA, ... for 0, 1, ...; up to four letters."""
    letter = lambda x: F.when(x >= 0, F.char((65 + F.pmod(x, F.lit(26))).cast("long"))).otherwise("")
    steps = [index.cast("long")]
    for _ in range(3):
        steps.append(F.floor(steps[-1] / 26) - 1)
    return F.concat(*[letter(x) for x in reversed(steps)])


def column_label(index: int) -> str:
    """The name of one column, for schemas."""
    out, i = "", index + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def serial_date(serial: Column, epoch_1904: bool = False) -> Column:
    """The date text of an Excel serial number: date, with a time if there is one, with milliseconds if there are any."""
    total = F.round(serial * 86_400_000).cast("long")  # rounded first, so that a fraction next to midnight is the next day
    days, ms = F.floor(total / 86_400_000), F.pmod(total, F.lit(86_400_000))
    shifted = days if epoch_1904 else F.when(days < 60, days + 1).otherwise(days)
    date = F.date_add(F.lit("1904-01-01" if epoch_1904 else "1899-12-30").cast("date"), shifted.cast("int"))
    time = F.concat(F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.floor(ms / 60_000), F.lit(60)).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.floor(ms / 1000), F.lit(60)).cast("string"), 2, "0"))
    rest = F.pmod(ms, F.lit(1000))
    return F.concat(date.cast("string"), F.when(ms > 0, F.concat(F.lit(" "), time)).otherwise(""), F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(""))


def a1_row(ref: Column) -> Column:
    """The 0-based row of a cell reference like B12."""
    return F.regexp_extract(ref, r"^\$?[A-Za-z]{1,3}\$?([0-9]+)$", 1).try_cast("long") - 1


def a1_column(ref: Column) -> Column:
    """The 0-based column of a cell reference."""
    letters = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?[0-9]+$", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def a1_region(ref: Column) -> Column:
    """The half-open rectangle of a reference like B2:D4, or of one cell; null if it is none or its ends are turned."""
    first, last = F.split_part(ref, F.lit(":"), F.lit(1)), F.when(ref.contains(":"), F.split_part(ref, F.lit(":"), F.lit(2))).otherwise(ref)
    ends = [a1_row(first), a1_row(last) + 1, a1_column(first), a1_column(last) + 1]
    fits = ref.rlike(r"^\$?[A-Za-z]{1,3}\$?[1-9][0-9]*(:\$?[A-Za-z]{1,3}\$?[1-9][0-9]*)?$") & (ends[0] < ends[1]) & (ends[2] < ends[3])
    names = ("row_start", "row_end", "column_start", "column_end")
    return F.when(fits, F.struct(*[e.alias(n) for e, n in zip(ends, names)]))


def column_pixels(width: Column) -> Column:
    return F.floor(width * 7 + 5).cast("long")


def row_pixels(points: Column) -> Column:
    return points * 96 / 72


def axis_geometry(axis: DataFrame, default: float) -> DataFrame:
    """(index, size, position) of sparse overrides (index, size, hidden): position(i) = i default + the deltas before i."""
    size = F.when(F.col("hidden"), F.lit(0.0)).otherwise(F.coalesce(F.col("size"), F.lit(default)))
    before = W.orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    return axis.select("index", size.alias("size")).select("index", "size", (F.col("index") * default + F.coalesce(F.sum(F.col("size") - default).over(before), F.lit(0.0))).alias("position"))


def selection(anchor_row: Column, anchor_column: Column, focus_row: Column, focus_column: Column) -> list[Column]:
    """The half-open rectangle of an anchor and a focus."""
    return [F.least(anchor_row, focus_row).alias("row_start"), (F.greatest(anchor_row, focus_row) + 1).alias("row_end"), F.least(anchor_column, focus_column).alias("column_start"), (F.greatest(anchor_column, focus_column) + 1).alias("column_end")]


def scroll_to_content(offset: Column, content: float, viewport: float, most: float = 16_000_000.0) -> Column:
    """The content offset of a scroll offset on an axis that is compressed to ``most`` pixels."""
    scroll = min(content, most)
    reach, virtual = max(scroll - viewport, 0.0), max(content - viewport, 0.0)
    return F.least(F.greatest(offset.cast("double"), F.lit(0.0)), F.lit(reach)) * (virtual / reach if reach else 0.0)


MAX_MERGES = 100_000


def checked_merges(merges: DataFrame) -> list[tuple[int, int, int, int]]:
    """The regions (row_start, row_end, column_start, column_end) of one sheet; overlapping ones are PARSE_FAILED, over
    ``MAX_MERGES`` RESOURCE_LIMIT. A sweep by rows holds the column spans that are open at each row."""
    rows = [tuple(int(v) for v in r) for r in merges.select("row_start", "row_end", "column_start", "column_end").limit(MAX_MERGES + 1).collect()]
    if len(rows) > MAX_MERGES:
        raise PreviewError("RESOURCE_LIMIT", f"a sheet has at most {MAX_MERGES} merged regions")
    events = sorted([(r[0], 1, r) for r in rows] + [(r[1], 0, r) for r in rows])
    spans: list[tuple[int, int]] = []  # (column_start, column_end), sorted
    for _, opens, r in events:
        at = bisect_left(spans, (r[2], r[3]))
        if not opens:
            spans.pop(at)
            continue
        if at < len(spans) and spans[at][0] < r[3] or at and spans[at - 1][1] > r[2]:
            raise PreviewError("PARSE_FAILED", "merged regions overlap")
        spans.insert(at, (r[2], r[3]))
    return rows


def merge_mask(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (row, column, value) with the values of merged cells other than the anchor taken out.

    ``merges``: (row_start, row_end, column_start, column_end) of one sheet, as checked_merges() lets them through, so a
    cell is in one region at most and the broadcast table is bounded.
    """
    spark = cells.sparkSession
    m = F.broadcast(spark.createDataFrame(checked_merges(merges), "row_start long, row_end long, column_start long, column_end long"))
    inside = (cells.row >= m.row_start) & (cells.row < m.row_end) & (cells.column >= m.column_start) & (cells.column < m.column_end) & ((cells.row != m.row_start) | (cells.column != m.column_start))
    return cells.join(m, inside, "left").select(cells.row, cells.column, F.when(m.row_start.isNull(), cells.value).alias("value"))
