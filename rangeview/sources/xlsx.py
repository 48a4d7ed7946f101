"""XLSX workbooks: worksheets, cell texts, merged regions, and how a sheet is shown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeview.model import PreviewError

MAX_PARTS, MAX_PART_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 10_000, 512 << 20, 2 << 30, 1000
# Namespaces, the content types that are refused, and the built-in number formats of dates and durations.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REFUSED = {"macroEnabled": "macro-enabled workbooks", "sheet.binary": "binary workbooks"}
DATE_FORMATS, DURATION_FORMATS = (*range(14, 23), 45, 47), (46,)
HORIZONTAL = ("left", "center", "right", "fill", "justify", "centerContinuous", "distributed")


def _no(message: str) -> PreviewError:
    return PreviewError("UNSUPPORTED_FEATURE", f"{message} are not read")


def _bad(message: str) -> PreviewError:
    return PreviewError("PARSE_FAILED", message)


def number_text(x: float) -> str:
    return np.format_float_positional(np.float64(x), unique=True, trim="-")


def date_text(serial: float, epoch_1904: bool) -> str:
    """The date of a serial number, with a time if there is one, with milliseconds if there are any."""
    if not epoch_1904 and serial < 60:
        serial += 1  # the calendar that counts a 29 February 1900 is a day ahead after it
    at = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    try:
        at += timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return number_text(serial)
    text = f"{at.year:04}-{at.month:02}-{at.day:02}"
    if at.hour or at.minute or at.second or at.microsecond:
        text += f" {at.hour:02}:{at.minute:02}:{at.second:02}" + (f".{at.microsecond // 1000:03}" if at.microsecond else "")
    return text


def cell_place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})", ref)
    if not m:
        raise _bad(f"{ref} is no cell")
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


def region(ref: str) -> tuple[int, int, int, int]:
    """(row_start, row_end, column_start, column_end), ends exclusive."""
    a, _, b = ref.partition(":")
    (r0, c0), (r1, c1) = cell_place(a), cell_place(b or a)
    if r1 < r0 or c1 < c0:
        raise _bad(f"{ref} is no region")
    return r0, r1 + 1, c0, c1 + 1


@dataclass(frozen=True)
class Sheet:
    id: str
    name: str
    visibility: str
    part: str


@dataclass
class Content:
    """What one worksheet holds."""

    cells: dict[tuple[int, int], str | None] = field(default_factory=dict)
    styles: dict[tuple[int, int], int] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    columns: list[tuple[int, int | None, bool]] = field(default_factory=list)
    rows: list[tuple[int, float | None, bool]] = field(default_factory=list)
    frozen: tuple[int, int] = (0, 0)
    extent: tuple[int, int] = (0, 0)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)

    def grow(self, rows: int, columns: int) -> None:
        self.extent = max(self.extent[0], rows), max(self.extent[1], columns)


def container(data: bytes, hint: str = "auto") -> str:
    """xlsx or xls by the leading bytes; a hint only restricts what may be found."""
    found = "xlsx" if data.startswith(b"PK\x03\x04") else "xls" if data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")) else None
    if found is None or hint not in ("auto", found):
        raise _bad("the file is no workbook of the format asked for")
    return found


class Workbook:
    """A workbook given as bytes; parts are read one at a time, and only those that are asked for."""

    def __init__(self, data: bytes, hint: str = "auto"):
        if container(data, hint) == "xls":
            raise _no("encrypted workbooks" if "EncryptedPackage".encode("utf-16-le") in data else "XLS workbooks")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
            raise _bad("the workbook is no ZIP container") from e
        self.parts = {}
        total = 0
        for i in self.zip.infolist():
            name = i.filename
            if name.startswith("/") or "\\" in name or ".." in name.split("/") or "\0" in name or name.lower() in self.parts:
                raise _bad("the workbook has an unsafe or repeated part name")
            total += i.file_size
            if len(self.parts) >= MAX_PARTS or i.file_size > MAX_PART_BYTES or total > MAX_TOTAL_BYTES or i.file_size > (1 << 20) and i.file_size > MAX_RATIO * max(i.compress_size, 1):
                raise PreviewError("RESOURCE_LIMIT", "the workbook unpacks to too much")
            self.parts[name.lower()] = i
        if "mimetype" in self.parts:
            raise _no("OpenDocument sheets")
        if "xl/workbook.bin" in self.parts:
            raise _no("binary workbooks")
        types = self.raw("[Content_Types].xml").decode("utf-8", "replace")
        for sign, what in REFUSED.items():
            if sign in types:
                raise _no(what)
        if "xl/workbook.xml" not in self.parts:
            raise _bad("the container holds no workbook")
        book = self.xml("xl/workbook.xml")
        self.epoch_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{MAIN}workbookPr"))
        links = {r.get("Id"): r for r in self.xml("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in self.parts else {}
        self.sheets: list[Sheet] = []
        self.diagnostics: list[tuple[str, str]] = []
        for s in book.iter(f"{MAIN}sheet"):
            link = links.get(s.get(f"{RELATION}id"))
            if link is None or not (link.get("Type") or "").endswith("/worksheet"):
                self.diagnostics.append(("skipped-sheet", s.get("name") or ""))
                continue
            target = link.get("Target") or ""
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            self.sheets.append(Sheet(f"sheet-{len(self.sheets) + 1}", s.get("name") or "", s.get("state") or "visible", part))
        if not self.sheets:
            raise _no("workbooks without worksheets")

    def raw(self, name: str) -> bytes:
        info = self.parts.get(name.lower())
        if info is None:
            raise _bad(f"the part {name} is missing")
        try:
            return self.zip.read(info)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
            raise (_no("encrypted workbooks") if info.flag_bits & 1 else _bad(f"the part {name} is damaged")) from e

    def xml(self, name: str) -> ET.Element:
        data = self.raw(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise _bad("document types and entities are not read")
        try:
            return ET.fromstring(data)
        except ET.ParseError as e:
            raise _bad(f"the part {name} is malformed") from e

    def shared_strings(self) -> list[str]:
        """Texts of the shared table; phonetic runs are left out."""
        if "xl/sharedstrings.xml" not in self.parts:
            return []
        return [_rich(item) for item in self.xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]

    def styles(self) -> list[dict]:
        """One record for each cell format: number format, and what is set of font, fill and alignment."""
        if "xl/styles.xml" not in self.parts:
            return [{"format_id": 0, "kind": "number"}]
        root = self.xml("xl/styles.xml")
        custom = {int(n.get("numFmtId")): n.get("formatCode") or "" for n in root.iter(f"{MAIN}numFmt")}
        fonts, fills = ([*(root.find(f"{MAIN}{x}") if root.find(f"{MAIN}{x}") is not None else ())] for x in ("fonts", "fills"))
        out = []
        formats = root.find(f"{MAIN}cellXfs")
        for xf in formats if formats is not None else ():
            number = int(xf.get("numFmtId") or 0)
            record: dict = {"format_id": number, "kind": _kind(number, custom.get(number))}
            if number in custom:
                record["number_format"] = custom[number]
            k = int(xf.get("fontId") or 0)
            if k < len(fonts):
                record |= _font(fonts[k])
            k = int(xf.get("fillId") or 0)
            color = fills[k].find(f"{MAIN}patternFill/{MAIN}fgColor") if k < len(fills) else None
            if color is not None and (value := _rgb(color)):
                record["fill_color"] = value
            align = xf.find(f"{MAIN}alignment")
            if align is not None:
                if align.get("horizontal") in HORIZONTAL:
                    record["horizontal"] = align.get("horizontal")
                if align.get("vertical"):
                    record["vertical"] = align.get("vertical")
                if align.get("wrapText") in ("1", "true"):
                    record["wrap"] = True
            out.append(record)
        return out or [{"format_id": 0, "kind": "number"}]

    def read(self, sheet: Sheet) -> Content:
        """Cells, regions and axes of one worksheet; a formula without a kept value is null and noted."""
        strings, formats, out = self.shared_strings(), self.styles(), Content()
        root = self.xml(sheet.part)
        size = root.find(f"{MAIN}dimension")
        if size is not None and size.get("ref"):
            _, rows, _, columns = region(size.get("ref"))
            out.grow(rows, columns)
        pane = root.find(f"{MAIN}sheetViews/{MAIN}sheetView/{MAIN}pane")
        if pane is not None and pane.get("state", "frozen") in ("frozen", "frozenSplit"):
            out.frozen = int(float(pane.get("ySplit") or 0)), int(float(pane.get("xSplit") or 0))
        for c in root.iter(f"{MAIN}col"):
            width = float(c.get("width")) if c.get("width") else None
            pixels = int(width * 7 + 5) if width is not None and np.isfinite(width) and width >= 0 else None
            first, last = int(c.get("min") or 1), min(int(c.get("max") or 1), 16_384)
            out.columns += [(k - 1, pixels, c.get("hidden") in ("1", "true")) for k in range(first, last + 1)]
        for number, row in enumerate(root.iter(f"{MAIN}row"), 1):
            at = int(row.get("r") or number) - 1
            height = float(row.get("ht")) * 96 / 72 if row.get("ht") else None
            hidden = row.get("hidden") in ("1", "true")
            if height is not None and not (np.isfinite(height) and height >= 0):
                height = None
            if height is not None or hidden:
                out.rows.append((at, height, hidden))
            for k, cell in enumerate(row.iter(f"{MAIN}c")):
                place = cell_place(cell.get("r")) if cell.get("r") else (at, k)
                out.grow(place[0] + 1, place[1] + 1)
                style = int(cell.get("s") or 0)
                out.styles[place] = style
                value = _value(cell, strings, formats[style]["kind"] if style < len(formats) else "number", self.epoch_1904)
                if value is None and cell.find(f"{MAIN}f") is not None:
                    out.diagnostics.append(("missing-formula-cache", cell.get("r") or ""))
                if value is not None:
                    out.cells[place] = value
        for m in root.iter(f"{MAIN}mergeCell"):
            out.merges.append(region(m.get("ref") or ""))
            out.grow(out.merges[-1][1], out.merges[-1][3])
        return out


def _rich(item: ET.Element) -> str:
    return "".join([t.text or "" for t in item.findall(f"{MAIN}t")] + [t.text or "" for r in item.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")])


def _rgb(color: ET.Element) -> str | None:
    value = color.get("rgb") or ""
    return f"#{value[-6:].upper()}" if re.fullmatch(r"(?:[0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}", value) else None


def _font(font: ET.Element) -> dict:
    """What a font sets; that bold, italic or underline is named at all means that it is on."""
    out: dict = {name: True for tag, name in (("b", "bold"), ("i", "italic"), ("u", "underline")) if font.find(MAIN + tag) is not None}
    for tag, name in (("name", "font_name"), ("sz", "font_size")):
        e = font.find(MAIN + tag)
        if e is not None and e.get("val"):
            out[name] = float(e.get("val")) if tag == "sz" else e.get("val")
    color = font.find(f"{MAIN}color")
    if color is not None and (value := _rgb(color)):
        out["text_color"] = value
    return out


def _kind(number: int, code: str | None) -> str:
    """date, duration or number, by the id of a format or the letters of its code outside quotes, brackets and escapes."""
    if code is None:
        return "date" if number in DATE_FORMATS else "duration" if number in DURATION_FORMATS else "number"
    if re.search(r"\[(?:h+|m+|s+)\]", code, re.I):
        return "duration"
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code)
    return "date" if re.search(r"[ymdhs]", plain, re.I) and not re.search(r"general", plain, re.I) else "number"


def _value(cell: ET.Element, strings: list[str], kind: str, epoch_1904: bool) -> str | None:
    form = cell.get("t") or "n"
    if form == "inlineStr":
        item = cell.find(f"{MAIN}is")
        return _rich(item) if item is not None else None
    v = cell.find(f"{MAIN}v")
    if v is None or v.text is None:
        return "" if v is not None and form == "str" else None
    if form == "s":
        if not v.text.strip().isdigit() or int(v.text) >= len(strings):
            raise _bad("a shared text is missing")
        return strings[int(v.text)]
    if form == "b":
        return "TRUE" if v.text.strip() in ("1", "true") else "FALSE"
    if form in ("str", "e", "d"):
        return v.text
    try:
        number = float(v.text)
    except ValueError as e:
        raise _bad(f"{v.text} is no number") from e
    return date_text(number, epoch_1904) if kind == "date" else number_text(number)


def masked(content: Content) -> dict[tuple[int, int], str | None]:
    """The cells without those that a merged region covers; overlapping regions are PARSE_FAILED."""
    covered: set[tuple[int, int]] = set()
    out = dict(content.cells)
    taken: list[tuple[int, int, int, int]] = []
    for m in sorted(content.merges):
        taken = [t for t in taken if t[1] > m[0]]
        if any(t[2] < m[3] and m[2] < t[3] for t in taken):
            raise _bad("merged regions overlap")
        taken.append(m)
        if (m[1] - m[0]) * (m[3] - m[2]) <= len(out):
            covered |= {(r, c) for r in range(m[0], m[1]) for c in range(m[2], m[3])} - {(m[0], m[2])}
        else:
            covered |= {p for p in out if m[0] <= p[0] < m[1] and m[2] <= p[1] < m[3] and p != (m[0], m[2])}
    return {p: v for p, v in out.items() if p not in covered}


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, name, visibility, rows, columns, error) of the worksheets of each workbook; a refused one is a row with its code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for name, data in zip(p["path"], p["content"]):
                try:
                    book = Workbook(bytes(data))
                    rows += [(name, s.id, s.name, s.visibility, *book.read(s).extent, None) for s in book.sheets]
                except PreviewError as e:
                    rows.append((name, None, None, None, None, None, e.code))
            yield pd.DataFrame(rows, columns=["file", "id", "name", "visibility", "rows", "columns", "error"]).astype({"rows": "Int64", "columns": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, id string, name string, visibility string, rows long, columns long, error string")


def cells(spark: SparkSession, path: str, sheet: str = "sheet-1") -> DataFrame:
    """(file, row, column, value, style) of one worksheet of each workbook that has it; covered cells of merged regions have no value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, data in zip(p["path"], p["content"]):
                book = Workbook(bytes(data))
                for s in book.sheets:
                    if s.id == sheet:
                        content = book.read(s)
                        shown = masked(content)
                        yield pd.DataFrame([(name, *at, shown.get(at), style) for at, style in sorted(content.styles.items())], columns=["file", "row", "column", "value", "style"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row long, column long, value string, style int")


def wide(cell_table: DataFrame, rows: int, columns: int, row_start: int = 0, row_count: int | None = None, column_start: int = 0, column_count: int | None = None) -> DataFrame:
    """A window of one workbook's cells as a table of columns A, B, C ...: every row of the window, null where no cell is."""
    from rangeview.functions.sheet import column_label

    last = rows if row_count is None else min(rows, row_start + row_count)
    many = columns - column_start if column_count is None else column_count
    spark = cell_table.sparkSession
    inside = cell_table.where((F.col("row") >= row_start) & (F.col("row") < last))
    names = [column_label(column_start + k) for k in range(many)]
    values = [F.max(F.when(F.col("column") == column_start + k, F.col("value"))).alias(n) for k, n in enumerate(names)]
    every = spark.range(row_start, max(last, row_start)).withColumnRenamed("id", "row")
    if not values:
        return every.orderBy("row").select()
    return every.join(inside.groupBy("row").agg(*values), "row", "left").orderBy("row").select(*names)
