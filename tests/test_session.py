import io
import json
import struct
import zipfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangeview.functions import sheet, text, tree, view
from rangeview.functions.budget import PLACEHOLDER, Adaptive, cut, shared_out
from rangeview.functions.display import display
from rangeview.model import PreviewError, Range
from rangeview.operators import window
from rangeview.session import Engine, Preview
from rangeview.sources import arrow_ipc, delimited, images, structured, xlsx
from rangeview.sources.sniff import sniff_preview, sniff_table


def code(f, *args, **kw):
    with pytest.raises(PreviewError) as e:
        f(*args, **kw)
    return e.value.code


def workbook(sheet_xml, extra=(), names=("Visible",), types="", states=()):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f"<Types>{types}</Types>")
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"{s}/>' for k, (n, s) in enumerate(zip(names, [*states, *[""] * len(names)]), 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="1"/><sheets>{listed}</sheets></workbook>')
        kinds = ["chartsheet" if n == "Chart" else "worksheet" for n in names]
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="http://x/{t}" Target="worksheets/s{k}.xml"/>' for k, t in enumerate(kinds, 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>城市</t></si><si><r><t>a</t></r><r><t>b</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f"""<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts>
<fonts><font/><font><b val="0"/><color rgb="FF112233"/><name val="Aptos"/><sz val="12"/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="ffffcc00"/></patternFill></fill></fills>
<cellXfs><xf numFmtId="0"/><xf numFmtId="164" fontId="1" fillId="1"><alignment horizontal="center" wrapText="1"/></xf><xf numFmtId="165"/><xf numFmtId="46"/></cellXfs></styleSheet>""")
        for k in range(1, len(names) + 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}">{sheet_xml}</worksheet>')
        for name, body in extra:
            z.writestr(name, body)
    return raw.getvalue()


SHEET = """<dimension ref="A1:D4"/><sheetViews><sheetView><pane xSplit="1" ySplit="1" state="frozen"/></sheetView></sheetViews>
<cols><col min="1" max="2" width="18"/><col min="4" max="4" hidden="1"/></cols>
<sheetData><row r="1" ht="26"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>9</v></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>上海</t></is></c><c r="B2"><v>1.50</v></c><c r="C2" s="1"><v>43831</v></c></row>
<row r="3" hidden="1"><c r="A3" t="b"><v>1</v></c><c r="B3" t="e"><v>#DIV/0!</v></c><c r="C3"><f>A1</f></c></row>
<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><f>1+2</f><v>3</v></c><c r="C4" s="2"><v>1E+16</v></c><c r="D4" s="3"><v>1.25</v></c></row></sheetData>
<mergeCells><mergeCell ref="A1:B1"/></mergeCells>"""


def test_workbooks(spark, tmp_path):
    data = workbook(SHEET, names=("Visible", "Chart", "Hidden"), states=("", "", ' state="veryHidden"'))
    (tmp_path / "a.xlsx").write_bytes(data)
    with Engine(spark) as engine:
        book = engine.open(str(tmp_path / "a.xlsx"))
        assert [(t.id, t.name, t.visibility) for t in book.tables()] == [("sheet-1", "Visible", "visible"), ("sheet-2", "Hidden", "veryHidden")]
        table = book.open_table()
        assert table.metadata().columns == [(c, "string") for c in "ABCD"] and table.metadata().rows.value == 4
        got = table.read_range(0, 9, 0, 4)
        want = [("城市", None, None, None), ("上海", "1.5", "2024-01-02", None), ("TRUE", "#DIV/0!", None, None), ("ab", "3", "10000000000000000", "1.25")]
        assert [tuple(r) for r in got.df.collect()] == want and not got.complete
        assert table.rows(1, 1, 1, 2) == table.rows(1, 1, 1, 2) == [("1.5", "2024-01-02")] and len(engine.cache.held) == 1
        assert ("missing-formula-cache", "C3") in book.diagnostics() and ("skipped-sheet", "Chart") in book.diagnostics()
        shown = table.presentation()
        assert (shown["frozen_rows"], shown["frozen_columns"]) == (1, 1) and shown["columns"] == [(0, 131, False), (1, 131, False), (3, None, True)]
        assert shown["rows"] == [(0, 26 * 96 / 72, False), (2, None, True)] and shown["styles"][1]["fill_color"] == "#FFCC00" and shown["styles"][1]["bold"] and shown["styles"][1]["text_color"] == "#112233"
        part = table.presentation_range(1, 3, 2, 2)
        assert part["styles"][1, 2] == 1 and part["merges"] == [] and table.presentation_range(0, 1, 1, 1)["merges"] == [(0, 1, 0, 2)]
        assert code(table.read_range, 0, 1, 3, 2) == "INVALID_RANGE" and table.read_range(99, 1, 0, 2).df.count() == 0
    assert code(table.metadata) == code(book.tables) == code(engine.open, "x") == "HANDLE_CLOSED"
    engine.close()
    listed = xlsx.sheets(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.rows, r.columns) for r in listed] == [("sheet-1", 4, 4), ("sheet-2", 4, 4)]


def test_refused_workbooks():
    over = SHEET.replace("</mergeCells>", '<mergeCell ref="B1:C2"/></mergeCells>')
    assert code(lambda: xlsx.masked((b := xlsx.Workbook(workbook(over))).read(b.sheets[0]))) == "PARSE_FAILED"
    for data, want in (
        (b"plain", "PARSE_FAILED"), (b"PK\x03\x04 broken", "PARSE_FAILED"), (bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 64, "UNSUPPORTED_FEATURE"),
        (workbook(SHEET, types="application/vnd.ms-excel.sheet.macroEnabled.main+xml"), "UNSUPPORTED_FEATURE"), (workbook(SHEET, [("xl/workbook.bin", "x")]), "UNSUPPORTED_FEATURE"),
        (workbook(SHEET, [("mimetype", "x")]), "UNSUPPORTED_FEATURE"), (workbook(SHEET, [("../x", "x")]), "PARSE_FAILED"), (workbook(SHEET, names=("Chart",)), "UNSUPPORTED_FEATURE"),
        (workbook(SHEET, [("big", b"\0" * (3 << 20))]), "RESOURCE_LIMIT"),
    ):
        assert code(xlsx.Workbook, data) == want
    assert code(xlsx.Workbook, workbook(SHEET), "xls") == "PARSE_FAILED"
    book = xlsx.Workbook(workbook("<!DOCTYPE x>"))
    assert code(book.read, book.sheets[0]) == "PARSE_FAILED"
    assert [xlsx.date_text(x, False) for x in (1, 59, 61, 45292.5, 45291.999999999)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-01 12:00:00", "2024-01-01"]


@settings(max_examples=300, deadline=None)
@given(st.text('a,"\n\r é', max_size=24), st.booleans())
def test_fast_reader_equals_the_exact_one(t, header):
    d = delimited.Dialect(header=header)
    fast = delimited.fast_columns(t.encode(), d)
    if fast is not None:
        got = delimited.parse(t.encode(), d)
        assert fast[0] == got.names and [list(r) for r in zip(*(c.to_pylist() for c in fast[1]))] == got.rows and not got.diagnostics


def test_checkpoints_and_counts(spark, tmp_path):
    data = b'h,k\n0,a\n1,"b\nc"\n2,d\n3,e\n4,f\n'
    marks = delimited.checkpoints(data, 2)
    assert [k for k, _ in marks] == [0, 2, 4] and delimited.parse_from(data, marks, 3, 5) == [["3", "e"], ["4", "f"]] and delimited.parse_from(data, marks, 1, 1) == [["1", "b\nc"]]
    (tmp_path / "x.csv").write_bytes(b"a,a,row\n1\n2,,3,4\n")
    df = delimited.read(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["file", "row", "a", "a_2", "row_3", "column_4"]
    assert {r.kind: r.n for r in delimited.fault_counts(spark, str(tmp_path / "x.csv")).collect()} == {"ragged-row": 2}
    with Engine(spark) as engine:
        table = engine.open(str(tmp_path / "x.csv")).open_table()
        assert [c for c, _ in table.metadata().columns] == ["a", "a", "row", "column_4"] and table.rows(1, 5, 2, 2) == [("3", "4")]
        assert engine.samples and table.presentation() is None


def test_parquet_and_arrow_tables(spark, tmp_path):
    table = pa.table({"i": pa.array(range(100), pa.int64()), "s": [f"t{k}" for k in range(100)], "a b": [k / 4 for k in range(100)]})
    for k in range(3):
        pq.write_table(table.slice(k * 30, 30 if k < 2 else 40), tmp_path / f"p{k}.parquet", row_group_size=12)
    with Engine(spark) as engine:
        got = engine.open(str(tmp_path), "parquet").open_table()
        assert got.metadata().rows.value == 100 and got.rows(25, 70, 0, 1) == [(k,) for k in range(25, 95)]
        assert got.rows(98, 9, 1, 9, display_only=True) == [("t98", "24.5"), ("t99", "24.75")]
        assert code(got.rows, 101, 1, 0, 1) == "INVALID_RANGE" and got.read_range(5, 0, 0, 2).df.collect() == []
        groups = window.row_group_offsets(spark, str(tmp_path)).collect()
        assert [r.row_start for r in groups] == [0, 12, 24, 30, 42, 54, 60, 72, 84, 96] and sum(r.rows for r in groups) == 100
        assert len(engine.open(str(tmp_path / "p0.parquet")).open_table().read_range(3, 4, 0, 3).df.inputFiles()) == 1
        (tmp_path / "x").mkdir()
        odd = table.append_column("n", pa.array([1 << 60] * 100, pa.timestamp("ns"))).append_column("f", pa.array([None, *range(99)], pa.float32()).cast(pa.float16()))
        with pa.OSFile(str(tmp_path / "x" / "t.arrow"), "wb") as f, pa.ipc.new_file(f, odd.schema) as w:
            w.write_table(odd, max_chunksize=16)
        arrow = engine.open(str(tmp_path / "x" / "t.arrow")).open_table()
        assert arrow.metadata().rows.value == 100 and arrow.rows(14, 4, 0, 2) == [(k, f"t{k}") for k in range(14, 18)] and arrow.rows(0, 2, 3, 2) == [(1 << 60, None), (1 << 60, 0.0)]
        assert [r.row_start for r in arrow_ipc.row_counts(spark, str(tmp_path / "x")).orderBy("batch").collect()] == list(range(0, 100, 16))
    assert code(window.preflight, b"PAR1", b"PARE") == "UNSUPPORTED_FEATURE" and code(window.preflight, b"PARX", b"PAR1") == "PARSE_FAILED"


def test_structured_texts():
    p = structured.parse_structured
    assert p("yaml", "# c\na: 1\nb:\n  - x: y\n    z: 'q: r' # c\n  - 2.5\nc:\n  d: [1, \"a,b\"]\ne: ~\n") == {"a": 1, "b": [{"x": "y", "z": "q: r"}, 2.5], "c": {"d": [1, "a,b"]}, "e": None}
    assert p("yaml", "") is None and p("yaml", "- 1\n- true\n") == [1, True]
    for bad in ("a: &x 1\n*b", "a: 1\na: 2", "\ta: 1", "<<: x", "- 1\nb: 2", "__proto__: 1", "plain"):
        assert code(p, "yaml", bad) == "PARSE_FAILED"
    assert p("toml", "a = 1 # c\n[b.c]\nd = \"x # y\"\n'e' = [true, .5]\n") == {"a": 1, "b": {"c": {"d": "x # y", "e": [True, 0.5]}}}
    for bad in ("[[a]]", "a", "a = 1\na = 2", "a = 1\n[a]", "constructor = 1", "= 2"):
        assert code(p, "toml", bad) == "PARSE_FAILED"
    assert p("xml", "<?xml version='1.0'?>\n<!-- <x> --><a k='&lt;&#x41;'> t <b/><![CDATA[<&>]]></a>") == {"name": "a", "attributes": {"k": "<A"}, "children": [" t ", {"name": "b", "attributes": {}, "children": []}, "<&>"]}
    for bad in ("<a>", "<a></b>", "<a/><b/>", "x<a/>", "<!DOCTYPE a><a/>", "<a k=v/>", "<a k='&x;'/>", "", "<1/>"):
        assert code(p, "xml", bad) == "PARSE_FAILED"
    assert p("jsonl", '{"a":1}\r\n\n[2]') == [{"a": 1}, [2]]
    assert code(p, "jsonl", "1\nx") == code(p, "json", "[" * 100_000) == code(p, "json", "NaN") == "PARSE_FAILED" and code(p, "csv", "") == "UNSUPPORTED_FEATURE"
    assert structured.decode_text("é".encode("utf-16")) == ("é", "utf-16le") and structured.decode_text(b"\xfe\xff\x00a") == ("a", "utf-16be") and structured.decode_text(b"\xef\xbb\xbfx") == ("x", "utf-8")
    assert code(structured.decode_text, b"\xff\x00") == "PARSE_FAILED"


def test_trees_and_projection(spark):
    docs = spark.createDataFrame([(1, '{"b":1,"2":null,"1":[true]}'), (2, "[" * 5000), (3, None), (4, "x")], "k long, t string")
    got = sorted((tuple(r) for r in tree.node_table(docs, "k", "t").collect()), key=lambda r: (r[0], r[1] or 0))
    assert got == [(1, 0, None, None, "object", None, 3, 0), (1, 1, 0, "1", "array", None, 1, 1), (1, 2, 1, "0", "boolean", "true", 0, 2), (1, 3, 0, "2", "null", None, 0, 1), (1, 4, 0, "b", "number", "1", 0, 1), (2, None, None, None, "error", "RESOURCE_LIMIT" if got[5][5] == "RESOURCE_LIMIT" else "PARSE_FAILED", None, None), (4, None, None, None, "error", "PARSE_FAILED", None, None)]
    arrays = spark.createDataFrame([(1, '[{"z":"q","a":[1,{"b":2}]},{}]'), (2, '[{"n":null,"a":3}]'), (3, "[]")], "k long, t string")
    got = tree.project_array(arrays, "k", "t")
    assert got.columns == ["k", "position", "z", "a", "n"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "q", '[1,{"b":2}]', None), (1, 1, None, None, None), (2, 0, None, "3", None)]
    assert code(tree.project_array, arrays.union(spark.createDataFrame([(9, "[1]")], "k long, t string")), "k", "t") == "PARSE_FAILED"


def test_images_and_formats(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 2, 0, 0, 0) + zlib.compress(b"x")
    gif, bmp = b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0\x2c\0", b"BM" + b"\0" * 16 + struct.pack("<ii", 6, -8)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 11, 12) + b"\0" * 9
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (8).to_bytes(3, "little")
    size = lambda d, name=None: (lambda i: (i.width, i.height, i.frames, i.media_type))(images.inspect(sniff_preview(d, name), d))
    assert [size(d) for d in (png, gif, bmp, jpeg, webp)] == [(7, 5, None, "image/png"), (3, 4, 1, "image/gif"), (6, 8, None, "image/bmp"), (12, 11, None, "image/jpeg"), (10, 9, None, "image/webp")]
    assert size(b'<svg width="20px" height="4.5">') == (20, 4.5, None, "image/svg+xml") and size(b"II*\0....") == (None, None, None, "image/tiff")
    assert code(images.inspect, "svg", b"<svg onload='x'>") == "PARSE_FAILED" and code(images.inspect, "png", png, 10) == "RESOURCE_LIMIT"
    assert [sniff_preview(h, n) for h, n in ((b"a: 1", "x.yml"), (b"{}", "x.txt"), (b"", None), (b"\0\1\2", "x.png"), (b"\0\1\2", None), (b"# t", "b.md?x"), (b"<a>", "x.svg"), (b"....ftypheic", None))] == ["yaml", "json", "text", "png", None, "markdown", "svg", "heic"]
    assert [sniff_table(h, t, n) for h, t, n in ((b"x", b"ARROW1", None), (b"a\tb", b"", "q.TSV"), (b"PK..", b"", None), (b"%PDF-1", b"", None))] == ["arrow", "tsv", "xlsx", "pdf"]
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.svg").write_bytes(b"<svg><script>")
    rows = images.inspect_all(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path").collect()
    assert [(r.width, r.media_type, r.error) for r in rows] == [(7.0, "image/png", None), (None, None, "PARSE_FAILED")]
    (tmp_path / "c.json").write_bytes(json.dumps({"a": [1, 2]}).encode())
    with Preview(spark, str(tmp_path / "c.json")) as p:
        assert p.kind == "structured" and len(p.nodes()) == 4 and [n[4] for n in p.children(1)] == ["1", "2"] and p.text(0, 2) == '{"' and code(p.text, 0, 99) == "INVALID_RANGE"
    assert code(p.nodes) == "HANDLE_CLOSED" and Preview(spark, str(tmp_path / "a.png")).image.width == 7 and code(Preview, spark, str(tmp_path / "none")) == "SOURCE_UNAVAILABLE"


def test_text_operators(spark):
    docs = spark.createDataFrame([(1, "aXa\r\nb.\\E.b\n"), (2, None), (3, "")], "k long, t string")
    assert sorted(map(tuple, text.lines(docs, "k", "t").collect())) == [(1, 1, "aXa", 0, 3), (1, 2, "b.\\E.b", 5, 11), (1, 3, "", 12, 12), (3, 1, "", 0, 0)]
    assert [tuple(r) for r in text.search(docs, "k", ".\\E.", "t").collect()] == [(1, 1, 6, 10, 2, "b.\\E.b")]
    assert [tuple(r) for r in text.search(docs, "k", "a", "t", max_results=1).collect()] == [(1, 1, 0, 1, 1, "aXa")]
    assert code(text.search, docs, "k", "", "t") == "INVALID_ARGUMENT"
    with pytest.raises(Exception, match="INVALID_RANGE"):
        docs.where("k = 1").select(text.substring(F.col("t"), 10, 5, strict=True)).collect()


def test_floats_are_positional(spark):
    from decimal import Decimal

    values = [0.0, -0.0, 1.0, 0.1, 1e7, 1.5e300, -2.5e-7, 123456789012.5, 1e21, 5e-324, 1.7976931348623157e308, 9007199254740993.0, 1e-3, 9.999e-4, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(display(F.col("d"), spark.createDataFrame([], "d double").schema["d"].dataType)).collect()]

    def want(v):
        if v != v or v in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(v)]
        t = format(Decimal(repr(v)), "f")
        return t.rstrip("0").rstrip(".") if "." in t else t

    assert got == [want(v) for v in values]


def test_views_and_sheets(spark):
    def brute(rect, merges):
        while True:
            new = rect
            for m in merges:
                if view.meets(new, m):
                    new = min(new[0], m[0]), max(new[1], m[1]), min(new[2], m[2]), max(new[3], m[3])
            if new == rect:
                return rect
            rect = new

    merges = [(0, 2, 0, 2), (1, 4, 3, 5), (3, 6, 1, 3), (9, 10, 9, 12)]
    for rect in [(r, r + 1, c, c + 1) for r in range(7) for c in range(6)] + [(1, 2, 1, 4)]:
        assert view.expanded(rect, merges) == brute(rect, merges)
    axis = view.Axis(6, 10.0, [(1, 4.0, False), (3, None, True), (4, 25.0, False)])
    sizes = [10, 4, 10, 0, 25, 10]
    assert [axis.position(i) for i in range(7)] == [sum(sizes[:i]) for i in range(7)] and axis.total() == 59
    assert [axis.at(x) for x in (-5, 0, 9.9, 10, 23.9, 24, 48, 49, 99)] == [0, 0, 0, 1, 2, 4, 4, 5, 5] and axis.next_visible(3) == 4
    assert axis.visible(10, 14) == (1, 3) and axis.visible(0, 0) == (0, 0) and view.Axis(0, 5.0).at(1) is None
    plan = view.planned((20, 30), (5, 8), 100, 10, (1, 1), [(2, 25, 6, 7), (40, 50, 0, 1)])
    assert plan == [(0, 1, 0, 1), (0, 1, 4, 9), (12, 38, 0, 1), (12, 38, 4, 9), (2, 3, 6, 7)]
    assert view.planned((20, 30), (5, 8), 100, 10, max_cells=30) == [(20, 30, 5, 8)] and code(view.planned, (0, 9), (0, 9), 9, 9, max_cells=9) == "RESOURCE_LIMIT"
    assert view.clamped_rect((-1, 3, 0, 9), 2, 4) == (0, 2, 0, 4) and view.clamped_rect((5, 6, 0, 1), 2, 4) is None
    m = spark.createDataFrame([(0, 2, 0, 2), (2, 4, 0, 2), (0, 4, 2, 3)], "row_start long, row_end long, column_start long, column_end long")
    assert len(sheet.checked_merges(m)) == 3 and code(sheet.checked_merges, m.union(spark.createDataFrame([(3, 9, 1, 2)], m.schema))) == "PARSE_FAILED"
    df = spark.createDataFrame([("B2:$D$4",), ("c7",), ("D4:B2",), ("A0",), ("x",)], "r string").select(sheet.a1_region(F.col("r")).alias("a"))
    assert [r.a and tuple(r.a) for r in df.collect()] == [(1, 4, 1, 4), (6, 7, 2, 3), None, None, None]
    dates = spark.createDataFrame([(45291.999999999,), (45292.5,)], "d double").select(sheet.serial_date(F.col("d")).alias("t"))
    assert [r.t for r in dates.collect()] == ["2024-01-01", "2024-01-01 12:00:00"]
    assert spark.range(18278, 18280).select(sheet.column_name(F.col("id")).alias("n")).collect()[0].n == "AAAA" == sheet.column_label(18278)


def test_budgets_and_halving():
    assert cut("é" * 20, 20) == "éé... [truncated]" and cut("abcdef", 3) == "abc" and cut("é", 1) == ""
    columns = [["a" * 100, None, "b"], ["c" * 10, "d" * 10, "e" * 10]]
    got = shared_out(columns, 60)
    assert got[0] == ["a" * 12, None, "b"] and got[1] == ["c" * 10, "d" * 10, "e" * 10] and sum(len(t or "") for c in got for t in c) <= 60
    calls = []

    def read(r):
        calls.append((r.row_count, r.column_count))
        if r.row_count * r.column_count > 12 or r.row_start <= 7 < r.row_start + r.row_count and r.column_start <= 2 < r.column_start + r.column_count:
            raise PreviewError("RESOURCE_LIMIT", "too much")
        return [[(i, j) for j in range(r.column_start, r.column_start + r.column_count)] for i in range(r.row_start, r.row_start + r.row_count)]

    reader = Adaptive(read)
    got = reader.rows(Range(0, 10, 0, 4))
    assert got == [[PLACEHOLDER if (i, j) == (7, 2) else (i, j) for j in range(4)] for i in range(10)] and reader.most_rows == 4
