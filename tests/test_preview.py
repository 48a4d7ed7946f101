import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeview.functions import sheet, text, tree
from rangeview.functions.display import display
from rangeview.model import PreviewError, Range, clamped
from rangeview.operators import window
from rangeview.plans import catalogue


def one(spark, column, kind, value, **kw):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", kind)]))
    return df.select(display(F.col("c"), kind, **kw)).head()[0]


def test_floats(spark):
    assert [one(spark, "c", T.DoubleType(), x) for x in (float("nan"), float("inf"), float("-inf"), -0.0, 1.5, 1e7, 1e-5)] == ["NaN", "Infinity", "-Infinity", "-0", "1.5", "10000000", "0.00001"]


@pytest.mark.parametrize(
    ("kind", "value", "shown"),
    [
        (T.DoubleType(), 1e20, "100000000000000000000"), (T.DoubleType(), -0.0, "-0"), (T.FloatType(), 0.1, "0.10000000149011612"), (T.BinaryType(), b"\x00\xaf", "0x00af"), (T.LongType(), None, None),
        (T.StringType(), "a\tb", "a\tb"), (T.ArrayType(T.StringType()), ["a\tb", None], '["a\\tb", null]'), (T.ArrayType(T.LongType()), [], "[]"),
        (T.TimestampNTZType(), datetime.datetime(2024, 1, 1, 8, 0, 0, 123456), "2024-01-01T08:00:00.123456"), (T.TimestampNTZType(), datetime.datetime(2024, 1, 1), "2024-01-01T00:00:00"),
    ],
)
def test_display(spark, kind, value, shown):
    assert one(spark, "c", kind, value) == shown


def test_truncation_keeps_whole_characters(spark):
    assert one(spark, "c", T.StringType(), "é" * 20, max_bytes=20) == "éé... [truncated]"
    assert one(spark, "c", T.StringType(), "abcdef", max_bytes=4) == "abcd"
    assert one(spark, "c", T.ArrayType(T.LongType()), [1, 2, 3], elements=2) == "[1, 2, ... [truncated]]"


def test_truncation_of_all_documents_equals_brute_force(spark, tmp_path):
    texts = [None, "", "a" * 64, "a" * 65, "é" * 32, "é" * 33, *("a" * k + c * 40 for k in range(5) for c in ("é", "漢", "\U0001f600"))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def shown(x):
        return x if x is None or len(x.encode()) <= 64 else x.encode()[: 64 - len("... [truncated]")].decode(errors="ignore") + "... [truncated]"

    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        want = {r.doc_id: shown(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        got = catalogue.QUERIES["display_truncate"](spark, folder).collect()
        assert len(got) == len(want) and {r.doc_id: r.text for r in got} == want


def test_ranges():
    assert clamped(Range(8, 5, 1, 9), 10, 3, "columnar") == (Range(8, 2, 1, 2), False)
    assert clamped(Range(20, 5, 0, 3), 10, 3, "record")[0].row_count == 0
    for bad, policy in ((Range(11, 1, 0, 1), "columnar"), (Range(0, 1, 0, 4), "record")):
        with pytest.raises(PreviewError) as e:
            clamped(bad, 10, 3, policy)
        assert e.value.code == "INVALID_RANGE"
    with pytest.raises(PreviewError) as e:
        Range(0, 250_001, 0, 1).checked()
    assert e.value.code == "RESOURCE_LIMIT"


def test_positions_over_many_files(spark, tmp_path):
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    rows = [r[0] for r in window.read_range(spark, str(tmp_path / "t"), 20, 50, 0, 1).df.collect()]
    assert rows == list(range(20, 70))


def test_lines_and_search(spark):
    df = spark.createDataFrame([(1, "one\r\nTwo two\n")], "k int, text string")
    assert [tuple(r) for r in text.lines(df, "k").orderBy("number").collect()] == [(1, 1, "one", 0, 3), (1, 2, "Two two", 5, 12), (1, 3, "", 13, 13)]
    assert [tuple(r) for r in text.search(df, "k", "TWO").orderBy("match").collect()] == [(1, 1, 5, 8, 2, "Two two"), (1, 2, 9, 12, 2, "Two two")]


def test_tree():
    assert tree.ordered(["b", "10", "2", "a", "01"]) == ["2", "10", "b", "a", "01"]
    assert tree.nodes({"a": [1, True], "b": None}) == [(0, None, None, "object", None, 2, 0), (1, 0, "a", "array", None, 2, 1), (2, 1, "0", "number", "1", 0, 2), (3, 1, "1", "boolean", "true", 0, 2), (4, 0, "b", "null", None, 0, 1)]
    with pytest.raises(PreviewError):
        tree.nodes([[[]]], max_depth=1)


def test_sheet(spark):
    row = spark.range(1).select(*[sheet.column_name(F.lit(i)).alias(str(i)) for i in (0, 25, 26, 701, 702, 16383)], sheet.serial_date(F.lit(43831.5)).alias("d"), sheet.serial_date(F.lit(43831.0), True).alias("e"), sheet.a1_row(F.lit("$AA$12")).alias("r"), sheet.a1_column(F.lit("$AA$12")).alias("c")).head()
    assert list(row) == ["A", "Z", "AA", "ZZ", "AAA", "XFD", "2020-01-01 12:00:00", "2024-01-02", 11, 26]
