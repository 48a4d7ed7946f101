import pyarrow as pa
import pytest

from rangeview.model import PreviewError
from rangeview.sources import arrow_ipc, delimited
from rangeview.sources.delimited import Dialect, parse
from rangeview.sources.sniff import sniff_table


def test_ragged_lenient_widens_and_tells_missing_from_empty():
    got = parse(b"a,b\n1\n2,,3\n")
    assert got.names == ["a", "b", "column_3"] and got.schema_version == 2
    assert got.rows == [["1", None, None], ["2", "", "3"]]
    assert got.diagnostics == [("ragged-row", 0, 4), ("ragged-row", 1, 6)]


@pytest.mark.parametrize(("data", "kind", "offset"), [(b"a,b\n1\n", "ragged-row", 4), (b'a,b\n1,ab"cd\n', "malformed-quote", 8), (b"a\n\xe9x\n", "invalid-utf8", 2)])
def test_strict_fails_on_the_first_fault(data, kind, offset):
    with pytest.raises(PreviewError) as e:
        parse(data, Dialect(strict=True))
    assert e.value.code == "PARSE_FAILED" and e.value.details["kind"] == kind and e.value.details["byte_offset"] == offset


def test_quotes_bom_and_line_ends():
    got = parse(b'\xef\xbb\xbfname,note\r\n"a ""b""","x\r\ny, z"\r\nlast,', Dialect(strict=True))
    assert got.names == ["name", "note"] and got.rows == [['a "b"', "x\r\ny, z"], ["last", ""]]


def test_header_only_empty_and_headerless():
    assert (parse(b"a,b\n").rows, parse(b"a,b\n").schema_version) == ([], 1)
    assert (parse(b"").names, parse(b"").schema_version) == ([], 0)
    got = parse(b"1,\n,2\n", Dialect(header=False, strict=True))
    assert got.names == ["column_1", "column_2"] and got.rows == [["1", ""], ["", "2"]]
    assert parse("甲\t乙\n一\t\n".encode(), Dialect("\t")).rows == [["一", ""]]


def test_lossy_text_and_options():
    got = parse(b"c\n\xe9akman\n")
    assert got.rows == [["�akman"]] and [d[0] for d in got.diagnostics] == ["invalid-utf8"]
    with pytest.raises(PreviewError):
        Dialect('"')


def test_delimited_frames(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n1\n2,,3\n")
    df = delimited.read(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in df.orderBy("row").select("a", "b", "column_3").collect()] == [("1", None, None), ("2", "", "3")]
    assert delimited.diagnostics(spark, str(tmp_path / "x.csv")).count() == 2


@pytest.mark.parametrize("kind", ["file", "stream"])
def test_arrow_containers(spark, tmp_path, kind):
    table = pa.table({"i": pa.array([1, None, 3], pa.int64()), "d": pa.array(["x", "y", None]).dictionary_encode()})
    with pa.OSFile(str(tmp_path / "a"), "wb") as f, (pa.ipc.new_file if kind == "file" else pa.ipc.new_stream)(f, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    assert arrow_ipc.container((tmp_path / "a").read_bytes()) == kind
    assert sorted(map(tuple, arrow_ipc.read(spark, str(tmp_path / "a")).collect()), key=str) == sorted([(1, "x"), (None, "y"), (3, None)], key=str)
    with pytest.raises(PreviewError):
        arrow_ipc.open_ipc(b"not arrow at all")


def test_signatures():
    assert sniff_table(b"PAR1....") == "parquet" and sniff_table(b"plain text") == "csv" and sniff_table(b"\x00\x01\x02") == "unknown-binary"
