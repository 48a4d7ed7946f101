"""The registered queries of the preview engine and the SQL that each must equal."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeview.functions import sheet, text, tree, view
from rangeview.functions.display import display
from rangeview.operators.window import displayed, extent, read_range, row_group_offsets, tiles, tsv, tsv_field
from rangeview.sources import delimited
from rangeview.sources.sniff import sniff_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    """Register a query under its function's name with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return displayed(read_range(spark, f"{d}/lineitem.parquet", 1000, 100, 0, 11).df)


_ROW = "(SELECT *, row_number() OVER () - 1 AS i FROM {})"


@query(f"SELECT l_orderkey, l_partkey FROM {_ROW.format('lineitem')} WHERE i BETWEEN 1000 AND 1099")
def range_rows(spark, d):
    return read_range(spark, f"{d}/lineitem.parquet", 1000, 100, 0, 2).df


@query(f"SELECT * EXCLUDE (i) FROM {_ROW.format('orders')} WHERE i >= (SELECT count(*) FROM orders) - 7")
def range_clamped_tail(spark, d):
    n = extent(spark, f"{d}/orders.parquet")[0]
    return read_range(spark, f"{d}/orders.parquet", n - 7, 100, 0, 50).df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def range_past_end_empty(spark, d):
    n = extent(spark, f"{d}/orders.parquet")[0]
    return read_range(spark, f"{d}/orders.parquet", n + 5, 10, 0, 2, policy="record").df


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE false")
def range_zero_rows(spark, d):
    return read_range(spark, f"{d}/lineitem.parquet", 5, 0, 1, 2).df


@query(f"SELECT p_brand, p_type, p_size FROM {_ROW.format('part')} WHERE i < 500")
def column_window(spark, d):
    return read_range(spark, f"{d}/part.parquet", 0, 500, 2, 3).df


@query(f"SELECT o_totalprice FROM {_ROW.format('orders')} WHERE i = 321")
def single_cell(spark, d):
    return read_range(spark, f"{d}/orders.parquet", 321, 1, 3, 1).df


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*) FROM (DESCRIBE {n})) AS column_count" for n in TABLES))
def extent_all_tables(spark, d):
    out = None
    for n in TABLES:
        df = t(spark, d, n)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT r AS row_start, least(1000, n - r) AS row_count, c AS column_start, least(4, 11 - c) AS column_count FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(range(0, (SELECT count(*) FROM lineitem), 1000)) AS r), (SELECT unnest(range(0, 11, 4)) AS c)")
def tile_grid(spark, d):
    return tiles(*extent(spark, f"{d}/lineitem.parquet"), 1000, 4, spark)


def _shown(spark, d, table, key, **columns):
    df = t(spark, d, table)
    return df.select(key, *[display(F.col(c), df.schema[c].dataType, **kw).alias(c) for c, kw in columns.items()])


@query("SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders")
def display_ints(spark, d):
    return _shown(spark, d, "orders", "o_orderkey", o_custkey={})


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def display_strings(spark, d):
    return _shown(spark, d, "customer", "c_custkey", c_name={}, c_mktsegment={})


_DOUBLE = r"regexp_replace({0}::VARCHAR, '\.0$', '')"


@query(f"SELECT l_orderkey, l_linenumber, {_DOUBLE.format('l_extendedprice')} AS price, {_DOUBLE.format('l_quantity')} AS quantity, {_DOUBLE.format('l_discount')} AS discount FROM lineitem")
def display_double(spark, d):
    show = lambda c: display(F.col(c), T.DoubleType())
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", show("l_extendedprice").alias("price"), show("l_quantity").alias("quantity"), show("l_discount").alias("discount"))


@query("SELECT event_id, regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''), '(\\.[0-9]{3})000$', '\\1') AS ts FROM events")
def display_timestamp(spark, d):
    return _shown(spark, d, "events", "event_id", ts={})


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2)::VARCHAR AS price FROM lineitem")
def display_decimal(spark, d):
    c = F.col("l_extendedprice").cast("decimal(12,2)")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", display(c, T.DecimalType(12, 2)).alias("price"))


@query("SELECT doc_id, '0x' || lower(hex(encode(text))) AS bytes FROM documents")
def display_hex(spark, d):
    return t(spark, d, "documents").select("doc_id", display(F.encode("text", "UTF-8"), T.BinaryType()).alias("bytes"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 64 THEN text ELSE left(text, 49) || '... [truncated]' END AS text FROM documents WHERE strlen(text) = length(text)")
def display_truncate_ascii(spark, d):
    df = t(spark, d, "documents").where(F.octet_length("text") == F.length("text"))
    return df.select("doc_id", display(F.col("text"), T.StringType(), 64).alias("text"))


@query()
def display_truncate(spark, d):
    """All documents within 64 bytes, whole characters only; no SQL, tested against brute force."""
    return t(spark, d, "documents").select("doc_id", display(F.col("text"), T.StringType(), 64).alias("text"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem")
def display_null(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", display(F.nullif(F.col("l_returnflag"), F.lit("N")), T.StringType()).alias("flag"))


@query("SELECT event_id, '[' || array_to_string(list_transform(range(1, 3 + event_id % 5), lambda x: x::VARCHAR)[1:4], ', ') || CASE WHEN event_id % 5 > 2 THEN ', ... [truncated]' ELSE '' END || ']' AS items FROM events")
def list_preview(spark, d):
    items = F.sequence(F.lit(1).cast("long"), F.lit(2) + F.col("event_id") % 5)
    return t(spark, d, "events").select("event_id", display(items, T.ArrayType(T.LongType()), elements=4).alias("items"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\t\\r\\n"]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def export_tsv_field(spark, d):
    return t(spark, d, "documents").select("doc_id", tsv_field(F.col("text")).alias("field"))


@query("SELECT concat_ws(chr(9), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, regexp_replace(c_acctbal::VARCHAR, '\\.0$', ''), c_mktsegment) AS line FROM customer")
def export_tsv(spark, d):
    return tsv(t(spark, d, "customer"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents)"


@query(f"SELECT doc_id, number, regexp_replace(line, '\\r$', '') AS text, s AS start, s + length(regexp_replace(line, '\\r$', '')) AS \"end\" FROM (SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM {_LINES})")
def text_lines(spark, d):
    return text.lines(t(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents")
def line_count(spark, d):
    return t(spark, d, "documents").select("doc_id", text.line_count(F.col("text")).alias("n"))


@query("SELECT doc_id, substr(text, 11, 40) AS part FROM documents")
def text_substring(spark, d):
    return t(spark, d, "documents").select("doc_id", text.substring(F.col("text"), 10, 40).alias("part"))


@query("SELECT doc_id, (len(string_split(lower(text), 'the')) - 1)::BIGINT AS n FROM documents WHERE contains(lower(text), 'the')")
def text_search_count(spark, d):
    n = text.search_count(F.col("text"), "The").alias("n")
    return t(spark, d, "documents").select("doc_id", n).where("n > 0")


@query("""SELECT doc_id, k::BIGINT AS match, s::BIGINT AS start, (s + 5)::BIGINT AS "end", len(string_split(left(f, s::BIGINT), chr(10)))::BIGINT AS line,
left(regexp_replace(string_split(text, chr(10))[len(string_split(left(f, s::BIGINT), chr(10)))], '\\r$', ''), 500) AS preview FROM (
SELECT doc_id, text, f, k, sum(length(p) + 5) OVER (PARTITION BY doc_id ORDER BY k) - 5 AS s, n FROM (
SELECT doc_id, text, lower(text) AS f, len(string_split(lower(text), 'tion ')) AS n, unnest(string_split(lower(text), 'tion ')) AS p, generate_subscripts(string_split(lower(text), 'tion '), 1) AS k FROM documents)) WHERE k < n AND k <= 1000""")
def text_search_matches(spark, d):
    return text.search(t(spark, d, "documents"), "doc_id", "tion ")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def json_value(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""SELECT event_id, 0::BIGINT AS id, NULL::BIGINT AS parent_id, NULL::VARCHAR AS key, 'object' AS type, NULL::VARCHAR AS value, len(json_keys(props::JSON))::BIGINT AS child_count, 0::BIGINT AS depth FROM events
UNION ALL SELECT event_id, 1, 0, 'k', 'number', props::JSON->>'$.k', 0, 1 FROM events""")
def json_nodes(spark, d):
    return tree.node_table(t(spark, d, "events"), "event_id", "props")


@query("SELECT event_id, unnest(json_keys(props::JSON)) AS key FROM events")
def json_keys(spark, d):
    nodes = tree.node_table(t(spark, d, "events"), "event_id", "props")
    return nodes.where("parent_id = 0").select("event_id", "key")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::BIGINT AS position, turn::VARCHAR AS turn, role, text FROM conversations")
def project_array(spark, d):
    """A JSON array of objects for each conversation, whole texts included, projected back to rows; columns are the union of keys."""
    item = F.struct("turn", "role", "text")
    doc = t(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("doc"))
    return tree.project_array(doc, "conv_id", "doc", limit=None).select("conv_id", "position", "turn", "role", "text")


@query("SELECT 'k' AS name, min(event_id) AS first_event FROM events")
def key_union(spark, d):
    """Field names over all documents by where they are first seen."""
    doc = t(spark, d, "events").select("event_id", F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("doc"))
    found = tree.key_union(tree.array_rows(doc, "event_id", "doc"), "event_id")
    return found.select("name", F.col("first.event_id").alias("first_event"))


@query("SELECT event_id, 1::BIGINT AS id, 'k' AS key, props::JSON->>'$.k' AS value FROM events")
def node_page(spark, d):
    nodes = tree.node_table(t(spark, d, "events"), "event_id", "props")
    return tree.node_page(nodes, 1, 100).select("event_id", "id", "key", "value")


@query("SELECT page_id, CASE WHEN lower(ltrim(html, chr(10) || chr(13) || chr(9) || ' ')) LIKE '<svg%' THEN 'svg' WHEN regexp_matches(ltrim(html, chr(10) || chr(13) || chr(9) || ' '), '^<([?]xml|[A-Za-z_][A-Za-z0-9_:.-]*[ />])') THEN 'xml' ELSE 'text' END AS format FROM pages")
def sniff_pages(spark, d):
    return t(spark, d, "pages").select("page_id", sniff_text(F.col("html")).alias("format"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'xml' WHEN 1 THEN 'svg' WHEN 2 THEN 'jsonl' WHEN 3 THEN 'json' WHEN 4 THEN 'json' WHEN 5 THEN 'xml' ELSE 'text' END AS format FROM events")
def sniff_markup(spark, d):
    """The rules for markup and JSON on texts made of each event's properties."""
    p = F.col("props")
    texts = [F.concat(F.lit("<html>"), p), F.concat(F.lit("<?xml version='1.0'?>\n <svg>"), p), F.concat(p, F.lit("\n\n"), p), F.concat(F.lit("  {"), p), F.concat(F.lit("["), p), F.concat(F.lit("<?xml?><a>"), p), F.concat(F.lit("< b>"), p)]
    k = F.col("event_id") % 7
    chosen = F.when(k == 0, texts[0])
    for i, x in enumerate(texts[1:], 1):
        chosen = chosen.when(k == i, x)
    return t(spark, d, "events").select("event_id", sniff_text(chosen).alias("format"))


@query("SELECT event_id, 'json' AS format FROM events")
def sniff_props(spark, d):
    return t(spark, d, "events").select("event_id", sniff_text(F.col("props")).alias("format"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: (x::DECIMAL(18,3))::VARCHAR), ', ') || CASE WHEN len(embedding) > 4 THEN ', ... [truncated]' ELSE '' END || ']' AS items FROM embeddings")
def list_preview_vectors(spark, d):
    """The first elements of every vector, to three places."""
    shown = F.transform("embedding", lambda x: x.cast("decimal(18,3)"))
    return t(spark, d, "embeddings").select("vec_id", display(shown, T.ArrayType(T.DecimalType(18, 3)), elements=4).alias("items"))


_MOVES = "(CASE l_linenumber % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'page-up' WHEN 3 THEN 'page-down' WHEN 4 THEN 'row-end' ELSE 'table-start' END)"
_IN_ROWS, _IN_COLUMNS = "greatest(0, least({}, 9999))", "greatest(0, least({}, 24))"


@query(f"""SELECT l_orderkey, l_linenumber, CASE k WHEN 'page-up' THEN {_IN_ROWS.format('r - 30')} WHEN 'page-down' THEN {_IN_ROWS.format('r + 30')} WHEN 'table-start' THEN 0 ELSE r END AS "row",
CASE k WHEN 'left' THEN {_IN_COLUMNS.format('c - 1')} WHEN 'right' THEN {_IN_COLUMNS.format('c + 1')} WHEN 'row-end' THEN 24 ELSE c END AS "column"
FROM (SELECT l_orderkey, l_linenumber, {_MOVES} AS k, {_IN_ROWS.format('l_partkey')} AS r, {_IN_COLUMNS.format('l_quantity::BIGINT')} AS c FROM lineitem)""")
def navigation(spark, d):
    k = F.col("l_linenumber") % 6
    command = F.when(k == 0, "left").when(k == 1, "right").when(k == 2, "page-up").when(k == 3, "page-down").when(k == 4, "row-end").otherwise("table-start")
    to = view.moved(F.col("l_partkey"), F.round("l_quantity").cast("long"), command, 10_000, 25, 30)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", to.alias("to")).select("l_orderkey", "l_linenumber", "to.row", "to.column")


@query("SELECT name, (SELECT count(*) FROM lineitem) AS rows FROM (SELECT 'lineitem' AS name)")
def row_group_extent(spark, d):
    """Rows of the row groups, which are read from the footers alone."""
    groups = row_group_offsets(spark, f"{d}/lineitem.parquet")
    return groups.agg(F.max(F.col("row_start") + F.col("rows")).alias("rows")).select(F.lit("lineitem").alias("name"), "rows")


@query("SELECT p_partkey, p_partkey AS row_start, p_partkey + p_size AS row_end, (p_size % 26)::BIGINT AS column_start, (p_size % 26 + 27)::BIGINT AS column_end FROM part WHERE p_size > 0")
def a1_regions(spark, d):
    letter = lambda k: F.char(F.lit(65) + F.col("p_size").cast("long") % 26 + k)
    key = F.col("p_partkey")
    ref = F.concat(letter(0), (key + 1).cast("string"), F.lit(":$A"), letter(0), F.lit("$"), (key + F.col("p_size")).cast("string"))
    return t(spark, d, "part").where("p_size > 0").select("p_partkey", sheet.a1_region(ref).alias("at")).select("p_partkey", "at.row_start", "at.row_end", "at.column_start", "at.column_end")


_NAME = "CASE WHEN i >= 702 THEN chr((65 + (i // 26 - 1) // 26 - 1)::INT) ELSE '' END || CASE WHEN i >= 26 THEN chr((65 + (i // 26 - 1) % 26)::INT) ELSE '' END || chr((65 + i % 26)::INT)"


@query(f"SELECT i, {_NAME} AS name FROM (SELECT DISTINCT p_partkey % 16384 AS i FROM part)")
def excel_column_names(spark, d):
    i = t(spark, d, "part").select((F.col("p_partkey") % 16384).alias("i")).distinct()
    return i.select("i", sheet.column_name(F.col("i")).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CASE o_orderkey % 4 WHEN 1 THEN ' 06:00:00' WHEN 2 THEN ' 12:00:00' ELSE ' 18:00:00' END END AS text FROM orders")
def excel_serial_dates(spark, d):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + F.col("o_orderkey") % 4 / 4
    return t(spark, d, "orders").select("o_orderkey", sheet.serial_date(serial).alias("text"))


@query("SELECT p_partkey, p_partkey AS \"row\", (p_size % 26)::BIGINT AS \"column\" FROM part")
def a1_parse(spark, d):
    ref = F.concat(F.lit("$"), F.char(F.lit(65) + F.col("p_size").cast("long") % 26), (F.col("p_partkey") + 1).cast("string"))
    df = t(spark, d, "part").select("p_partkey", ref.alias("ref"))
    return df.select("p_partkey", sheet.a1_row(F.col("ref")).alias("row"), sheet.a1_column(F.col("ref")).alias("column"))


@query("SELECT p_partkey, floor(p_size * 7 + 5)::BIGINT AS column_px, p_size * 96 / 72 AS row_px FROM part")
def excel_pixels(spark, d):
    return t(spark, d, "part").select("p_partkey", sheet.column_pixels(F.col("p_size")).alias("column_px"), sheet.row_pixels(F.col("p_size")).alias("row_px"))


@query("SELECT index, size, index * 24.0 + coalesce(sum(size - 24.0) OVER (ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS position FROM (SELECT s_suppkey AS index, CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE (10 + s_suppkey % 30)::DOUBLE END AS size FROM supplier)")
def axis_geometry(spark, d):
    axis = t(spark, d, "supplier").select(F.col("s_suppkey").alias("index"), (10 + F.col("s_suppkey") % 30).cast("double").alias("size"), (F.col("s_suppkey") % 7 == 0).alias("hidden"))
    return sheet.axis_geometry(axis, 24.0)


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS row_start, greatest(l_partkey, l_suppkey) + 1 AS row_end, least(l_linenumber, 3) AS column_start, greatest(l_linenumber, 3) + 1 AS column_end FROM lineitem")
def selection_rect(spark, d):
    df = t(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", *sheet.selection(df.l_partkey, df.l_linenumber, df.l_suppkey, F.lit(3)))


@query("SELECT o_orderkey, least(greatest(o_totalprice * 100, 0.0), 15999400.0) * (47999400.0 / 15999400.0) AS content FROM orders")
def scroll_map(spark, d):
    return t(spark, d, "orders").select("o_orderkey", sheet.scroll_to_content(F.col("o_totalprice") * 100, 48_000_000.0, 600.0).alias("content"))


@query("""SELECT c."row", c."column", CASE WHEN m.rs IS NULL THEN value END AS value FROM (SELECT s_suppkey AS "row", (s_suppkey % 5) AS "column", s_name AS value FROM supplier) c
LEFT JOIN (SELECT n_nationkey * 4 AS rs, n_nationkey * 4 + 3 AS re, 1 AS cs, 4 AS ce FROM nation) m ON c."row" >= rs AND c."row" < re AND c."column" >= cs AND c."column" < ce AND NOT (c."row" = rs AND c."column" = cs)""")
def merge_mask(spark, d):
    cells = t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), (F.col("s_suppkey") % 5).alias("column"), F.col("s_name").alias("value"))
    k = F.col("n_nationkey") * 4
    merges = t(spark, d, "nation").select(k.alias("row_start"), (k + 3).alias("row_end"), F.lit(1).alias("column_start"), F.lit(4).alias("column_end"))
    return sheet.merge_mask(cells, merges)


def _csv_roundtrip(name: str, columns: list[str]):
    """Written as delimited text by Arrow, read back by our parser."""

    def run(spark, d):
        import pyarrow.csv as pc

        folder = tempfile.mkdtemp(prefix="rangeview-csv-")
        rows = t(spark, d, name).select([F.col(c).cast("string") for c in columns]).toArrow()
        pc.write_csv(rows, f"{folder}/{name}.csv")
        return delimited.read(spark, f"{folder}/{name}.csv").select(*columns)

    run.__name__ = f"csv_roundtrip_{name}"
    return query("SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in columns) + f" FROM {name}")(run)


_csv_roundtrip("nation", ["n_nationkey", "n_name", "n_regionkey"])
_csv_roundtrip("region", ["r_regionkey", "r_name"])
_csv_roundtrip("benchmark", ["item_id", "text"])


def _arrow_roundtrip(name: str, container: str):
    def run(spark, d):
        from rangeview.sources import arrow_ipc

        folder = tempfile.mkdtemp(prefix="rangeview-ipc-")
        rows = t(spark, d, name).toArrow()
        with pa.OSFile(f"{folder}/{name}.arrow", "wb") as f, (pa.ipc.new_file if container == "file" else pa.ipc.new_stream)(f, rows.schema) as w:
            w.write_table(rows, max_chunksize=64)
        return arrow_ipc.read(spark, f"{folder}/{name}.arrow")

    run.__name__ = f"arrow_{container}_roundtrip_{name}"
    return query(f"SELECT * FROM {name}")(run)


_arrow_roundtrip("nation", "file")
_arrow_roundtrip("supplier", "stream")
_arrow_roundtrip("customer", "file")


@query("SELECT count(*) AS row_count FROM events")
def stream_append_extent(spark, d):
    from rangeview.streaming.append import Growing

    folder = tempfile.mkdtemp(prefix="rangeview-stream-")
    t(spark, d, "events").repartition(4).write.parquet(f"{folder}/source")
    table = Growing(spark, f"{folder}/source", f"{folder}/target", f"{folder}/checkpoint")
    table.advance(files=1)
    table.finish()
    return table.df().agg(F.count(F.lit(1)).alias("row_count"))
