"""Registered queries for sources and sinks (S1–S10, S12), content
detection (T1–T4) and JSON / XML / spreadsheet tablizing (T18–T26), with
DuckDB oracles.  Every fixture is derived from the driver tables inside
the job: delimited and Parquet files written to the shared scratch folder,
XML and JSON texts, zip bytes and cell grids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import norm_l2
from ..operators import sheets as SH
from ..operators import structured as ST
from ..operators import textfeat as tf
from ..session import cut_lineage, scratch_dir
from ..sources import files as S
from .fixtures import PART_ROWS_PER_FILE, table
from .q_text import ORACLE as TEXT_ORACLE

R = 6
# total order of the lines of an order (line numbers repeat in the data)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
SUPPLIERS_PER_FILE = 8
ORDERS_PER_SHEET = 50


# S1 / S2 ---------------------------------------------------------------------

def q_read_delimited(spark, sf):
    path = scratch_dir(spark, "supplier-csv")
    S.write_delimited(table(spark, sf, "supplier"), path)
    return S.read_delimited(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


def q_write_delimited(spark, sf):
    path = scratch_dir(spark, "nation-csv")
    S.write_delimited(table(spark, sf, "nation"), path, sep=";")
    raw = spark.read.text(path)
    header = raw.filter(F.col("value") == "n_nationkey;n_name;n_regionkey").count()
    back = S.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return back.withColumn("header_lines", F.lit(header).cast("long") > 0)


# S3 / S4 ---------------------------------------------------------------------

def _order_records(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")

    def line(s):  # written once the lines are grouped: the text does not travel
        return F.concat(F.lit("<line><l_linenumber>"), s["l_linenumber"].cast("string"),
                        F.lit("</l_linenumber><l_partkey>"), s["l_partkey"].cast("string"),
                        F.lit("</l_partkey><l_quantity>"), s["l_quantity"].cast("string"),
                        F.lit("</l_quantity></line>"))

    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct(*LINE_ORDER))), line), "").alias("lines"))
    xml = F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'),
                   F.col("o_orderstatus"), F.lit("</status><lines>"), F.col("lines"),
                   F.lit("</lines></order>"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select("o_orderkey", xml.alias("xml"))


def q_read_xml_records(spark, sf):
    x = _order_records(spark, sf)
    rec = x.select(S.read_xml_records(F.col("xml"), "_key long, status string, lines struct<line: "
                                      "array<struct<l_linenumber: int, l_partkey: long>>>").alias("r"))
    ex = rec.select(F.col("r._key").alias("o_orderkey"), F.col("r.status").alias("o_orderstatus"),
                    F.explode("r.lines.line").alias("l"))
    return ex.select("o_orderkey", "o_orderstatus", F.col("l.l_linenumber").alias("l_linenumber"),
                     F.col("l.l_partkey").alias("l_partkey"))


def q_flatten_catalog_json(spark, sf):
    e = table(spark, sf, "events")
    r = S.flatten_catalog_json(F.col("props"), "k long, meta struct<source: string>")
    return e.select("event_id", r.alias("r")).select("event_id", F.col("r.k").alias("k"),
                                                     F.col("r.meta.source").alias("meta_source"))


# S5, S9, T1–T3 ---------------------------------------------------------------

def q_scan_raw_files(spark, sf):
    raw = S.scan_raw_types(spark, sf, "*.parquet")
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "mime")


def _archives(spark, sf):
    d = table(spark, sf, "documents")
    members = F.array(
        F.struct(F.lit("text/body.txt").alias("name"), F.col("text").alias("text")),
        F.struct(F.lit("meta/").alias("name"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("meta/lang.txt").alias("name"), F.col("lang").alias("text")),
        F.struct(F.lit("empty.txt").alias("name"), F.lit("").alias("text")))
    return S.build_archives(d.select(F.col("doc_id").cast("string").alias("archive"),
                                     members.alias("members")))


def q_expand_archives(spark, sf):
    m = S.expand_archives(_archives(spark, sf))
    return m.select(F.col("archive").cast("long").alias("doc_id"), "member",
                    F.length("content").cast("long").alias("n_bytes"))


def _blobs(spark, sf):
    p = table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"),
                                         F.encode("html", "UTF-8").alias("content"))
    d = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                                             F.encode("text", "UTF-8").alias("content"))
    e = table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("id"),
                                          F.encode("props", "UTF-8").alias("content"))
    z = _archives(spark, sf).select(F.lit("zip").alias("src"), F.col("archive").cast("long").alias("id"),
                                    "content")
    return p.unionByName(d).unionByName(e).unionByName(z)


def q_detect_mime(spark, sf):
    return _blobs(spark, sf).select("src", "id", S.detect_mime(F.col("content")).alias("mime"))


def q_route_by_type(spark, sf):
    return _blobs(spark, sf).select("src", "id", S.route_by_type(S.detect_mime(F.col("content"))).alias("route"))


def q_detect_encoding(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.detect_encoding(F.encode("text", "UTF-8")).alias("enc_utf8"),
                    S.detect_encoding(F.encode("text", "ISO-8859-1")).alias("enc_latin1"))


def q_classify_json(spark, sf):
    e = table(spark, sf, "events")
    d = table(spark, sf, "documents")
    u = (e.select(F.lit("events").alias("src"), F.col("event_id").alias("id"), F.col("props").alias("text"))
         .unionByName(d.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text"))
         .unionByName(e.filter(F.col("event_type") == "purchase").select(
             F.lit("geo").alias("src"), F.col("event_id").alias("id"),
             F.concat(F.lit('{"type": "Feature", "properties": '), F.col("props"), F.lit("}")).alias("text"))))
    return u.select("src", "id", ST.classify_json(F.col("text")).alias("kind"))


# S6 / S7 / S8 ----------------------------------------------------------------

LOG_FIELDS = ["source_file", "file_name", "matrix_name", "zipfile", "extension"]


def q_parse_line_logs(spark, sf):
    e = table(spark, sf, "events")
    text =F.concat_ws("\n", F.lit("#" * 20), F.col("user_id").cast("string"),
                       F.concat(F.col("event_id").cast("string"), F.lit(".csv")),
                       F.concat(F.col("event_id").cast("string"), F.lit("--m")), F.lit("False"),
                       F.lit("text/plain"), F.concat(F.lit("ValueError: value "), F.col("value").cast("string")),
                       F.lit("  detail line"), F.col("props"), F.lit(""), F.lit(""))
    return e.select(text.alias("t")).select(*S.parse_line_logs(F.col("t"), LOG_FIELDS))


def q_error_quarantine(spark, sf):
    e = table(spark, sf, "events")
    # error events get a truncated (unterminated) JSON text
    t = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")) \
        .otherwise(F.col("props"))
    src = e.select("event_id", t.alias("text"))
    good, bad = S.error_quarantine(src, F.try_parse_json("text").isNotNull(),
                                   F.lit("malformed_json"), F.col("text"))
    g = good.select("event_id", F.lit("ok").alias("status"),
                    F.get_json_object("text", "$.k").cast("long").alias("k"),
                    F.lit(None).cast("string").alias("error_type"))
    b = bad.select("event_id", F.lit("quarantine").alias("status"), F.lit(None).cast("long").alias("k"),
                   "error_type")
    return g.unionByName(b)


def q_skip_processed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    out = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_linestatus") == "F").alias("size"))
    return S.skip_processed(o, out, "o_orderkey")


# S10 / S11 / S12 -------------------------------------------------------------

def q_save_matrix_long(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = tf.n_documents(docs)
    m = tf.tfidf(tf.df_filter(tf.counted_terms(docs), n), n, "count", df_col="df")
    path = scratch_dir(spark, "tfidf")
    S.save_matrix_long(m, path)
    back = S.load_matrix_long(spark, path)
    return back.select("doc_id", "term", F.round("weight", R).alias("weight"))


def q_ordered_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = tf.n_documents(docs)
    return tf.vocabulary(tf.df_filter(tf.counted_terms(docs), n))


def q_save_dense_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    path = scratch_dir(spark, "dense")
    S.save_dense_rows(e, path)
    back = S.load_dense_rows(spark, path)
    return back.select("vec_id", F.round(norm_l2(F.col("w")), R).alias("w_l2"))


# T18–T22 ---------------------------------------------------------------------

def json_files(spark, sf):
    """Files of suppliers of one nation (8 per file) nested at depth 0..3
    (by nation key), with a nested ``account`` object per supplier."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    sup = F.struct(F.col("s_suppkey"), F.col("s_name"),
                   F.struct(F.col("s_acctbal").alias("balance")).alias("account"))
    g = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(
        "n_nationkey", "n_name", F.floor(F.col("s_suppkey") / SUPPLIERS_PER_FILE).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", sup.alias("o")))).alias("l"))
    lst = F.transform("l", lambda x: x["o"])
    depth = F.col("n_nationkey") % 4
    doc = (F.when(depth == 0, F.to_json(lst))
           .when(depth == 1, F.to_json(F.struct(F.col("n_name").alias("nation"), F.lit(1).alias("region"),
                                                lst.alias("suppliers"))))
           .when(depth == 2, F.to_json(F.struct(F.col("n_name").alias("nation"), F.struct(
               F.size("l").alias("count"), lst.alias("suppliers")).alias("data"))))
           .otherwise(F.to_json(F.struct(F.struct(F.col("n_name").alias("nation")).alias("meta"), F.struct(
               F.struct(lst.alias("suppliers")).alias("inner")).alias("body")))))
    fid = F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit("-"), F.col("b").cast("string"))
    return g.select(fid.alias("file_id"), doc.alias("text"))


def q_find_record_list(spark, sf):
    j = json_files(spark, sf).select("file_id", F.array().cast("array<int>").alias("path"), "text")
    r = ST.find_record_list(j)
    return r.select("file_id", "key", F.size("records").cast("long").alias("n_records"))


def q_find_record_list_deep(spark, sf):
    r = ST.find_record_list_deep(json_files(spark, sf))
    return r.select("file_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"),
                    "key", F.size("records").cast("long").alias("n_records"))


def q_normalize_records(spark, sf):
    cells = ST.normalize_records(ST.find_record_list_deep(json_files(spark, sf)))
    return cells.select("file_id", F.col("row").cast("long").alias("row"), "col_name", "value")


def q_tablize_json(spark, sf):
    return ST.tablize_json(json_files(spark, sf)).select(
        "file_id", F.col("row").cast("long").alias("row"), "col_name", "value")


def q_tablize_xml(spark, sf):
    x = _order_records(spark, sf).select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
                                         .alias("file_id"), "xml")
    return ST.tablize_xml(x).select("file_id", F.col("row").cast("long").alias("row"), "col_name", "value")


def _damaged(files, id_col, text_col, share):
    """Files with a third of them, by their ids' hashes, cut before their last character."""
    bad = F.crc32(F.col(id_col).cast("binary")) % share == 0
    return files.withColumn(text_col, F.when(bad, F.substr(F.col(text_col), F.lit(1), F.length(text_col) - 1))
                            .otherwise(F.col(text_col)))


def _parts(tables):
    """Cells, extradata and errors as rows (file_id, part, place, name, value)."""
    def text(c):
        return F.col(c).cast("string")

    cells = tables["cells"].select("file_id", F.lit("cell").alias("part"), text("row").alias("place"),
                                   F.col("col_name").alias("name"), "value")
    extra = tables["extradata"].select("file_id", F.lit("extradata").alias("part"), F.array_join(
        F.col("path").cast("array<string>"), ".").alias("place"), "name", "value")
    errors = tables["errors"].select("file_id", F.lit("error").alias("part"), F.lit("").alias("place"),
                                     F.lit("").alias("name"), F.col("error_type").alias("value"))
    return cells.unionByName(extra).unionByName(errors)


def _event_files(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("file_id"), F.col("props").alias("text"))


def _order_files(spark, sf):
    return _order_records(spark, sf).select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("file_id"), "xml")


def q_json_leaves(spark, sf):
    """Records, extradata and error rows give back every leaf of
    every file; one in three of them is damaged."""
    files = json_files(spark, sf).unionByName(_event_files(spark, sf))
    return _parts(ST.json_tables(_damaged(files, "file_id", "text", 3)))


def q_xml_leaves(spark, sf):
    """T22 likewise."""
    return _parts(ST.xml_tables(_damaged(_order_files(spark, sf), "file_id", "xml", 3)))


def q_clean_files(spark, sf):
    """One pass over delimited, JSON and XML files, some damaged, and
    over workbooks, images and empty files: the outcome of every file."""
    from ..operators.cleaning import clean_files
    from .fixtures import delimited_files

    def content(df, name):
        return df.select("file_id", F.encode(F.col(name), "UTF-8").alias("content"))

    part = delimited_files(spark, sf).filter(F.col("file_id").startswith("part-"))
    other = table(spark, sf, "nation").select(
        F.concat(F.lit("other-"), F.col("n_nationkey").cast("string")).alias("file_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.to_binary(F.lit("D0CF11E0A1B11AE1"), F.lit("hex")))
        .when(F.col("n_nationkey") % 3 == 1, F.to_binary(F.lit("89504E470D0A1A0A"), F.lit("hex")))
        .otherwise(F.to_binary(F.lit(""), F.lit("hex"))).alias("content"))
    files = content(part, "text").unionByName(other)
    files = files.unionByName(content(_damaged(json_files(spark, sf), "file_id", "text", 3), "text"))
    orders = _damaged(_order_files(spark, sf), "file_id", "xml", 3)
    orders = orders.withColumn("xml", F.concat(F.lit('<?xml version="1.0"?>\n'), "xml"))
    files = files.unionByName(content(orders, "xml"))
    r = clean_files(files)
    n_cells = r["cells"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return (r["routes"].join(n_cells, "file_id", "left").join(r["extradata"], "file_id", "left")
            .join(r["errors"], "file_id", "left")
            .select("file_id", "route", F.coalesce("error_type", F.lit("table")).alias("outcome"),
                    F.coalesce("n_cells", F.lit(0)).alias("n_cells"),
                    F.coalesce("extradata", F.lit("")).alias("extradata")))


# T23–T26 ---------------------------------------------------------------------

SHEET_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]


def sheet_fixture(spark, sf):
    """Cell grid per sheet of 50 orders: a title row merged across the
    width, a header row, one row per line; the order key is written once
    per order and merged down over the order's lines.  Cells carry line
    breaks and ``;`` that the cleaning removes."""
    li = table(spark, sf, "lineitem")
    sheet = F.concat(F.lit("lines-"), F.floor(F.col("l_orderkey") / ORDERS_PER_SHEET).cast("string"),
                     F.lit("__s0"))
    w = Window.partitionBy("sheet").orderBy("l_orderkey", *LINE_ORDER)
    rows = li.select(sheet.alias("sheet"), *SHEET_COLS, "l_suppkey", "l_extendedprice") \
        .withColumn("row", F.row_number().over(w) + 1)
    order = Window.partitionBy("sheet", "l_orderkey")
    rows = rows.withColumn("first", F.min("row").over(order)).withColumn("last", F.max("row").over(order))
    rows = cut_lineage(rows.drop("l_suppkey", "l_extendedprice"))  # cells and ranges read it

    def cell(row, col, value):
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"))

    title = [cell(F.lit(0), 0, F.concat(F.lit("Lines\nof "), F.col("sheet")))]
    head = [cell(F.lit(1), i, F.lit(c)) for i, c in enumerate(SHEET_COLS)]
    key, *data = [cell(F.col("row"), i, F.col(c)) for i, c in enumerate(SHEET_COLS)]
    # a sheet's first line brings the title and the header, an order's first one its key
    cells = rows.select("sheet", F.explode(F.when(F.col("row") == 2, F.array(*title, *head, key, *data))
                                           .when(F.col("row") == F.col("first"), F.array(key, *data))
                                           .otherwise(F.array(*data))).alias("c")).select("sheet", "c.row", "c.col", "c.value")

    def area(rlo, rhi, chi):
        return F.struct(rlo.cast("int").alias("rlo"), rhi.cast("int").alias("rhi"), F.lit(0).alias("clo"), F.lit(chi).alias("chi"))

    own = area(F.col("first"), F.col("last") + 1, 1)
    whole = area(F.lit(0), F.lit(1), len(SHEET_COLS))
    ranges = rows.filter(F.col("row") == F.col("first")).select("sheet", F.explode(
        F.when(F.col("row") == 2, F.array(whole, own)).otherwise(F.array(own))).alias("r")).select("sheet", "r.*")
    return cells, ranges


def q_sheet_clean_cells(spark, sf):
    cells, _ = sheet_fixture(spark, sf)
    return SH.sheet_clean_cells(cells).select("sheet", F.col("row").cast("long").alias("row"), "col", "value")


def q_fill_merged_ranges(spark, sf):
    cells, ranges = sheet_fixture(spark, sf)
    f = SH.fill_merged_ranges(cells, ranges)
    return f.select("sheet", F.col("row").cast("long").alias("row"), "col", "value")


def q_filter_sheet_rows(spark, sf):
    cells, ranges = sheet_fixture(spark, sf)
    good, extradata, width = SH.filter_sheet_rows(SH.fill_merged_ranges(SH.sheet_clean_cells(cells), ranges))
    n = good.groupBy("sheet").agg(F.count_distinct("row").alias("n_good"))
    return extradata.join(n, "sheet").join(width, "sheet").select("sheet", "extradata", "n_good",
                                                                  F.col("width").cast("long").alias("width"))


def q_tablize_sheets(spark, sf):
    cells, ranges = sheet_fixture(spark, sf)
    t = SH.tablize_sheets(cells, ranges)["cells"]
    return t.select(F.col("file_id").alias("sheet"), "row", "col_name", "value")


QUERIES = {
    "read_delimited": q_read_delimited,
    "write_delimited": q_write_delimited,
    "read_xml_records": q_read_xml_records,
    "flatten_catalog_json": q_flatten_catalog_json,
    "scan_raw_files": q_scan_raw_files,
    "expand_archives": q_expand_archives,
    "detect_mime": q_detect_mime,
    "route_by_type": q_route_by_type,
    "detect_encoding": q_detect_encoding,
    "classify_json": q_classify_json,
    "parse_line_logs": q_parse_line_logs,
    "error_quarantine": q_error_quarantine,
    "skip_processed": q_skip_processed,
    "save_matrix_long": q_save_matrix_long,
    "ordered_features": q_ordered_features,
    "save_dense_rows": q_save_dense_rows,
    "find_record_list": q_find_record_list,
    "find_record_list_deep": q_find_record_list_deep,
    "normalize_records": q_normalize_records,
    "tablize_json": q_tablize_json,
    "tablize_xml": q_tablize_xml,
    "json_leaves": q_json_leaves,
    "xml_leaves": q_xml_leaves,
    "clean_files": q_clean_files,
    "sheet_clean_cells": q_sheet_clean_cells,
    "fill_merged_ranges": q_fill_merged_ranges,
    "filter_sheet_rows": q_filter_sheet_rows,
    "tablize_sheets": q_tablize_sheets,
}

# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

GEO = "(" + ", ".join(f"'{t}'" for t in ST.GEOJSON_TYPES) + ")"
SUPPLIER_CELLS = f"""
sup AS (SELECT 'nation-' || CAST(s_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(s_suppkey / {SUPPLIERS_PER_FILE}) AS BIGINT) AS VARCHAR) AS file_id,
          row_number() OVER (PARTITION BY s_nationkey, floor(s_suppkey / {SUPPLIERS_PER_FILE}) ORDER BY s_suppkey) - 1 AS row, *
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cells AS (SELECT file_id, row, 's_suppkey' AS col_name, CAST(s_suppkey AS VARCHAR) AS value FROM sup
          UNION ALL SELECT file_id, row, 's_name', s_name FROM sup
          UNION ALL SELECT file_id, row, 'account.balance', CAST(s_acctbal AS VARCHAR) FROM sup)"""
FILES_BY_DEPTH = f"""
fl AS (SELECT 'nation-' || CAST(s_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(s_suppkey / {SUPPLIERS_PER_FILE}) AS BIGINT) AS VARCHAR) AS file_id,
          s_nationkey % 4 AS depth, count(*) AS n
       FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""

SHEET_CELLS = f"""
sl AS (SELECT 'lines-' || CAST(CAST(floor(l_orderkey / {ORDERS_PER_SHEET}) AS BIGINT) AS VARCHAR) || '__s0' AS sheet,
          row_number() OVER (PARTITION BY floor(l_orderkey / {ORDERS_PER_SHEET}) ORDER BY l_orderkey, {", ".join(LINE_ORDER)}) - 1 AS row, *
       FROM lineitem)"""

_SHEET_HEAD = " UNION ALL ".join(f"SELECT sheet, CAST(1 AS BIGINT), {i}, '{c}' FROM t" for i, c in enumerate(SHEET_COLS))
_SHEET_DATA = " UNION ALL ".join(f"SELECT sheet, row + 2, {i}, CAST({c} AS VARCHAR) FROM sl"
                                 for i, c in enumerate(SHEET_COLS) if i)

def _crc32_sql(text):
    """CRC-32 of an ASCII text, bit by bit: DuckDB has no such function."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step})), 4294967295)"""


JSON_LEAVES = f"""{SUPPLIER_CELLS}, {FILES_BY_DEPTH},
names AS (SELECT DISTINCT 'nation-' || CAST(s_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(s_suppkey / {SUPPLIERS_PER_FILE}) AS BIGINT) AS VARCHAR) AS file_id, n_name
          FROM supplier JOIN nation ON s_nationkey = n_nationkey),
jx AS (SELECT file_id, depth, CASE depth WHEN 3 THEN '0.0' ELSE '0' END AS place,
              CASE depth WHEN 3 THEN 'meta.nation' ELSE 'nation' END AS name, n_name AS value FROM fl JOIN names USING (file_id) WHERE depth > 0
       UNION ALL SELECT file_id, depth, '1', 'region', '1' FROM fl WHERE depth = 1
       UNION ALL SELECT file_id, depth, '1.0', 'data.count', CAST(n AS VARCHAR) FROM fl WHERE depth = 2),
jbad AS (SELECT file_id FROM fl WHERE {_crc32_sql('file_id')} % 3 = 0)"""
XML_LEAVES = f"""
xf AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS file_id, o_orderkey, any_value(o_orderstatus) AS status, count(*) AS n
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
xs AS (SELECT *, CASE WHEN {_crc32_sql('file_id')} % 3 = 0 THEN 'malformed_xml' WHEN n < 2 THEN 'no_record_list' ELSE 'table' END AS outcome FROM xf)"""

ORACLE = {
    "read_delimited": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "write_delimited": "SELECT n_nationkey, n_name, n_regionkey, true AS header_lines FROM nation",
    "read_xml_records": """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "flatten_catalog_json": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        CAST(NULL AS VARCHAR) AS meta_source FROM events""",
    "expand_archives": """SELECT doc_id, 'text--body.txt' AS member, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) > 0
        UNION ALL SELECT doc_id, 'meta--lang.txt', CAST(strlen(lang) AS BIGINT) FROM documents WHERE strlen(lang) > 0""",
    "detect_mime": """SELECT 'pages' AS src, page_id AS id, CASE WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'text/html' ELSE 'text/plain' END AS mime FROM pages
        UNION ALL SELECT 'documents', doc_id, CASE WHEN strlen(text) = 0 THEN NULL ELSE 'text/plain' END FROM documents
        UNION ALL SELECT 'events', event_id, 'text/plain' FROM events
        UNION ALL SELECT 'zip', doc_id, 'application/zip' FROM documents""",
    "route_by_type": """SELECT 'pages' AS src, page_id AS id, CASE WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'ignored' ELSE 'plain' END AS route FROM pages
        UNION ALL SELECT 'documents', doc_id, CASE WHEN strlen(text) = 0 THEN 'ignored' ELSE 'plain' END FROM documents
        UNION ALL SELECT 'events', event_id, 'plain' FROM events
        UNION ALL SELECT 'zip', doc_id, 'ignored' FROM documents""",
    "detect_encoding": """SELECT doc_id,
        CASE WHEN regexp_matches(text, '[^\\x01-\\x7f]') THEN 'utf-8' ELSE 'ascii' END AS enc_utf8,
        CASE WHEN regexp_matches(text, '[^\\x01-\\x7f]') THEN 'ISO-8859-1' ELSE 'ascii' END AS enc_latin1
        FROM documents""",
    "classify_json": f"""SELECT 'events' AS src, event_id AS id,
          CASE WHEN NOT json_valid(props) THEN 'text' WHEN json_extract_string(props, '$.type') IN {GEO} THEN 'geojson' ELSE 'json' END AS kind FROM events
        UNION ALL SELECT 'documents', doc_id, CASE WHEN json_valid(text) THEN 'json' ELSE 'text' END FROM documents
        UNION ALL SELECT 'geo', event_id, 'geojson' FROM events WHERE event_type = 'purchase'""",
    "parse_line_logs": """SELECT CAST(user_id AS VARCHAR) AS source_file, CAST(event_id AS VARCHAR) || '.csv' AS file_name,
        CAST(event_id AS VARCHAR) || '--m' AS matrix_name, 'False' AS zipfile, 'text/plain' AS extension,
        'ValueError:' AS error_type, props AS content FROM events""",
    "error_quarantine": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'quarantine' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN event_type = 'error' THEN 'malformed_json' END AS error_type FROM events""",
    "skip_processed": """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (
        SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count_if(l_linestatus = 'F') > 0)""",
    "save_matrix_long": TEXT_ORACLE["tfidf"],
    "ordered_features": TEXT_ORACLE["save_vocabulary"],
    "save_dense_rows": f"""SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))), {R}) AS w_l2
        FROM embeddings""",
    "find_record_list": f"""WITH {FILES_BY_DEPTH}
        SELECT file_id, CASE WHEN depth = 0 THEN NULL ELSE 'suppliers' END AS key, n AS n_records FROM fl WHERE depth <= 1""",
    "find_record_list_deep": f"""WITH {FILES_BY_DEPTH}
        SELECT file_id, CASE depth WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '1' ELSE '1.0' END AS path,
          CASE WHEN depth = 0 THEN NULL ELSE 'suppliers' END AS key, n AS n_records FROM fl""",
    "normalize_records": f"WITH {SUPPLIER_CELLS} SELECT file_id, row, col_name, value FROM cells",
    "tablize_json": f"WITH {SUPPLIER_CELLS} SELECT file_id, row, col_name, value FROM cells",
    "json_leaves": f"""WITH {JSON_LEAVES},
        ev AS (SELECT 'event-' || CAST(event_id AS VARCHAR) AS file_id FROM events)
        SELECT file_id, 'cell' AS part, CAST(row AS VARCHAR) AS place, col_name AS name, value FROM cells WHERE file_id NOT IN (FROM jbad)
        UNION ALL SELECT file_id, 'extradata', place, name, value FROM jx WHERE file_id NOT IN (FROM jbad)
        UNION ALL SELECT file_id, 'error', '', '', 'no_json' FROM jbad
        UNION ALL SELECT file_id, 'error', '', '', CASE WHEN {_crc32_sql('file_id')} % 3 = 0 THEN 'no_json' ELSE 'no_record_list' END FROM ev""",
    "xml_leaves": f"""WITH {XML_LEAVES},
        l AS (SELECT file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row,
                     l_linenumber, l_partkey, l_quantity FROM lineitem JOIN xs ON l_orderkey = o_orderkey WHERE outcome = 'table')
        SELECT file_id, 'cell' AS part, CAST(row AS VARCHAR) AS place, 'l_linenumber' AS name, CAST(l_linenumber AS VARCHAR) AS value FROM l
        UNION ALL SELECT file_id, 'cell', CAST(row AS VARCHAR), 'l_partkey', CAST(l_partkey AS VARCHAR) FROM l
        UNION ALL SELECT file_id, 'cell', CAST(row AS VARCHAR), 'l_quantity', CAST(l_quantity AS VARCHAR) FROM l
        UNION ALL SELECT file_id, 'extradata', '0.0', 'order.@key', CAST(o_orderkey AS VARCHAR) FROM xs WHERE outcome = 'table'
        UNION ALL SELECT file_id, 'extradata', '0.1.0', 'order.status.$', status FROM xs WHERE outcome = 'table'
        UNION ALL SELECT file_id, 'error', '', '', outcome FROM xs WHERE outcome <> 'table'""",
    "clean_files": f"""WITH {JSON_LEAVES}, {XML_LEAVES}
        SELECT 'part-' || CAST(b AS VARCHAR) AS file_id, 'delimited' AS route, 'table' AS outcome, n * 6 AS n_cells,
               '# part batch ' || CAST(b AS VARCHAR) AS extradata
        FROM (SELECT CAST(floor(p_partkey / {PART_ROWS_PER_FILE}) AS BIGINT) AS b, count(*) AS n FROM part GROUP BY b)
        UNION ALL SELECT fl.file_id, 'json', CASE WHEN jbad.file_id IS NULL THEN 'table' ELSE 'no_json' END,
               CASE WHEN jbad.file_id IS NULL THEN 3 * n ELSE 0 END, CASE WHEN jbad.file_id IS NULL THEN coalesce(x, '') ELSE '' END
        FROM fl LEFT JOIN jbad USING (file_id)
        LEFT JOIN (SELECT file_id, string_agg(name || ': ' || value, chr(10) ORDER BY place) AS x FROM jx GROUP BY file_id) USING (file_id)
        UNION ALL SELECT file_id, 'xml', outcome, CASE WHEN outcome = 'table' THEN 3 * n ELSE 0 END,
               CASE WHEN outcome = 'table' THEN 'order.@key: ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'order.status.$: ' || status ELSE '' END FROM xs
        UNION ALL SELECT 'other-' || CAST(n_nationkey AS VARCHAR), CASE n_nationkey % 3 WHEN 0 THEN 'excel' WHEN 1 THEN 'ignored' ELSE 'empty' END,
               CASE n_nationkey % 3 WHEN 0 THEN 'workbook' WHEN 1 THEN 'ignored' ELSE 'empty' END, 0, '' FROM nation""",
    "tablize_xml": """WITH ml AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2),
        l AS (SELECT 'order-' || CAST(l_orderkey AS VARCHAR) AS file_id,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row, *
              FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM ml) AND l_orderkey IN (SELECT o_orderkey FROM orders))
        SELECT file_id, row, 'l_linenumber' AS col_name, CAST(l_linenumber AS VARCHAR) AS value FROM l
        UNION ALL SELECT file_id, row, 'l_partkey', CAST(l_partkey AS VARCHAR) FROM l
        UNION ALL SELECT file_id, row, 'l_quantity', CAST(l_quantity AS VARCHAR) FROM l""",
    "sheet_clean_cells": f"""WITH {SHEET_CELLS}, t AS (SELECT DISTINCT sheet FROM sl)
        SELECT sheet, CAST(0 AS BIGINT) AS row, 0 AS col, 'Lines of ' || sheet AS value FROM t
        UNION ALL {_SHEET_HEAD}
        UNION ALL SELECT sheet, row + 2, 0, CAST(l_orderkey AS VARCHAR) FROM sl
          QUALIFY row = min(row) OVER (PARTITION BY sheet, l_orderkey)
        UNION ALL {_SHEET_DATA}""",
    "fill_merged_ranges": f"""WITH {SHEET_CELLS}, t AS (SELECT DISTINCT sheet FROM sl)
        SELECT sheet, CAST(0 AS BIGINT) AS row, unnest(range({len(SHEET_COLS)}))::INT AS col,
          'Lines' || chr(10) || 'of ' || sheet AS value FROM t
        UNION ALL {_SHEET_HEAD}
        UNION ALL SELECT sheet, row + 2, 0, CAST(l_orderkey AS VARCHAR) FROM sl
        UNION ALL {_SHEET_DATA}""",
    "filter_sheet_rows": f"""WITH {SHEET_CELLS}
        SELECT sheet, string_agg('Lines of ' || sheet, ';') AS extradata, count(*) + 1 AS n_good, CAST(5 AS BIGINT) AS width
        FROM sl GROUP BY sheet""".replace("string_agg('Lines of ' || sheet, ';')",
                                           "repeat('Lines of ' || any_value(sheet) || ';', 4) || 'Lines of ' || any_value(sheet)"),
    "tablize_sheets": f"""WITH {SHEET_CELLS}
        SELECT sheet, row, 'l_orderkey' AS col_name, CAST(l_orderkey AS VARCHAR) AS value FROM sl
        UNION ALL SELECT sheet, row, 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM sl
        UNION ALL SELECT sheet, row, 'l_partkey', CAST(l_partkey AS VARCHAR) FROM sl
        UNION ALL SELECT sheet, row, 'l_quantity', CAST(l_quantity AS VARCHAR) FROM sl
        UNION ALL SELECT sheet, row, 'l_returnflag', l_returnflag FROM sl""",
}
