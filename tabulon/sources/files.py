"""Sources and sinks (S1–S12, T1–T3): delimited text, XML and JSON
records, raw bytes with content-based type and encoding detection,
positional log files, quarantine, resumability, zip archives and the
long-form matrix / dense-row tables."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Content signatures (hex of the first bytes) and MIME types,
# and the MIME routes of the cleaning step.
SIGNATURES = [
    ("504B0304", "application/zip"),
    ("504B0506", "application/zip"),
    ("25504446", "application/pdf"),
    ("D0CF11E0A1B11AE1", "application/CDFV2-unknown"),
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("4D5A", "application/x-dosexec"),
    ("1F8B", "application/gzip"),
    ("50415231", "application/octet-stream"),
]
TEXT_SIGNATURES = [
    ("<?xml", "text/xml"),
    ("<!doctype html", "text/html"),
    ("<html", "text/html"),
]
# Members that tell Office packages from plain archives, and the first entries
# of a compound file's directory (UTF-16).
PACKAGE_MEMBERS = [
    ("xl/workbook.", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("word/document.", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("ppt/presentation.", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
]
COMPOUND_ENTRIES = [
    ("Workbook", "application/vnd.ms-excel"),
    ("Book", "application/vnd.ms-excel"),
    ("WordDocument", "application/msword"),
    ("PowerPoint Document", "application/vnd.ms-powerpoint"),
]
ROUTES = [
    ("text/plain", "plain"),
    ("application/octet-stream", "plain"),
    ("text/xml", "xml"),
    ("application/xml", "xml"),
    ("application/vnd.ms-excel", "excel"),
    ("application/CDFV2-unknown", "excel"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "excel"),
]
# End of fixed values.
# ---------------------------------------------------------------------------


# S1 / S2 ---------------------------------------------------------------------

def read_delimited(spark: SparkSession, path: str, schema, sep: str = ";") -> DataFrame:
    """``sep``-separated UTF-8 text with a header, explicit schema (no
    inference pass over the data)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", True)
            .option("encoding", "UTF-8").csv(path))


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """Write ``sep``-separated text with a header."""
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


# S3 / S4 ---------------------------------------------------------------------

def read_xml_records(xml: Column, schema: str) -> Column:
    """S3: one XML record per row parsed into a struct (``from_xml``)."""
    return F.from_xml(xml, schema)


def flatten_catalog_json(json_text: Column, schema: str) -> Column:
    """Nested API JSON -> fixed struct; a missing sub-object gives NULL
    leaves when its fields are selected."""
    return F.from_json(json_text, schema)


# S5, T1–T3 -------------------------------------------------------------------

def scan_raw_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of every file under ``path``; a
    zero-length file gets no type."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


#: Files of more bytes have their type found by lines, spread over tasks.
WHOLE_BYTES = 128 * 1024 * 1024
#: Names of files that Spark's text reader would unpack.
PACKED_NAME = r"\.(gz|bz2|zst|deflate|snappy|lz4)$"


def scan_raw_types(spark: SparkSession, path: str, glob: str | None = None,
                   whole: int = WHOLE_BYTES) -> DataFrame:
    """S5 with T1: (path, length, mime) of every file under ``path``.  Files
    of up to ``whole`` bytes are read whole; of larger ones each task reads a
    range of lines: a type shows at the start of the first line, and text is
    valid when every line is.  Large zip containers, compound files and files
    named as packed ones are still read whole, each by one task."""
    small = scan_raw_files(spark, path, glob).filter(F.col("length") <= whole)
    types = small.select("path", "length", detect_mime(F.col("content")).alias("mime"))

    def reader():
        r = spark.read.option("recursiveFileLookup", "true")
        return r.option("pathGlobFilter", glob) if glob else r

    files = (reader().format("binaryFile").load(path).filter(F.col("length") > whole)
             .select("path", "length", F.col("_metadata.file_path").alias("_file")))
    if files.isEmpty():
        return types
    lines = (reader().option("lineSep", "\n").text(path).filter(F.col("_metadata.file_size") > whole)
             .select(F.col("_metadata.file_path").alias("_file"), F.col("value").cast("binary").alias("line"),
                     F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at")))
    read = lines.groupBy("_file").agg(
        F.min_by("line", "_at").alias("_first"), F.sum(F.octet_length("line") + 1).alias("_bytes"),
        F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("_valid"))
    x = files.filter(~F.col("path").rlike(PACKED_NAME)).join(read, "_file")
    # the reader takes a byte-order mark off the first line
    mark = F.when(F.col("length") - F.col("_bytes") >= 2, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b""))
    x = x.withColumn("_head", F.concat(mark, "_first", F.lit(b"\n")))
    start = F.hex(F.substring("_head", 1, 8))
    x = x.withColumn("mime", F.when(~(start.startswith("504B0304") | start.startswith("D0CF11E0A1B11AE1")),
                                    detect_mime(F.col("_head"))))
    by_line = x.filter(F.col("mime").isNotNull()).select("path", "length", F.when(
        (F.col("mime") == "text/plain") & ~F.col("_valid"), F.lit("application/octet-stream"))
        .otherwise(F.col("mime")).alias("mime"))
    from ..session import cut_lineage

    by_line = cut_lineage(by_line)
    # one path for so many bytes each: few
    rest = [r["path"] for r in files.join(by_line, "path", "left_anti").select("path").collect()]
    types = types.unionByName(by_line)
    if rest:
        packed = spark.read.format("binaryFile").load(rest)
        types = types.unionByName(packed.select("path", "length", detect_mime(F.col("content")).alias("mime")))
    return types


def _package_type(content: Column) -> Column:
    """Type of a zip container: an Office package lists ``[Content_Types].xml``
    and its main part in the directory at its end (behind 46 bytes that begin
    ``PK`` 1 2); an OpenDocument one opens with a stored member ``mimetype``;
    any other is a plain archive."""
    raw = content.cast("string")  # searched as bytes
    before = F.octet_length(F.substring_index(raw, "PK\x01\x02", 1))
    directory = F.substr(content, before + 1, F.octet_length(content)).cast("string")
    expr = F.when(F.substring(content, 31, 8) == F.lit("mimetype").cast("binary"), F.substring_index(
        F.substring(content, 39, 100).cast("string"), "PK", 1))
    for member, mime in PACKAGE_MEMBERS:
        expr = expr.when(directory.contains("[Content_Types].xml") & directory.contains(member), F.lit(mime))
    return expr.otherwise(F.lit("application/zip"))


def _compound_type(content: Column) -> Column:
    """Type of a compound file by the names in its directory: an entry is 128
    bytes that begin with the name, padded with zeros."""
    raw = content.cast("string")
    expr = None
    for name, mime in COMPOUND_ENTRIES:
        found = raw.contains("R\0o\0o\0t\0 \0E\0n\0t\0r\0y\0") & raw.contains("\0\0" + "\0".join(name) + "\0\0\0")
        expr = F.when(found, F.lit(mime)) if expr is None else expr.when(found, F.lit(mime))
    return expr.otherwise(F.lit("application/CDFV2-unknown"))


def detect_mime(content: Column) -> Column:
    """MIME type from the leading bytes (markup: behind a byte-order mark
    and blanks of any number); zip containers and compound files by what they
    list, wherever it stands; NULL for empty content; valid UTF-8 text without
    a markup signature is ``text/plain``."""
    head = F.hex(F.substring(content, 1, 16))
    unmarked = F.when(head.startswith("EFBBBF"), F.substr(content, F.lit(4), F.octet_length(content))).otherwise(content)
    text_head = F.lower(F.substring(F.ltrim(unmarked.cast("string")), 1, 64))
    expr = F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for sig, mime in SIGNATURES:
        kind = {"504B0304": _package_type, "D0CF11E0A1B11AE1": _compound_type}.get(sig)
        expr = expr.when(head.startswith(sig), kind(content) if kind else F.lit(mime))
    for sig, mime in TEXT_SIGNATURES:
        expr = expr.when(text_head.startswith(sig), F.lit(mime))
    return expr.when(F.is_valid_utf8(content.cast("string")), F.lit("text/plain")) \
        .otherwise(F.lit("application/octet-stream"))


def route_by_type(mime: Column) -> Column:
    """Dispatch route: plain (text and octet-stream), xml, excel; other
    types are ignored."""
    expr = None
    for m, r in ROUTES:
        expr = F.when(mime == m, F.lit(r)) if expr is None else expr.when(mime == m, F.lit(r))
    return expr.otherwise(F.lit("ignored"))


def detect_encoding(content: Column) -> Column:
    """Encoding of the whole value: byte-order marks, then ASCII, then
    valid UTF-8, else a single-byte fallback (ISO-8859-1).  Unknown -> utf-8
    is the caller's default."""
    head = F.hex(F.substring(content, 1, 3))
    as_text = content.cast("string")
    valid = F.is_valid_utf8(as_text)
    ascii_only = valid & (F.octet_length(content) == F.char_length(as_text))
    return (F.when(head.startswith("EFBBBF"), F.lit("UTF-8-SIG"))
            .when(head.startswith("FFFE"), F.lit("UTF-16LE"))
            .when(head.startswith("FEFF"), F.lit("UTF-16BE"))
            .when(ascii_only, F.lit("ascii"))
            .when(valid, F.lit("utf-8"))
            .otherwise(F.lit("ISO-8859-1")))


def decode_content(content: Column, encoding: Column) -> Column:
    """Decode bytes with the detected encoding (utf-8 when unknown)."""
    enc = F.coalesce(encoding, F.lit("utf-8"))
    return (F.when(enc.isin("ascii", "utf-8", "UTF-8-SIG"), F.decode(content, "UTF-8"))
            .when(enc == "UTF-16LE", F.decode(content, "UTF-16LE"))
            .when(enc == "UTF-16BE", F.decode(content, "UTF-16BE"))
            .otherwise(F.decode(content, "ISO-8859-1")))


# S6 / S7 / S8 ----------------------------------------------------------------

def parse_line_logs(text: Column, fields: list[str]) -> list[Column]:
    """Positional log (one value per line after a ``#`` banner line):
    the named fields are lines 1..n (stripped), ``error_type`` is the first
    word of the next line and ``content`` the second-to-last line."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, "\n", -1)
    lines = F.when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = [F.trim(F.element_at(lines, i + 2)).alias(name) for i, name in enumerate(fields)]
    err = F.trim(F.element_at(lines, len(fields) + 2))
    out.append(F.substring_index(err, " ", 1).alias("error_type"))
    out.append(F.trim(F.element_at(lines, -2)).alias("content"))
    return out


def error_quarantine(df: DataFrame, ok: Column, error_type: Column, message: Column):
    """Split a batch by a status instead of failing it: returns (good
    rows, quarantine rows with error_type and message)."""
    flagged = df.withColumn("_ok", ok)
    good = flagged.filter(F.col("_ok")).drop("_ok")
    bad = flagged.filter(~F.col("_ok")).withColumn("error_type", error_type) \
        .withColumn("message", message).drop("_ok")
    return good, bad


def append_quarantine(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").parquet(path)


def skip_processed(todo: DataFrame, outputs: DataFrame, key: str,
                   size_col: str | None = "size") -> DataFrame:
    """Keep the work items whose output does not exist yet; an output of
    size 0 counts as absent."""
    done = outputs if size_col is None else outputs.filter(F.col(size_col) > 0)
    return todo.join(done.select(key).distinct(), key, "left_anti")


# S9 --------------------------------------------------------------------------

ARCHIVE_SCHEMA = "archive string, member string, content binary, message string"
#: What a damaged, encrypted or unsupported archive or member raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError)


def _expand(it):
    def row(*values):
        return pd.DataFrame([values], columns=["archive", "member", "content", "message"])

    for pdf in it:
        for name, blob in zip(pdf["archive"], pdf["content"]):
            try:
                zf = zipfile.ZipFile(io.BytesIO(bytes(blob or b"")))
                members = zf.infolist()
            except UNREADABLE as e:
                yield row(name, None, None, str(e) or type(e).__name__)
                continue
            for info in members:
                if info.is_dir() or info.file_size == 0:
                    continue
                member = info.filename.replace("/", "--")
                try:
                    yield row(name, member, zf.read(info), None)
                except UNREADABLE as e:
                    yield row(name, member, None, str(e) or type(e).__name__)


def expand_archives_checked(archives: DataFrame):
    """S9 with S7: (members, errors): one row per non-empty regular member
    of every zip archive, one at a time, and one error row (archive, member,
    error_type, message) per archive or member that cannot be read."""
    from ..session import ship_package

    ship_package(archives.sparkSession)
    found = archives.select("archive", "content").mapInPandas(_expand, ARCHIVE_SCHEMA)
    good, bad = error_quarantine(found.withColumnRenamed("message", "_why"), F.col("_why").isNull(),
                                 F.lit("bad_archive"), F.col("_why"))
    return good.drop("_why"), bad.drop("_why", "content")


def expand_archives(archives: DataFrame) -> DataFrame:
    """One row per non-empty regular member of every readable zip archive
    (archive, member name with ``/`` -> ``--``, bytes); per-archive Python
    inside ``mapInPandas``, archives spread over the cluster."""
    return expand_archives_checked(archives)[0]


def _zip_rows(batches):
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])
    for batch in batches:
        for at in range(len(batch)):  # one archive's texts at a time as Python objects
            key, members = (batch.column(c)[at].as_py() for c in ("archive", "members"))
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                for m in members:
                    if m["name"].endswith("/"):
                        zf.writestr(m["name"], b"")
                    else:
                        zf.writestr(m["name"], (m["text"] or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([buf.getvalue()], pa.binary())],
                                             schema=schema)


def build_archives(rows: DataFrame) -> DataFrame:
    """Zip bytes built inside the job from (archive, members array<struct<name,
    text>>): the fixture of S9 and T1.  A task holds one Arrow batch of texts
    and one archive."""
    from ..session import ship_package

    ship_package(rows.sparkSession)
    return rows.select("archive", "members").mapInArrow(_zip_rows, "archive string, content binary")


# S10 / S12 -------------------------------------------------------------------

def save_matrix_long(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a sparse matrix as long (row, col, value) Parquet."""
    df.write.mode(mode).parquet(path)


def load_matrix_long(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vector_to_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """S10 at an ML boundary: a vector column -> long (id, col, value),
    zeros dropped."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col(vec_col))
    return df.select(id_col, F.posexplode(arr).alias("col", "value")).filter(F.col("value") != 0)


def save_dense_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Dense rows as an array<double> column in Parquet."""
    df.write.mode(mode).parquet(path)


def load_dense_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
