"""The type of a large file is found by lines, with the result of the whole."""

import gzip
import io
import zipfile

from pyspark.sql import functions as F

from tabulon.sources import files as S


def _files():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as zf:
        zf.writestr("[Content_Types].xml", "x" * 500)
        zf.writestr("xl/workbook.xml", "y")
    text = ("ligne é;1\n" * 40).encode()
    return {"text.csv": text, "last line open.csv": text[:-1], "mark.csv": b"\xef\xbb\xbf" + text, "latin.csv": text + b"\xe9\n",
            "latin mark.csv": b"\xef\xbb\xbfMZ" + text + b"\xe9", "xml.xml": b"  <?XML version='1.0'?>\n" + text,
            "blank.txt": b"\n<?xml " + text, "mark xml.xml": b"\xef\xbb\xbf <html>" + text, "pdf.pdf": b"%PDF-1.4\n\xff\n" * 40,
            "columns.parquet": b"PAR1" + bytes(range(256)) * 2, "book.xlsx": z.getvalue(),
            "zip.zip": b"PK\x03\x04\n" + bytes(range(256)) * 2, "packed.csv.gz": gzip.compress(bytes(range(256)) * 9),
            "old.xls": bytes.fromhex("D0CF11E0A1B11AE1") + bytes(400), "cut é.txt": "é".encode()[:1] + b"\n" + text,
            "small.csv": b"a;b"}


def test_types_by_line_are_those_of_the_whole(spark, tmp_path):
    for name, content in _files().items():
        (tmp_path / name).write_bytes(content)
    whole = S.scan_raw_files(spark, str(tmp_path)).select("path", "length", S.detect_mime(F.col("content")).alias("mime"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = S.scan_raw_types(spark, str(tmp_path), whole=100)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.count() == len(_files())
