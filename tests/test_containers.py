"""Content types of containers, against archives that Python writes."""

import io
import zipfile

from pyspark.sql import functions as F

from tabulon.sources import files as S

SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
TEXT = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def _zip(*members, how=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def _compound(*names):
    entries = b"".join(n.encode("utf-16le").ljust(64, b"\0") + bytes(64) for n in ("Root Entry", *names))
    return bytes.fromhex("D0CF11E0A1B11AE1") + bytes(504) + entries + b"\xff" * 900


def test_containers_are_told_apart(spark):
    parts, noise = ("[Content_Types].xml", "<Types/>"), ("data/a.csv", "a;b\n" * 9_000)
    ods = "application/vnd.oasis.opendocument.spreadsheet"
    cases = [
        (_zip(parts, noise, ("xl/workbook.xml", "<w/>")), SHEET, "excel"),
        (_zip(("xl/workbook.bin", "x"), parts), SHEET, "excel"),
        (_zip(parts, ("word/document.xml", "<w/>")), TEXT, "ignored"),
        (_zip(noise), "application/zip", "ignored"),
        # names inside a member's bytes are not members
        (_zip(("notes.txt", "[Content_Types].xml xl/workbook.xml"), how=zipfile.ZIP_STORED), "application/zip", "ignored"),
        (_zip(("mimetype", ods), ("content.xml", "<c/>"), how=zipfile.ZIP_STORED), ods, "ignored"),
        (_zip(), "application/zip", "ignored"),
        (_compound("Workbook", "Summary"), "application/vnd.ms-excel", "excel"),
        (_compound("Summary", "Book"), "application/vnd.ms-excel", "excel"),
        (_compound("1Table", "WordDocument"), "application/msword", "ignored"),
        (_compound("Contents"), "application/CDFV2-unknown", "excel"),
        (b"\xef\xbb\xbf" + b" " * 90 + b"<?xml version='1.0'?><a/>", "text/xml", "xml"),
        (b"\xef\xbb\xbfa;b\n", "text/plain", "plain"), (b"a\xe9;b", "application/octet-stream", "plain"), (b"", None, "ignored"),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _, _) in enumerate(cases)], "id int, content binary")
    got = df.select("id", S.detect_mime(F.col("content")).alias("mime")).withColumn("route", S.route_by_type(F.col("mime")))
    assert [(r.mime, r.route) for r in got.orderBy("id").collect()] == [(m, r) for _, m, r in cases]


def test_archives_are_built_one_at_a_time():
    import pyarrow as pa

    members = [{"name": "text/body.txt", "text": "é" * 5}, {"name": "meta/", "text": None}, {"name": "none.txt", "text": None}]
    batch = pa.RecordBatch.from_pylist([{"archive": str(i), "members": members} for i in range(3)])
    out = list(S._zip_rows(iter([batch])))
    assert [b.num_rows for b in out] == [1, 1, 1]  # a batch was one frame before
    for i, b in enumerate(out):
        row = b.to_pylist()[0]
        with zipfile.ZipFile(io.BytesIO(row["content"])) as zf:
            assert row["archive"] == str(i) and zf.read("text/body.txt").decode() == "é" * 5
            assert zf.namelist() == ["text/body.txt", "meta/", "none.txt"]
