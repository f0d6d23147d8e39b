"""Cases in which data once went missing: braces inside strings, deep nesting,
damaged archives, neighbours without a descriptive row."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from tabulon.operators import neighbors as N
from tabulon.operators import structured as ST
from tabulon.sources import files as S


def test_brace_strings_and_deep_nesting_keep_their_cells(spark):
    deep = {"z": 1}
    for _ in range(24):
        deep = {"n": deep}
    files = spark.createDataFrame([("braces", '[{"a":"{hello","b":1}]'), ("deep", json.dumps([deep]))],
                                  "file_id string, text string")
    cells = {(r["file_id"], r["col_name"], r["value"]) for r in ST.tablize_json(files).collect()}
    assert cells == {("braces", "a", "{hello"), ("braces", "b", "1"), ("deep", "n." * 24 + "z", "1")}


def test_damaged_archives_become_error_rows(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as zf:
        zf.writestr("d/good.txt", b"good")
        zf.writestr("bad.txt", b"payload")
    broken = buf.getvalue().replace(b"payload", b"Payload", 1)
    rows = [("mixed", bytearray(broken)), ("junk", bytearray(b"no zip")), ("none", None)]
    good, bad = S.expand_archives_checked(spark.createDataFrame(rows, "archive string, content binary"))
    assert [(r["archive"], r["member"], bytes(r["content"])) for r in good.collect()] == [
        ("mixed", "d--good.txt", b"good")]
    assert {(r["archive"], r["member"], r["error_type"]) for r in bad.collect()} == {
        ("mixed", "bad.txt", "bad_archive"), ("junk", None, "bad_archive"), ("none", None, "bad_archive")}


def test_co_reuse_and_report_without_the_pair_table(spark):
    edges = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (1, 3, 0.7), (2, 1, 0.5)],
                                  "a long, b long, distance double")
    reuses = spark.createDataFrame([(1, 9), (2, 9), (2, 8), (3, 8), (3, 7)], "file long, reuse long")
    local = {tuple(r) for r in N.reuse_edges_local(edges, reuses).select("target", "x1", "x2").collect()}
    assert local == {(1, 1, 2), (1, 2, 3)}
    files = spark.createDataFrame([(2, "s")], "file long, source string")
    report = {(r["a"], r["b"]): (r["source"], r["common_reuse"], r["rank"])
              for r in N.describe_neighbors(edges, files, reuses).collect()}
    assert report == {(1, 2): ("s", True, 1), (1, 3): (None, False, 2), (2, 1): (None, True, 1)}


def test_neighbour_search_of_degenerate_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(90, None), (91, [float("nan"), 0.0]), (92, [5.0, 2.0])]
    space = spark.createDataFrame(rows, "file long, w array<double>")
    near = N.knn(space, 3, block_rows=8)
    by = {k: [r["b"] for r in sorted(v, key=lambda r: r["rank"])] for k, v in _grouped(near).items()}
    assert by == {i: [j for j in range(4) if j != i][:3] for i in range(40)} | {92: [0, 1, 2]}
    assert N.radius_neighbors(space, 0.0, block_rows=8).count() == 40 * 40 + 1
    assert N.knn(space.filter(F.col("file") < 0), 3).count() == 0


def _grouped(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r["a"], []).append(r)
    return out


def test_markup_behind_many_blanks(spark):
    from tabulon.sources import files as S

    rows = [(" " * 5000 + "<!DOCTYPE html><p>", "text/html"), (" " * 100 + "<?xml?>", "text/xml"), (" " * 100 + "x", "text/plain")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(S.detect_mime(F.encode("t", "UTF-8")) != F.col("want")).count() == 0
