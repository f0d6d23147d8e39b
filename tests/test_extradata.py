"""Leaves outside a record list, error rows, and mixed files in one pass."""

import json

from tabulon.operators import structured as ST
from tabulon.operators.cleaning import _route, clean_files

SCHEMA = "file_id string, text string"


def test_leaves_in_document_order(spark):
    deep = {"z": {"b": [1, [2, {"q": None}]], "a": "x"}, "rows": [{"k": 1, "n": {"m": 2}}, {"k": 3}],
            "e": {}, "f": [], "t": [{"only": 1}]}
    files = spark.createDataFrame([("deep", json.dumps(deep)), ("root", '[{"a": 1}]'), ("none", '{"a": 1}'),
                                   ("bad", '{"a": [{"b": 1}]'), ("null", None), ("empty", "")], SCHEMA)
    r = ST.json_tables(files)
    got = [(r["name"], r["value"]) for r in r["extradata"].orderBy("file_id", "path").collect()]
    assert got == [("z.b", "1"), ("z.b", "2"), ("z.b.q", None), ("z.a", "x"), ("e", "{}"), ("f", "[]"), ("t.only", "1")]
    assert {tuple(x) for x in r["errors"].collect()} == {
        ("none", "no_record_list"), ("bad", "no_json"), ("null", "no_json"), ("empty", "no_json")}
    assert {x["file_id"] for x in r["cells"].collect()} == {"deep", "root"}
    nothing = ST.json_tables(files.limit(0))
    assert [nothing[k].count() for k in ("cells", "extradata", "errors")] == [0, 0, 0]


def test_every_xml_file_has_a_row(spark):
    rows = [("a", "<r v='1'><h>top</h><i><x>1</x></i><i><x>2</x></i></r>"), ("b", "<r><i/></r>"), ("c", "<r><i>"), ("d", None)]
    r = ST.xml_tables(spark.createDataFrame(rows, "file_id string, xml string"))
    assert {tuple(x) for x in r["errors"].collect()} == {
        ("b", "no_record_list"), ("c", "malformed_xml"), ("d", "malformed_xml")}
    assert [(x["name"], x["value"]) for x in r["extradata"].orderBy("path").collect()] == [
        ("r.@v", "1"), ("r.h.$", "top")]


def test_each_mixed_file_is_a_table_or_an_error(spark):
    table = "\n".join(["id;name;size"] + [f"{i};n{i};{i}" for i in range(30)])
    files = {"plain": table.encode(), "mark": b"\xef\xbb\xbf" + table.encode(), "wide": b"\xff\xfe" + table.encode("utf-16-le"),
             "latin": table.replace("n7", "n\xe9").encode("latin-1"), "js": b' [{"a": 1}]', "cut": b'{"a": [{"b": 1}',
             "xml": b"<?xml version='1.0'?><r><i><x>1</x></i><i><x>2</x></i></r>", "empty": b"", "null": None,
             "gz": b"\x1f\x8b\x08", "book": bytes.fromhex("D0CF11E0A1B11AE1"), "prose": b"Nothing tabular"}
    r = clean_files(spark.createDataFrame([(k, v) for k, v in files.items()], "file_id string, content binary"))
    errors = {x["file_id"]: x["error_type"] for x in r["errors"].collect()}
    tables = {x["file_id"] for x in r["cells"].select("file_id").distinct().collect()}
    assert not tables & set(errors) and tables | set(errors) == set(files)
    assert {"js", "xml", "plain"} <= tables
    assert errors["cut"] == "no_json" and errors["gz"] == "ignored" and errors["book"] == "workbook"
    assert errors["empty"] == errors["null"] == "empty"


def test_a_file_is_looked_at_once_and_only_text_that_opens_like_json_is_parsed(spark):
    files = spark.createDataFrame([("a", b"x;y")], "file_id string, content binary")
    plan = _route(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("50415231") == 1  # the last signature of the type's search
    assert plan.count("parseJson(") == plan.count("parseJson(_json") > 0
