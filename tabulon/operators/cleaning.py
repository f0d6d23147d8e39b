"""One cleaning pass over mixed files (T2 with T14, T21, T22, S7): content
type, decoding, dispatch to the reader of each kind, and one error channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import decode_content, detect_encoding, detect_mime, route_by_type
from .structured import classify_json, json_tables, xml_tables
from .tablize import looks_like_json, tablize_delimited


def _route(files: DataFrame) -> DataFrame:
    """(file_id, route, text): ``delimited``, ``json``, ``xml``, ``excel``,
    ``ignored`` or ``empty``.  Plain text is JSON when it parses as an object
    or array, or opens like one and has JSON's share of structure characters
    (damaged JSON); only text is decoded."""
    # each in a column of its own: what a branch of an expression names again is computed again
    x = files.withColumn("_mime", detect_mime(F.col("content")))
    x = x.withColumn("_route", F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, F.lit("empty"))
                     .otherwise(route_by_type(F.col("_mime"))))
    x = x.withColumn("_encoding", F.when(F.col("_route").isin("plain", "xml"), detect_encoding(F.col("content"))))
    x = x.withColumn("text", F.when(F.col("_route").isin("plain", "xml"),
                                    decode_content(F.col("content"), F.col("_encoding"))))
    # null for all other texts: both sides of an "and" may be computed for every row
    opens = (F.col("_route") == "plain") & F.regexp_like("text", F.lit(r"\A\s*[{\[]"))
    x = x.withColumn("_json", F.when(opens, F.col("text")))
    is_json = (classify_json(F.col("_json")) != "text") | looks_like_json(F.col("_json"))
    return x.select("file_id", F.when(is_json, F.lit("json"))
                    .when(F.col("_route") == "plain", F.lit("delimited"))
                    .otherwise(F.col("_route")).alias("route"), "text")


def _joined(leaves: DataFrame) -> DataFrame:
    """Leaves as one text per file, ``name: value`` by line in document order."""
    line = F.concat("name", F.lit(": "), F.coalesce("value", F.lit("null"))).alias("line")
    return leaves.groupBy("file_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("path", line))), lambda s: s["line"]), "\n").alias("extradata"))


def clean_files(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> dict[str, DataFrame]:
    """Clean a corpus of files (id, bytes) of any kind.

    Returns ``cells`` (file_id, row, col_name, value), ``extradata`` (file_id,
    extradata) of the files that gave a table, ``errors`` (file_id,
    error_type) of the others and ``routes`` (file_id, route).  Every file is
    in exactly one of cells and errors: ``empty`` or null content, ``ignored``
    types and workbooks (``workbook``: their cells come as a table, see
    ``sheets``) are errors too.  File ids are unique."""
    from ..session import cut_lineage

    routed = cut_lineage(_route(files.select(F.col(id_col).cast("string").alias("file_id"),
                                             F.col(content_col).alias("content"))))

    def of(route: str) -> DataFrame:
        return routed.filter(F.col("route") == route).select("file_id", "text")

    flat = tablize_delimited(of("delimited"))
    js = json_tables(of("json"))
    xml = xml_tables(of("xml"), xml_col="text")
    cells = flat["cells"].select("file_id", F.col("row").cast("long").alias("row"), "col_name", "value")
    extradata = flat["extradata"].join(flat["profile"].select("file_id"), "file_id", "left_semi") \
        .select("file_id", "extradata")
    errors = flat["errors"]
    for part in (js, xml):
        cells = cells.unionByName(part["cells"].withColumn("row", F.col("row").cast("long")))
        extradata = extradata.unionByName(_joined(part["extradata"]))
        errors = errors.unionByName(part["errors"])
    unread = routed.filter(F.col("route").isin("empty", "ignored", "excel")).select(
        "file_id", F.when(F.col("route") == "excel", F.lit("workbook")).otherwise(F.col("route")).alias("error_type"))
    return {"cells": cells, "extradata": extradata.filter("extradata <> ''"),
            "errors": errors.unionByName(unread), "routes": routed.select("file_id", "route")}
