"""Registered queries for the catalogue operators (C1–C23, T27) and their
DuckDB oracles.  Nested catalogue records are built from the driver tables
(orders with their lines, suppliers with their nation) and flattened back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from .fixtures import table

R = 6


def _datasets(spark, sf):
    """Catalogue pages: one order with the array of its lines as files."""
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    res = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("format"))).alias("resources"))
    return o.join(res, o.o_orderkey == res.l_orderkey).select(
        F.col("o_orderkey").alias("id_page"), F.col("o_orderpriority").alias("page_priority"),
        "resources")


def q_explode_resources(spark, sf):
    return C.explode_resources(_datasets(spark, sf), "resources", ["id_page", "page_priority"])


def q_organization_rows(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    nested = s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                 F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
                 .alias("location"),
                 F.struct(F.col("s_acctbal").alias("balance")).alias("metrics")).alias("org"))
    return C.organization_rows(nested, {"id": "org.id", "name": "org.name",
                                        "nation": "org.location.name",
                                        "region": "org.location.region",
                                        "balance": "org.metrics.balance"})


def q_explode_reuse_pages(spark, sf):
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part")
    o = table(spark, sf, "orders")
    ds = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title")))
        .alias("datasets"))
    reuses = o.join(ds, o.o_orderkey == ds.l_orderkey).select(
        F.col("o_orderkey").alias("id_reuse"), F.col("o_orderstatus").alias("reuse_status"), "datasets")
    return C.explode_reuse_pages(reuses, "datasets", ["id_reuse", "reuse_status"])


def q_sanitize_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.sanitize_columns(d, ["text"]).select("doc_id", F.md5("text").alias("md5"))


def q_join_tags(spark, sf):
    p = table(spark, sf, "part")
    tags = F.split(F.concat_ws(" ", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                               F.col("p_type")), " ")
    tags = F.concat(tags, F.array(F.lit(None).cast("string")))
    return p.select("p_partkey", C.join_tags(tags).alias("tags"))


def _order_xml(spark, sf):
    o = table(spark, sf, "orders")
    xml = F.concat(F.lit("<dataset><organization><id>"), F.col("o_custkey").cast("string"),
                   F.lit("</id></organization><id>"), F.col("o_orderkey").cast("string"),
                   F.lit("</id><title>"), F.col("o_orderstatus"), F.lit("</title></dataset>"))
    return o.select("o_orderkey", xml.alias("xml"))


def q_first_descendant_text(spark, sf):
    x = _order_xml(spark, sf)
    return x.select("o_orderkey", C.first_descendant_text(F.col("xml"), "id").alias("first_id"),
                    C.first_descendant_text(F.col("xml"), "title").alias("title"),
                    C.first_descendant_text(F.col("xml"), "license").alias("license"))


def q_check_key_uniqueness(spark, sf):
    return C.check_key_uniqueness(table(spark, sf, "lineitem"), "l_orderkey",
                                  ["l_partkey", "l_suppkey"])


def q_repair_duplicate_ids(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("id"))
    r = C.repair_duplicate_ids(p, "id", "url", "page_id")
    return r.select("page_id", "original_id", "repaired",
                    F.length("id").cast("long").alias("id_length"))


def _bridge(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def q_distinct_reuses(spark, sf):
    return C.distinct_reuses(_bridge(spark, sf), ["o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_orderpriority", "o_totalprice"])


def q_project_page_reuse(spark, sf):
    return C.project_page_reuse(table(spark, sf, "lineitem"),
                                ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                 "l_returnflag", "l_linestatus"])


def _page_reuses(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("page"), F.col("l_orderkey").cast("string").alias("reuse"))


def q_reuses_per_page(spark, sf):
    return C.reuses_per_page(_page_reuses(spark, sf), "page", "reuse")


def q_attach_reuses(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("page"), "p_name")
    return C.attach_reuses(files, C.reuses_per_page(_page_reuses(spark, sf), "page", "reuse"), "page")


def _events_files(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("https://data.example/"), F.col("user_id").cast("string"), F.lit("/"),
                 F.col("event_id").cast("string")).alias("url"),
        F.col("event_id").alias("id"), F.col("event_type").alias("format"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.lit("file"))
        .otherwise(F.lit("remote")).alias("url_destination"))


def q_downloadable_files(spark, sf):
    return C.downloadable_files(_events_files(spark, sf))


def _download_merge(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    e = table(spark, sf, "events")
    files = o.select(F.col("o_orderkey").alias("id_file"),
                     F.when(F.col("o_orderpriority") == "5-LOW", F.lit("remote"))
                     .otherwise(F.lit("file")).alias("url_destination"))
    downloads = (li.groupBy(F.col("l_orderkey").alias("id_file"))
                 .agg(F.bool_and(F.col("l_linestatus") == "F").alias("_all_f"),
                      F.count_if(F.col("l_returnflag") == "R").alias("size_file"))
                 .filter("_all_f").select("id_file", "size_file", F.lit(True).alias("downloaded")))
    errors = e.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id_file"), F.col("event_type").alias("error"),
        F.col("props").alias("content_error"))
    return C.merge_download_status(files, downloads, errors, "id_file")


def q_merge_download_status(spark, sf):
    return _download_merge(spark, sf)


def q_download_consistency(spark, sf):
    return C.download_consistency(_download_merge(spark, sf))


def q_download_counts(spark, sf):
    return C.download_counts(_download_merge(spark, sf))


def q_value_counts(spark, sf):
    return C.value_counts(table(spark, sf, "documents"), "source")


def q_error_breakdown(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("fmt"), F.floor(F.col("value") / 100).cast("string")).alias("format"),
        F.col("event_type").alias("error"), F.col("props").alias("message"))
    return C.error_breakdown(e, "format", "error", "message")


def q_success_rate(spark, sf):
    o = table(spark, sf, "orders")
    return C.success_rate(o, "o_orderpriority", F.col("o_orderstatus") == "P")


def _mime_of_flag():
    return (F.when(F.col("l_returnflag") == "A", F.lit("text/plain"))
            .when(F.col("l_returnflag") == "N", F.lit("application/zip"))
            .otherwise(F.lit("text/xml")))


def q_merge_cleaning_log(spark, sf):
    li = table(spark, sf, "lineitem")
    log = li.select(F.concat_ws("--", F.col("l_orderkey").cast("string"),
                                F.col("l_linenumber").cast("string")).alias("matrix_name"),
                    F.col("l_orderkey").alias("source_file"), _mime_of_flag().alias("extension"))
    summary = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id_file"),
                                                "o_orderstatus", "o_orderpriority")
    _, reduced = C.merge_cleaning_log(log, summary, ["matrix_name", "source_file", "extension",
                                                     "o_orderstatus"])
    return reduced


def q_merge_cleaning_errors(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("source_file"), F.col("event_type").alias("error_type"),
        F.when(F.col("event_type") == "error", F.lit("application/octet-stream"))
        .when(F.col("event_type") == "view", F.lit("application/vnd.ms-excel"))
        .otherwise(F.col("event_type")).alias("extension"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id_file"), "c_mktsegment")
    return C.merge_cleaning_errors(e, cust, ["event_id", "source_file", "extension",
                                             "error_type", "c_mktsegment"])


def q_rename_extension(spark, sf):
    e = table(spark, sf, "events")
    mime = (F.when(F.col("event_type") == "click", F.lit("text/plain"))
            .when(F.col("event_type") == "view", F.lit("application/CDFV2-unknown"))
            .when(F.col("event_type") == "error", F.lit("application/vnd.openxmlformats-"
                                                        "officedocument.spreadsheetml.sheet"))
            .otherwise(F.col("event_type")))
    return e.select("event_id", C.rename_extension(mime).alias("extension"))


def q_size_by_extension(spark, sf):
    d = table(spark, sf, "documents").select(
        "lang", F.size(F.split("text", "\n")).alias("n_rows"),
        F.size(F.split(F.substring_index("text", "\n", 1), " ")).alias("n_cols"))
    out = C.size_by_extension(d, "lang", "n_rows", "n_cols")
    return out.select("extension", "n_tables",
                      *[F.round(c, R).alias(c) for c in out.columns if c.startswith(("rows_", "cols_"))])


QUERIES = {
    "explode_resources": q_explode_resources,
    "organization_rows": q_organization_rows,
    "explode_reuse_pages": q_explode_reuse_pages,
    "sanitize_text": q_sanitize_text,
    "join_tags": q_join_tags,
    "first_descendant_text": q_first_descendant_text,
    "check_key_uniqueness": q_check_key_uniqueness,
    "repair_duplicate_ids": q_repair_duplicate_ids,
    "distinct_reuses": q_distinct_reuses,
    "project_page_reuse": q_project_page_reuse,
    "reuses_per_page": q_reuses_per_page,
    "attach_reuses": q_attach_reuses,
    "downloadable_files": q_downloadable_files,
    "merge_download_status": q_merge_download_status,
    "download_consistency": q_download_consistency,
    "download_counts": q_download_counts,
    "value_counts": q_value_counts,
    "error_breakdown": q_error_breakdown,
    "success_rate": q_success_rate,
    "merge_cleaning_log": q_merge_cleaning_log,
    "merge_cleaning_errors": q_merge_cleaning_errors,
    "size_by_extension": q_size_by_extension,
    "rename_extension": q_rename_extension,
}

DOWNLOAD_MERGE_SQL = """
files AS (SELECT o_orderkey AS id_file, CASE WHEN o_orderpriority = '5-LOW' THEN 'remote' ELSE 'file' END AS url_destination FROM orders),
dl AS (SELECT l_orderkey AS id_file, count_if(l_returnflag = 'R') AS size_file, true AS downloaded
       FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linestatus = 'F')),
er AS (SELECT event_id AS id_file, event_type AS error, props AS content_error FROM events WHERE event_type = 'error'),
merged AS (SELECT f.id_file, f.url_destination, dl.size_file, coalesce(dl.downloaded, false) AS downloaded,
                  er.error, er.content_error
           FROM files f LEFT JOIN dl USING (id_file) LEFT JOIN er USING (id_file))"""

MIME_SQL = ("CASE l_returnflag WHEN 'A' THEN 'text/plain' WHEN 'N' THEN 'application/zip' "
            "ELSE 'text/xml' END")


def _rename_sql(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} = '{a}' THEN '{b}'" for a, b in C.EXTENSION_NAMES)
            + f" ELSE {x} END")


ORACLE = {
    "explode_resources": """SELECT o_orderkey AS id_page, o_orderpriority AS page_priority,
        l_partkey AS id, l_linenumber AS position, l_quantity AS size, l_returnflag AS format
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "organization_rows": """SELECT s_suppkey AS id, s_name AS name, n_name AS nation,
        n_regionkey AS region, s_acctbal AS balance
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "explode_reuse_pages": """SELECT o_orderkey AS id_reuse, o_orderstatus AS reuse_status,
        p_partkey AS page_id, p_brand AS page_title
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "sanitize_text": """SELECT doc_id, md5(replace(replace(replace(replace(text, ';', ','), '"', ''''),
        chr(10), ''), chr(13), '')) AS md5 FROM documents""",
    "join_tags": """SELECT p_partkey, replace(replace(p_name, ' ', '-') || ' ' || p_type, '-', '_') AS tags FROM part""",
    "first_descendant_text": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS first_id,
        o_orderstatus AS title, CAST(NULL AS VARCHAR) AS license FROM orders""",
    "check_key_uniqueness": """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_ids,
        count(DISTINCT l_partkey) AS n_distinct_l_partkey, count(DISTINCT l_suppkey) AS n_distinct_l_suppkey,
        count(*) - count(DISTINCT l_orderkey) AS n_duplicate_ids FROM lineitem""",
    "repair_duplicate_ids": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS id FROM pages),
        f AS (SELECT id, min(page_id) AS first FROM p GROUP BY id)
        SELECT page_id, id AS original_id, page_id <> first AS repaired,
               CAST(CASE WHEN page_id <> first THEN 56 ELSE length(id) END AS BIGINT) AS id_length
        FROM p JOIN f USING (id)""",
    "distinct_reuses": """SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "project_page_reuse": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem""",
    "reuses_per_page": """SELECT page, array_to_string(list_sort(list(reuse)), ' ') AS reuses, count(*) AS n_reuses
        FROM (SELECT DISTINCT l_partkey AS page, CAST(l_orderkey AS VARCHAR) AS reuse FROM lineitem)
        GROUP BY page""",
    "attach_reuses": """WITH r AS (SELECT page, array_to_string(list_sort(list(reuse)), ' ') AS reuses, count(*) AS n_reuses
        FROM (SELECT DISTINCT l_partkey AS page, CAST(l_orderkey AS VARCHAR) AS reuse FROM lineitem)
        GROUP BY page)
        SELECT p_partkey AS page, p_name, coalesce(reuses, '') AS reuses, coalesce(n_reuses, 0) AS n_reuses
        FROM part LEFT JOIN r ON p_partkey = page""",
    "downloadable_files": """SELECT 'https://data.example/' || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) AS url,
        event_id AS id, event_type AS format FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "merge_download_status": f"WITH {DOWNLOAD_MERGE_SQL} SELECT * FROM merged",
    "download_consistency": f"""WITH {DOWNLOAD_MERGE_SQL}
        SELECT count_if(downloaded AND error IS NOT NULL) AS n_downloaded_and_error,
               count_if(NOT downloaded AND error IS NULL) AS n_neither FROM merged""",
    "download_counts": f"""WITH {DOWNLOAD_MERGE_SQL}
        SELECT count(*) AS n_files, count_if(url_destination <> 'file') AS n_remote,
               count_if(downloaded) AS n_downloaded, count_if(size_file = 0) AS n_empty,
               count_if(error IS NOT NULL) AS n_errors,
               count(*) - count_if(url_destination <> 'file') - count_if(downloaded) - count_if(error IS NOT NULL) AS n_ignored
        FROM merged""",
    "value_counts": "SELECT source AS value, count(*) AS n FROM documents GROUP BY source",
    "error_breakdown": """WITH e AS (SELECT 'fmt' || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS format,
               event_type AS error, props AS message FROM events),
        pe AS (SELECT format, error, count(*) AS n FROM e GROUP BY ALL),
        top AS (SELECT format, first(error ORDER BY n DESC, error) AS top_error, max(n) AS n_top_error FROM pe GROUP BY format)
        SELECT t.format, t.top_error, t.n_top_error, e.message, count(*) AS n_message
        FROM e JOIN top t ON e.format = t.format AND e.error = t.top_error GROUP BY ALL""",
    "success_rate": """SELECT o_orderpriority, count_if(o_orderstatus <> 'P') AS n_success,
        round(count_if(o_orderstatus <> 'P') / count(*) * 100, 2) AS rate FROM orders GROUP BY o_orderpriority""",
    "merge_cleaning_log": f"""SELECT CAST(l_orderkey AS VARCHAR) || '--' || CAST(l_linenumber AS VARCHAR) AS matrix_name,
        l_orderkey AS source_file, {_rename_sql(MIME_SQL)} AS extension, o_orderstatus
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "merge_cleaning_errors": f"""SELECT event_id, user_id AS source_file,
        {_rename_sql("CASE WHEN event_type = 'error' THEN 'application/octet-stream' WHEN event_type = 'view' THEN 'application/vnd.ms-excel' ELSE event_type END")} AS extension,
        event_type AS error_type, c_mktsegment
        FROM events LEFT JOIN customer ON user_id = c_custkey""",
    "rename_extension": f"""SELECT event_id, {_rename_sql("CASE WHEN event_type = 'click' THEN 'text/plain' WHEN event_type = 'view' THEN 'application/CDFV2-unknown' WHEN event_type = 'error' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE event_type END")} AS extension FROM events""",
    "size_by_extension": f"""WITH d AS (SELECT lang, len(string_split(text, chr(10))) AS n_rows,
               len(string_split(split_part(text, chr(10), 1), ' ')) AS n_cols FROM documents)
        SELECT lang AS extension, count(*) AS n_tables,
          round(quantile_cont(n_rows::DOUBLE, 0.25), {R}) AS rows_p25, round(quantile_cont(n_rows::DOUBLE, 0.5), {R}) AS rows_p50,
          round(quantile_cont(n_rows::DOUBLE, 0.75), {R}) AS rows_p75, round(quantile_cont(n_cols::DOUBLE, 0.25), {R}) AS cols_p25,
          round(quantile_cont(n_cols::DOUBLE, 0.5), {R}) AS cols_p50, round(quantile_cont(n_cols::DOUBLE, 0.75), {R}) AS cols_p75
        FROM d GROUP BY lang""",
}
