"""Registered queries for delimited-text tablizing (T5–T17, C22) and their
DuckDB oracles.  Files are built from ``part`` (``;``) and ``customer``
(``,``, with an empty column) with a comment line and a header; the
tablized cells must give back the original rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import md5_rank_sql
from ..operators import tablize as T
from .fixtures import (CUSTOMER_COLS, CUSTOMER_ROWS_PER_FILE, PART_COLS, PART_ROWS_PER_FILE,
                       delimited_files, multiline_files, quoted_files, table)

R = 6
SEED = 0


def _run(spark, sf):
    return T.tablize_delimited(delimited_files(spark, sf))


def _lines(spark, sf):
    return T.lines(delimited_files(spark, sf))


def q_count_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.count_lines(F.col("text")).alias("n_lines"))


def q_json_char_ratio(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("props").alias("text"),
                                          F.lit("events").alias("src"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("src"))
    u = e.unionByName(d)
    return u.select("src", "id", F.round(T.json_char_ratio(F.col("text")), R).alias("ratio"),
                    T.looks_like_json(F.col("text")).alias("is_json"))


def q_sample_lines(spark, sf):
    s, per = T.sample_lines(_lines(spark, sf), SEED)
    return s.select("file_id", "line_no").join(per, "file_id")


def q_sniff_delimiter(spark, sf):
    return T.sniff_delimiter(_lines(spark, sf)).select("file_id", "delimiter", F.round("share", R).alias("share"))


def q_infer_width(spark, sf):
    lns = _lines(spark, sf)
    return T.infer_width(lns, T.sniff_delimiter(lns))


def q_split_content_extradata(spark, sf):
    r = _run(spark, sf)
    n = r["content"].groupBy("file_id").agg(F.count(F.lit(1)).alias("n_content"))
    return r["extradata"].join(n, "file_id")


def q_header_vote(spark, sf):
    r = _run(spark, sf)
    return T.header_vote(r["content"]).select("file_id", "r", F.round("score", R).alias("score"))


def q_search_header(spark, sf):
    return _run(spark, sf)["headers"]


def q_build_table(spark, sf):
    r = _run(spark, sf)
    return T.build_table(r["content"], r["headers"])


def q_drop_empty_columns(spark, sf):
    return _run(spark, sf)["cells"]


def q_tablize_delimited(spark, sf):
    return _run(spark, sf)["cells"].select("file_id", "row", "col_name", "value")


def q_table_shape_profile(spark, sf):
    return _run(spark, sf)["profile"]


def q_cleaning_log_record(spark, sf):
    files = delimited_files(spark, sf)
    r = T.tablize_delimited(files)
    meta = files.select("file_id", F.concat("file_id", F.lit(".csv")).alias("file_name"),
                        F.substring_index("file_id", "-", 1).alias("source_file"),
                        F.lit("text/plain").alias("extension"), F.lit(False).alias("zipfile"))
    return T.cleaning_log_record(r["profile"], r["headers"], r["extradata"], T.header_names(r["cells"]),
                                 meta)


def q_stage_counts(spark, sf):
    files = delimited_files(spark, sf)
    return T.stage_counts(files, T.tablize_delimited(files))


def q_tablize_quoted(spark, sf):
    """T13 with quoted fields: a quarter of the names hold the delimiter and
    doubled quotes."""
    cells = T.tablize_delimited(quoted_files(spark, sf))["cells"]
    return cells.select("file_id", "row", "col_name", "value")


def q_tablize_multiline(spark, sf):
    """T8, T13, T14 with quoted fields over several lines."""
    cells = T.tablize_delimited(multiline_files(spark, sf))["cells"]
    return cells.select("file_id", "row", "col_name", "value")


def q_incremental_tablize(spark, sf):
    """S8 as a stream: land the files, tablize what arrived, run again (the
    second run finds nothing new), read the appended cells."""
    from ..session import scratch_dir
    from ..streaming.incremental import land_text_files, tablize_landing_folder

    landing, out, ck = (scratch_dir(spark, n) for n in ("landing", "landed-out", "landing-ckpt"))
    land_text_files(delimited_files(spark, sf), landing)
    tablize_landing_folder(spark, landing, out, ck)
    tablize_landing_folder(spark, landing, out, ck)
    return spark.read.parquet(f"{out}/cells").select("file_id", "row", "col_name", "value")


QUERIES = {
    "incremental_tablize": q_incremental_tablize,
    "count_lines": q_count_lines,
    "json_char_ratio": q_json_char_ratio,
    "sample_lines": q_sample_lines,
    "sniff_delimiter": q_sniff_delimiter,
    "infer_width": q_infer_width,
    "split_content_extradata": q_split_content_extradata,
    "header_vote": q_header_vote,
    "search_header": q_search_header,
    "build_table": q_build_table,
    "tablize_delimited": q_tablize_delimited,
    "tablize_quoted": q_tablize_quoted,
    "tablize_multiline": q_tablize_multiline,
    "drop_empty_columns": q_drop_empty_columns,
    "table_shape_profile": q_table_shape_profile,
    "cleaning_log_record": q_cleaning_log_record,
    "stage_counts": q_stage_counts,
}

# ---------------------------------------------------------------------------
# DuckDB oracles: the same rules written in SQL over the same files
# ---------------------------------------------------------------------------

NL = "chr(10)"


def _files_sql(tbl, key, cols, sep, per, prefix, comment, empty_col=None):
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + (", ''" if empty_col else "")
    head = sep.join(cols + ([empty_col] if empty_col else []))
    return f"""SELECT '{prefix}' || CAST(b AS VARCHAR) AS file_id,
        '{comment} ' || CAST(b AS VARCHAR) || {NL} || '{head}' || {NL}
        || string_agg(line, {NL} ORDER BY k) AS text
      FROM (SELECT CAST(floor({key} / {per}) AS BIGINT) AS b, {key} AS k,
                   concat_ws('{sep}', {parts}) AS line FROM {tbl}) GROUP BY b"""


FILES = f"""files AS ({_files_sql('part', 'p_partkey', PART_COLS, ';', PART_ROWS_PER_FILE, 'part-', '# part batch')}
  UNION ALL {_files_sql('customer', 'c_custkey', CUSTOMER_COLS, ',', CUSTOMER_ROWS_PER_FILE, 'cust-', '# customer batch', 'c_comment')}),
lns AS (SELECT file_id, unnest(generate_series(0, len(p) - 1)) AS line_no, unnest(p) AS line
        FROM (SELECT file_id, string_split(text, {NL}) AS p FROM files)),
per AS (SELECT file_id, count(*) AS n_lines,
          CASE WHEN count(*) >= {T.THRESHOLD_N_ROW} THEN least(CAST(round(count(*) * {T.RATIO_SAMPLE} / 100.0) AS BIGINT), {T.MAX_SAMPLE})
               ELSE count(*) END AS size,
          CAST(CASE WHEN count(*) >= {T.THRESHOLD_N_ROW} THEN {T.THRESHOLD_N_COL} ELSE {T.SMALL_FILE_N_COL} END AS DOUBLE) AS threshold
        FROM lns GROUP BY file_id),
smp AS (SELECT file_id, line_no, line FROM (
          SELECT l.*, p.size, row_number() OVER (PARTITION BY l.file_id ORDER BY {md5_rank_sql(str(SEED), 'l.file_id', 'l.line_no')}, l.line_no) AS rn
          FROM lns l JOIN per p USING (file_id)) WHERE rn <= size),
cand AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{d}')" for i, d in enumerate(T.DELIMITERS) if d != chr(9))}, ({T.DELIMITERS.index(chr(9))}, chr(9))) c(pref, delim)),
cnts AS (SELECT file_id, pref, delim, length(line) - length(replace(line, delim, '')) AS cnt FROM lns, cand),
freq AS (SELECT file_id, pref, delim, cnt, count(*) AS f FROM cnts GROUP BY ALL),
md AS (SELECT file_id, pref, delim, arg_max(cnt, f * 1000000 + cnt) AS mode, max(f) AS f, sum(f) AS n FROM freq GROUP BY ALL),
dl AS (SELECT file_id, first(delim ORDER BY share DESC, pref) AS delimiter, max(share) AS share FROM (
         SELECT *, (2 * f - n) / n AS share FROM md WHERE mode > 0 AND (2 * f - n) / n >= {T.DELIMITER_CONSISTENCY})
       GROUP BY file_id),
wc AS (SELECT s.file_id, length(line) - length(replace(line, delimiter, '')) AS cnt FROM lns s JOIN dl USING (file_id)),
wd AS (SELECT file_id, cnt + 1 AS n_col FROM (
         SELECT file_id, cnt, count(*) AS f, sum(count(*)) OVER (PARTITION BY file_id) AS n FROM wc GROUP BY file_id, cnt)
       WHERE f / n > {T.WIDTH_SHARE}),
shp AS (SELECT * FROM dl JOIN wd USING (file_id)),
lj AS (SELECT l.*, s.delimiter, s.n_col, length(line) - length(replace(line, s.delimiter, '')) + 1 = s.n_col AS good
       FROM lns l JOIN shp s USING (file_id)),
content AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS gidx, line_no, line, delimiter, n_col
            FROM lj WHERE good),
extra AS (SELECT s.file_id, coalesce(string_agg(lj.line, ' ' ORDER BY lj.line_no), '') AS extradata
          FROM shp s LEFT JOIN lj ON lj.file_id = s.file_id AND NOT lj.good GROUP BY s.file_id),
ng AS (SELECT file_id, count(*) AS n_good FROM content GROUP BY file_id),
hc AS (SELECT c.file_id, c.gidx AS r, c.n_col, string_split(regexp_replace(c.line, '^\\s+|\\s+$', '', 'g'), c.delimiter) AS hcells
       FROM content c JOIN ng USING (file_id) WHERE c.gidx < least({T.CHECK_HEADER}, floor(n_good / 2))),
fw AS (SELECT file_id, gidx AS g, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), delimiter) AS cells FROM content),
ex AS (SELECT hc.file_id, hc.r, hc.n_col, hc.hcells, coalesce(fw.cells[col + 1], '') AS cell, col
       FROM hc JOIN fw ON fw.file_id = hc.file_id AND fw.g > hc.r AND fw.g <= hc.r + 9,
            range(0, hc.n_col) t(col)),
typed AS (SELECT *, CASE WHEN regexp_matches(cell, '{T.INT_RE}') THEN 'int'
                         WHEN regexp_matches(cell, '{T.FLOAT_RE}') THEN 'float'
                         ELSE 'len:' || CAST(length(cell) AS VARCHAR) END AS typ FROM ex),
pc AS (SELECT file_id, r, col, count(DISTINCT typ) AS n_types, min(typ) AS typ, any_value(hcells) AS hcells,
              any_value(n_col) AS n_col FROM typed GROUP BY ALL),
vt AS (SELECT file_id, r, sum(CASE WHEN length(h) = 1 THEN -1.0 / n_col
                                  WHEN (CASE WHEN typ = 'int' THEN regexp_matches(h, '{T.INT_RE}')
                                             WHEN typ = 'float' THEN regexp_matches(h, '{T.FLOAT_RE}')
                                             ELSE length(h) = CAST(substr(typ, 5) AS INTEGER) END) THEN -1.0 / n_col
                                  ELSE 1.0 END) AS score
       FROM (SELECT *, hcells[col + 1] AS h FROM pc WHERE n_types = 1) GROUP BY file_id, r),
votes AS (SELECT hc.file_id, hc.r, CASE WHEN len(hc.hcells) <> hc.n_col OR vt.score IS NULL THEN -1.0 ELSE vt.score END AS score
          FROM hc LEFT JOIN vt USING (file_id, r)),
hdr AS (SELECT file_id, coalesce(min(CASE WHEN score > 0 THEN r END), min(CASE WHEN score > -1 THEN r END)) AS header_row,
               min(CASE WHEN score > 0 THEN r END) IS NULL AS no_header FROM votes GROUP BY file_id
        HAVING coalesce(min(CASE WHEN score > 0 THEN r END), min(CASE WHEN score > -1 THEN r END)) IS NOT NULL)"""


def _orig_cells(tbl, key, cols, per, prefix):
    sel = " UNION ALL ".join(
        f"SELECT file_id, row, {i} AS col, '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM o"
        for i, c in enumerate(cols))
    return f"""(WITH o AS (SELECT '{prefix}' || CAST(CAST(floor({key} / {per}) AS BIGINT) AS VARCHAR) AS file_id,
        row_number() OVER (PARTITION BY floor({key} / {per}) ORDER BY {key}) - 1 AS row, * FROM {tbl})
        {sel})"""


ORIG = (f"orig AS ({_orig_cells('part', 'p_partkey', PART_COLS, PART_ROWS_PER_FILE, 'part-')} UNION ALL "
        f"{_orig_cells('customer', 'c_custkey', CUSTOMER_COLS, CUSTOMER_ROWS_PER_FILE, 'cust-')})")
ORIG_SELECT = (f"SELECT * FROM {_orig_cells('part', 'p_partkey', PART_COLS, PART_ROWS_PER_FILE, 'part-')} "
               f"UNION ALL SELECT * FROM {_orig_cells('customer', 'c_custkey', CUSTOMER_COLS, CUSTOMER_ROWS_PER_FILE, 'cust-')}")
NA_SQL = "(" + ", ".join(f"'{v}'" for v in T.NA_VALUES) + ")"

PROFILE_SQL = f"""WITH {ORIG},
        pc AS (SELECT file_id, col, count(*) AS n, count(value) AS n_present,
                 count_if(regexp_matches(value, '{T.INT_RE}')) AS n_int,
                 count_if(regexp_matches(value, '{T.INT_RE}') OR regexp_matches(value, '{T.FLOAT_RE}')) AS n_num
               FROM orig GROUP BY ALL),
        k AS (SELECT file_id, CASE WHEN n_int = n THEN 'integer' WHEN n_num = n_present THEN 'float' ELSE 'object' END AS kind FROM pc)
        SELECT r.file_id, r.x, k2.y, k2.integer, k2.float, k2.object
        FROM (SELECT file_id, CAST(count(DISTINCT row) AS BIGINT) AS x FROM orig GROUP BY file_id) r
        JOIN (SELECT file_id, count(*) AS y, count_if(kind = 'integer') AS integer, count_if(kind = 'float') AS float,
                     count_if(kind = 'object') AS object FROM k GROUP BY file_id) k2 USING (file_id)"""

ORACLE = {
    "count_lines": f"""SELECT doc_id, CAST(greatest(len(string_split(text, {NL}))
        - CASE WHEN ends_with(text, {NL}) THEN 1 ELSE 0 END, 1) AS BIGINT) AS n_lines FROM documents""",
    "json_char_ratio": f"""WITH u AS (SELECT event_id AS id, props AS text, 'events' AS src FROM events
          UNION ALL SELECT doc_id, text, 'documents' FROM documents)
        SELECT src, id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^{{}}\\[\\]:]', '', 'g')) / length(text) END, {R}) AS ratio,
          CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^{{}}\\[\\]:]', '', 'g')) / length(text) > {T.THRESHOLD_JSON} END AS is_json
        FROM u""",
    "sample_lines": f"WITH {FILES} SELECT s.file_id, s.line_no, p.n_lines, p.threshold FROM smp s JOIN per p USING (file_id)",
    "sniff_delimiter": f"WITH {FILES} SELECT file_id, delimiter, round(share, {R}) AS share FROM dl",
    "infer_width": f"WITH {FILES} SELECT file_id, n_col FROM wd",
    "split_content_extradata": f"""WITH {FILES} SELECT e.file_id, e.extradata, n.n_content
        FROM extra e JOIN (SELECT file_id, count(*) AS n_content FROM content GROUP BY file_id) n USING (file_id)""",
    "header_vote": f"WITH {FILES} SELECT file_id, r, round(score, {R}) AS score FROM votes",
    "search_header": f"WITH {FILES} SELECT * FROM hdr",
    "build_table": f"""WITH {FILES}, {ORIG}
        SELECT file_id, row, col, col_name, value FROM orig
        UNION ALL SELECT file_id, row, 5, 'c_comment', NULL FROM orig WHERE col = 0 AND file_id LIKE 'cust-%'""",
    "drop_empty_columns": f"WITH {ORIG} SELECT file_id, row, col, col_name, value FROM orig",
    "tablize_delimited": f"WITH {ORIG} SELECT file_id, row, col_name, value FROM orig",
    "tablize_quoted": f"""SELECT file_id, row, col_name, CASE WHEN col = 1 AND k % 4 = 0
            THEN value || '; said "' || brand || '"' ELSE value END AS value
        FROM (SELECT *, max(CASE WHEN col = 0 THEN CAST(value AS BIGINT) END) OVER (PARTITION BY file_id, row) AS k,
                     max(CASE WHEN col = 2 THEN value END) OVER (PARTITION BY file_id, row) AS brand
              FROM {_orig_cells('part', 'p_partkey', PART_COLS, PART_ROWS_PER_FILE, 'part-')})""",
    "tablize_multiline": f"""SELECT file_id, row, col_name,
            CASE WHEN col = 1 AND k % 3 = 0 THEN value || '; "' || {NL} || {NL} || brand || '";;'
                 WHEN col = 3 AND k % 5 = 0 THEN '"so" ' || value ELSE value END AS value
        FROM (SELECT *, max(CASE WHEN col = 0 THEN CAST(value AS BIGINT) END) OVER (PARTITION BY file_id, row) AS k,
                     max(CASE WHEN col = 2 THEN value END) OVER (PARTITION BY file_id, row) AS brand
              FROM {_orig_cells('part', 'p_partkey', PART_COLS, PART_ROWS_PER_FILE, 'part-')})""",
    "incremental_tablize": f"WITH {ORIG} SELECT file_id, row, col_name, value FROM orig",
    "table_shape_profile": f"""WITH {ORIG},
        pc AS (SELECT file_id, col, count(*) AS n, count(value) AS n_present,
                 count_if(regexp_matches(value, '{T.INT_RE}')) AS n_int,
                 count_if(regexp_matches(value, '{T.INT_RE}') OR regexp_matches(value, '{T.FLOAT_RE}')) AS n_num
               FROM orig GROUP BY ALL),
        k AS (SELECT file_id, CASE WHEN n_int = n THEN 'integer' WHEN n_num = n_present THEN 'float' ELSE 'object' END AS kind FROM pc)
        SELECT r.file_id, r.x, k2.y, k2.integer, k2.float, k2.object
        FROM (SELECT file_id, CAST(count(DISTINCT row) AS BIGINT) AS x FROM orig GROUP BY file_id) r
        JOIN (SELECT file_id, count(*) AS y, count_if(kind = 'integer') AS integer, count_if(kind = 'float') AS float,
                     count_if(kind = 'object') AS object FROM k GROUP BY file_id) k2 USING (file_id)""",
    "cleaning_log_record": f"""WITH prof AS ({PROFILE_SQL}),
        names AS (SELECT file_id, '[' || string_agg(col_name, ', ' ORDER BY col) || ']' AS header_name
                  FROM (SELECT DISTINCT file_id, col, col_name FROM ({ORIG_SELECT})) GROUP BY file_id)
        SELECT file_id AS matrix_name, file_id || '.csv' AS file_name, split_part(file_id, '-', 1) AS source_file,
               x, y, integer, float, object, true AS extradata, true AS header, false AS multiheader,
               replace(header_name, ';', ',') AS header_name, 'text/plain' AS extension, false AS zipfile
        FROM prof JOIN names USING (file_id)""",
    "stage_counts": f"""WITH {FILES}
        SELECT count_if(h.file_id IS NOT NULL) AS n_cleaned, count(*) AS n_logged,
               count_if(h.file_id IS NOT NULL AND coalesce(e.extradata, '') <> '') AS n_extradata,
               count_if(h.file_id IS NULL) AS n_failed
        FROM files f LEFT JOIN hdr h USING (file_id) LEFT JOIN extra e USING (file_id)""",
}
