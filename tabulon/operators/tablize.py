"""Tablizing of delimited text (T5–T17, C22) restated over a table of lines.

Input is one row per file ``(file_id, text)``; ``lines(files)`` explodes it
into ``(file_id, line_no, line)``.  Every step is a grouped aggregate, a
window partitioned by file, or a join on ``file_id``.  A file arrives as a
single record (at most a 2 GB value), so per-file windows are bounded by
the record size, whatever the number of files.

Output tables are long: cells ``(file_id, row, col, col_name, value)``,
one log row per table and one quarantine row per file that gave no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import group_row_number, group_running, md5_rank, ranged_rows

# ---------------------------------------------------------------------------
# Cleaning parameters of the reference configuration.
THRESHOLD_N_ROW = 100     # files with at least this many lines are sampled
RATIO_SAMPLE = 20         # percent of lines sampled
MAX_SAMPLE = 1000         # at most this many sampled lines
THRESHOLD_N_COL = 0.8     # share of lines with the same width (0.6 for small files)
SMALL_FILE_N_COL = 0.60
CHECK_HEADER = 10         # header candidates examined
THRESHOLD_JSON = 0.004    # share of JSON structure characters
JSON_CHARS = "{}[]:"
# Strings read as missing values by the table reader (pandas defaults, 2017).
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
# Delimiter candidates, in order of preference on ties.
DELIMITERS = [",", "\t", ";", " ", ":", "|"]
# Consistency a delimiter must reach (share of lines with its modal count).
DELIMITER_CONSISTENCY = 0.9
# End of fixed values.
# ---------------------------------------------------------------------------

#: Share of all lines that must have a table's width, whatever the file's size.
WIDTH_SHARE = SMALL_FILE_N_COL

INT_RE = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT_RE = (r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][+-]?\d+)?|\d+(_\d+)*\.([eE][+-]?\d+)?"
            r"|[nN][aA][nN]|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$")


def is_int(c: Column) -> Column:
    return c.rlike(INT_RE)


def is_float(c: Column) -> Column:
    return c.rlike(FLOAT_RE)


#: A whole quoted field: quotes around it, doubled ones inside.
QUOTED_RE = r'"[^"]*+(?:""[^"]*+)*+"'
#: A quoted field without its end.
OPEN_RE = r'"[^"]*+(?:""[^"]*+)*+\z'


def _quoted_fields(line: Column, delim: Column) -> Column:
    """Fields of a line that holds quotes, as written: a field is quoted when
    it opens with a quote and the closing one stands before a delimiter or the
    end of the line; other quotes are plain characters."""
    d = F.concat(F.lit("\\Q"), delim, F.lit("\\E"))
    field = F.concat(d, F.lit(f"({QUOTED_RE}(?="), d, F.lit("|\\z)|[^"), d, F.lit("]*+)"))
    return F.regexp_extract_all(F.concat(delim, line), field, 1)


def _unquote(field: Column) -> Column:
    inner = F.substr(field, F.lit(2), F.length(field) - 2)
    return F.when(field.rlike(f"\\A{QUOTED_RE}\\z"), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _n_delimiters(line: Column, delim: Column) -> Column:
    """Delimiters of a line outside its quoted fields."""
    plain = F.length(line) - F.length(F.replace(line, delim, F.lit("")))
    return F.when(F.contains(line, F.lit('"')), F.size(_quoted_fields(line, delim)) - 1).otherwise(plain)


def _cells(line: Column, delim: Column) -> Column:
    """Fields of a line split on a literal (per-row) delimiter, quotes of
    quoted fields removed."""
    plain = F.split(line, F.concat(F.lit("\\Q"), delim, F.lit("\\E")), -1)
    return F.when(F.contains(line, F.lit('"')),
                  F.transform(_quoted_fields(line, delim), _unquote)).otherwise(plain)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ---------------------------------------------------------------------------
# JSON structure share, line count
# ---------------------------------------------------------------------------

def json_char_ratio(text: Column) -> Column:
    """T5: share of ``{ } [ ] :`` among all characters (NULL for empty)."""
    n = F.length(text)
    m = F.length(F.regexp_replace(text, r"[^{}\[\]:]", ""))
    return F.when(n > 0, m / n)


def looks_like_json(text: Column, threshold: float = THRESHOLD_JSON) -> Column:
    return json_char_ratio(text) > threshold


def count_lines(text: Column) -> Column:
    """Lines as a line reader counts them; an empty file counts 1."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(F.split(t, "\n", -1)) - F.when(t.endswith("\n"), 1).otherwise(0)
    return F.greatest(n, F.lit(1)).cast("long")


def lines(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(file_id, line_no, line): one row per line, trailing ``\\r`` removed,
    the empty piece after a final newline dropped."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(t, "\n", -1)
    parts = F.when(t.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    ex = files.select(F.col(id_col).alias("file_id"), F.posexplode(parts).alias("line_no", "line"))
    return ex.select("file_id", F.col("line_no").cast("long").alias("line_no"),
                     F.regexp_replace("line", "\r$", "").alias("line"))


# ---------------------------------------------------------------------------
# T7–T10
# ---------------------------------------------------------------------------

def sample_lines(lns: DataFrame, seed: int = 0, threshold_n_row: int = THRESHOLD_N_ROW,
                 ratio: int = RATIO_SAMPLE, max_sample: int = MAX_SAMPLE,
                 threshold_n_col: float = THRESHOLD_N_COL):
    """Files of at least ``threshold_n_row`` lines keep
    min(round(n * ratio / 100), max_sample) lines, the first ones in
    ``md5(seed|file|line)`` order (file order kept); smaller files keep all
    lines and get the width threshold 0.60.

    Returns (sampled lines, per-file (file_id, n_lines, threshold))."""
    per = lns.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))
    size = F.least(F.round(F.col("n_lines") * ratio / 100.0).cast("long"), F.lit(max_sample))
    per = per.select("file_id", "n_lines",
                     F.when(F.col("n_lines") >= threshold_n_row, size).otherwise(F.col("n_lines"))
                     .alias("_size"),
                     F.when(F.col("n_lines") >= threshold_n_row, F.lit(threshold_n_col))
                     .otherwise(F.lit(SMALL_FILE_N_COL)).alias("threshold"))
    h = md5_rank(F.lit(seed), F.col("file_id"), F.col("line_no"))
    ranks = group_row_number(lns.select("file_id", "line_no", h.alias("_h")), ["file_id"],
                             [F.col("_h"), F.col("line_no")], "_r")
    chosen = ranks.join(per.select("file_id", "_size"), "file_id").filter(F.col("_r") <= F.col("_size"))
    s = lns.join(chosen.select("file_id", "line_no"), ["file_id", "line_no"], "left_semi")
    return s, per.select("file_id", "n_lines", "threshold")


def sniff_delimiter(lns: DataFrame, candidates: list[str] | None = None,
                    consistency: float = DELIMITER_CONSISTENCY) -> DataFrame:
    """Delimiter of each file from all its lines: for every candidate
    the modal per-line count (> 0; quoted fields hold none) and its adjusted
    share (lines at the mode - other lines) / lines; the best share reaching
    ``consistency`` wins, ties by candidate order.  Files without such a
    candidate get no row (no table).  ``mode`` is the winner's count and
    ``agree`` the plain share of lines that have it."""
    names = candidates or DELIMITERS
    counts = F.array(*[_n_delimiters(F.col("line"), F.lit(d)) for d in names])
    # lines alike in all counts are one row before the candidates part
    alike = lns.select("file_id", counts.alias("_counts")).groupBy("file_id", "_counts").agg(F.count(F.lit(1)).alias("_n"))
    x = alike.select("file_id", "_n", F.posexplode("_counts").alias("pref", "cnt")).select(
        "file_id", "pref", F.element_at(F.array(*[F.lit(d) for d in names]), F.col("pref") + 1).alias("delim"),
        "cnt", "_n")
    return _best_delimiter(x, consistency)


def _with_candidates(lns: DataFrame, candidates: list[str] | None) -> DataFrame:
    cand = F.array(*[F.struct(F.lit(i).alias("pref"), F.lit(d).alias("delim"))
                     for i, d in enumerate(candidates or DELIMITERS)])
    return lns.select("*", F.explode(cand).alias("_c")).select("*", "_c.pref", "_c.delim").drop("_c")


def _best_delimiter(counts: DataFrame, consistency: float) -> DataFrame:
    freq = counts.groupBy("file_id", "pref", "delim", "cnt").agg(F.sum("_n").alias("f"))
    mode = freq.groupBy("file_id", "pref", "delim").agg(
        F.max(F.struct("f", "cnt")).alias("m"), F.sum("f").alias("n"))
    mode = mode.select("file_id", "pref", "delim", F.col("m.cnt").alias("mode"),
                       (F.col("m.f") / F.col("n")).alias("agree"),
                       ((2 * F.col("m.f") - F.col("n")) / F.col("n")).alias("share"))
    ok = mode.filter((F.col("mode") > 0) & (F.col("share") >= consistency))
    best = ok.groupBy("file_id").agg(F.max(F.struct(
        "share", (-F.col("pref")).alias("neg"), "delim", "mode", "agree")).alias("b"))
    return best.select("file_id", F.col("b.delim").alias("delimiter"), F.col("b.share").alias("share"),
                       F.col("b.mode").alias("mode"), F.col("b.agree").alias("agree"))


# ---------------------------------------------------------------------------
# Quoted fields over several lines
# ---------------------------------------------------------------------------

def _ends_open(line: Column, delim: Column) -> Column:
    """Whether a line read from outside ends within a quoted field: its last
    field opens with a quote and only doubled quotes follow."""
    d = F.concat(F.lit("\\Q"), delim, F.lit("\\E"))
    field = F.concat(d, F.lit(f"({QUOTED_RE}(?="), d, F.lit(f"|\\z)|{OPEN_RE}|[^"), d, F.lit("]*+)"))
    last = F.element_at(F.regexp_extract_all(F.concat(delim, line), field, 1), -1)
    return F.contains(line, F.lit('"')) & F.regexp_like(last, F.lit(f"\\A{OPEN_RE}"))


def _from_inside(line: Column, delim: Column) -> tuple[Column, Column]:
    """(how, state after) of a line read from inside a quoted field: ``stay``
    without a closing quote, ``close`` when the first single quote stands
    before a delimiter or the end, else ``bad``: the field was no quoted one,
    and the line is read from outside."""
    at = F.instr(F.replace(line, F.lit('""'), F.lit("..")), '"')
    rest = F.substr(line, at + 1)
    how = (F.when(at == 0, F.lit("stay"))
           .when((rest == "") | F.startswith(rest, delim), F.lit("close")).otherwise(F.lit("bad")))
    after = (F.when(how == "stay", F.lit(True))
             .when(how == "close", F.when(rest == "", F.lit(False))
                   .otherwise(_ends_open(F.substr(rest, F.length(delim) + 1), delim)))
             .otherwise(_ends_open(line, delim)))
    return how, after


def fold_quoted(lns: DataFrame, keys: list[str], n_partitions: int | None = None) -> DataFrame:
    """Lines (keys, line_no, line, delim) to records: lines that a quoted field
    spans become one, joined by line breaks, under the number of the first.

    Each line is a function from the quote state before it to the one after
    it: constant, identity or flip.  The state before a line is the value of
    the last constant one, flipped as often as lines since then flip; so
    running maxima and sums over range-partitioned lines give it, and one
    file can be many tasks.  A field whose closing quote never comes, or
    stands before anything but a delimiter or the end of its line, is no
    quoted field, and its lines stay apart."""
    from ..session import cut_lineage

    how, after = _from_inside(F.col("line"), F.col("delim"))
    x = lns.select(*keys, "line_no", "line", "delim", _ends_open(F.col("line"), F.col("delim")).alias("_out"),
                   how.alias("_how"), after.alias("_in"))
    x = ranged_rows(x, [*[F.col(k) for k in keys], F.col("line_no")], n_partitions)
    no = F.col("line_no")
    flip = F.when(F.col("_out") & ~F.col("_in"), 1).otherwise(0)
    x = cut_lineage(group_running(x, keys, no, F.sum, flip, "_flips"))
    fixed = F.when(F.col("_out") == F.col("_in"),
                   F.struct(no.alias("no"), F.col("_out").alias("value"), F.col("_flips").alias("flips")))
    # both before the line: what it does itself is taken off again
    x = cut_lineage(group_running(x, keys, no, F.max, fixed, "_last", before=True)
                    .withColumn("_inside", (F.coalesce(F.col("_last.value").cast("int"), F.lit(0))
                                            + F.col("_flips") - flip - F.coalesce("_last.flips", F.lit(0))) % 2 != 0))
    end = F.when(F.col("_inside") & (F.col("_how") != "stay"),
                 F.struct(no.alias("no"), (F.col("_how") == "close").alias("closed")))
    x = cut_lineage(group_running(x, keys, no, F.min, end, "_end", backwards=True)
                    .withColumn("_glued", F.col("_inside") & F.coalesce("_end.closed", F.lit(False))))
    x = group_running(x, keys, no, F.max, F.when(~F.col("_glued"), no), "_start")
    x = cut_lineage(x.select(*keys, "delim", "line_no", "line", "_glued", "_start"))
    multi = x.filter("_glued").select(*keys, "_start").distinct()
    on = [*keys, "_start"]
    alone = x.join(multi, on, "left_anti").select(*keys, "delim", "line_no", "line")
    folded = x.join(multi, on, "left_semi").groupBy(*keys, "delim", F.col("_start").alias("line_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), "line"))),
                                 lambda s: s["line"]), "\n").alias("line"))
    return alone.unionByName(folded)


def sniff_records(lns: DataFrame, candidates: list[str] | None = None,
                  consistency: float = DELIMITER_CONSISTENCY) -> tuple[DataFrame, DataFrame]:
    """T8 where quoted fields may run over lines: (records, delimiters), the
    records as (file_id, line_no, line).  Files with a line that ends within a
    quoted field are read both ways for every candidate, line by line and
    folded; the better share wins, folded on ties.  All others are read line
    by line."""
    from ..session import cut_lineage

    plain = cut_lineage(sniff_delimiter(lns, candidates, consistency))
    quoted = _with_candidates(lns.filter(F.contains("line", F.lit('"'))), candidates)
    opened = cut_lineage(quoted.filter(_ends_open(F.col("line"), F.col("delim")))
                         .select("file_id", "pref", "delim").distinct())
    if opened.limit(1).count() == 0:
        return lns, plain
    read = lns.join(opened, "file_id").select("file_id", "pref", "line_no", "line", "delim")
    records = cut_lineage(fold_quoted(read, ["file_id", "pref"]))
    counts = records.select("file_id", "pref", "delim", _n_delimiters(F.col("line"), F.col("delim")).alias("cnt"),
                            F.lit(1).alias("_n"))
    folded = _best_delimiter(counts, consistency)
    both = folded.select("*", F.lit(1).alias("fold")).unionByName(plain.select("*", F.lit(0).alias("fold")))
    rest = [c for c in folded.columns if c not in ("file_id", "share")]
    best = cut_lineage(both.groupBy("file_id").agg(F.max(F.struct("share", "fold", *rest)).alias("b"))
                       .select("file_id", "b.*"))
    won = best.filter("fold = 1").select("file_id", F.col("delimiter").alias("delim"))
    out = (lns.join(won.select("file_id"), "file_id", "left_anti").select("file_id", "line_no", "line")
           .unionByName(records.join(won, ["file_id", "delim"], "left_semi").select("file_id", "line_no", "line")))
    return out, best.select(*folded.columns)


def infer_width(lns: DataFrame, delims: DataFrame, threshold: float = WIDTH_SHARE) -> DataFrame:
    """n_col = count + 1 for the delimiter count shared by strictly more
    than ``threshold`` of a file's lines (unique: threshold > 0.5)."""
    x = lns.join(delims.select("file_id", "delimiter"), "file_id").select(
        "file_id", _n_delimiters(F.col("line"), F.col("delimiter")).alias("cnt"))
    freq = x.groupBy("file_id", "cnt").agg(F.count(F.lit(1)).alias("f"))
    top = freq.groupBy("file_id").agg(F.max(F.struct("f", "cnt")).alias("m"), F.sum("f").alias("n"))
    return top.filter(F.col("m.f") / F.col("n") > threshold).select(
        "file_id", (F.col("m.cnt") + 1).alias("n_col"))


def split_content_extradata(lns: DataFrame, shape: DataFrame):
    """Lines with exactly n_col fields are content (numbered ``gidx``
    from 0 among content lines); the other lines, joined with spaces in file
    order, are the file's extradata.  Returns (content, extradata)."""
    j = lns.join(shape.select("file_id", "delimiter", "n_col"), "file_id")
    nf = _n_delimiters(F.col("line"), F.col("delimiter")) + 1
    j = j.withColumn("_good", nf == F.col("n_col"))
    content = (group_row_number(j.filter("_good"), ["file_id"], [F.col("line_no")], "_rn")
               .select("file_id", (F.col("_rn") - 1).alias("gidx"), "line_no", "line", "delimiter", "n_col"))
    bad = j.filter(~F.col("_good")).groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                 lambda s: s["line"]), " ").alias("extradata"))
    extradata = shape.select("file_id").join(bad, "file_id", "left").select(
        "file_id", F.coalesce("extradata", F.lit("")).alias("extradata"))
    return content, extradata


def header_vote(content: DataFrame, check_header: int = CHECK_HEADER) -> DataFrame:
    """Score of each candidate header row r < min(check_header,
    n_content // 2): over the next nine rows each column is typed
    int / float / string length; a column whose type changes is dropped;
    +1 per kept column whose header cell does not fit the type, -1/n_col
    when it fits or is one character long; -1 when the header row has
    another width or no column is kept."""
    n_good = content.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_good"))
    cand = (content.join(n_good, "file_id")
            .filter(F.col("gidx") < F.least(F.lit(check_header), F.floor(F.col("n_good") / 2)))
            .select("file_id", F.col("gidx").alias("r"),
                    _cells(_strip(F.col("line")), F.col("delimiter")).alias("hcells"), "n_col"))
    # no candidate looks further than nine rows ahead
    follow = content.filter(F.col("gidx") < check_header + 9).select(
        "file_id", F.col("gidx").alias("g"), _cells(_strip(F.col("line")), F.col("delimiter")).alias("cells"))
    j = cand.join(follow, "file_id").filter((F.col("g") > F.col("r")) & (F.col("g") <= F.col("r") + 9))
    ex = j.select("file_id", "r", "n_col", "hcells",
                  F.explode(F.sequence(F.lit(0), F.col("n_col") - 1)).alias("col"), "cells")
    cell = F.coalesce(F.try_element_at("cells", F.col("col") + 1), F.lit(""))
    typ = (F.when(is_int(cell), F.lit("int")).when(is_float(cell), F.lit("float"))
           .otherwise(F.concat(F.lit("len:"), F.length(cell).cast("string"))))
    per_col = ex.withColumn("typ", typ).groupBy("file_id", "r", "col").agg(
        F.count_distinct("typ").alias("n_types"), F.min("typ").alias("typ"),
        F.first("hcells").alias("hcells"), F.first("n_col").alias("n_col"))
    kept = per_col.filter(F.col("n_types") == 1)
    h = F.try_element_at("hcells", F.col("col") + 1)
    fits = (F.when(F.col("typ") == "int", is_int(h)).when(F.col("typ") == "float", is_float(h))
            .otherwise(F.length(h) == F.regexp_extract("typ", r"^len:(\d+)$", 1).cast("int")))
    vote = F.when(F.length(h) == 1, -1.0 / F.col("n_col")) \
        .when(fits, -1.0 / F.col("n_col")).otherwise(F.lit(1.0))
    votes = kept.groupBy("file_id", "r").agg(F.sum(vote).alias("score"))
    base = cand.select("file_id", "r", (F.size("hcells") != F.col("n_col")).alias("bad_width"))
    out = base.join(votes, ["file_id", "r"], "left")
    score = F.when(F.col("bad_width") | F.col("score").isNull(), F.lit(-1.0)).otherwise(F.col("score"))
    return out.select("file_id", "r", score.alias("score"))


def search_header(votes: DataFrame) -> DataFrame:
    """First candidate with score > 0 is the header row; else the
    first with score > -1 starts a headerless table; else no table (no row)."""
    agg = votes.groupBy("file_id").agg(
        F.min(F.when(F.col("score") > 0, F.col("r"))).alias("h_pos"),
        F.min(F.when(F.col("score") > -1, F.col("r"))).alias("h_any"))
    return agg.select("file_id",
                      F.coalesce("h_pos", "h_any").alias("header_row"),
                      F.col("h_pos").isNull().alias("no_header")) \
        .filter(F.col("header_row").isNotNull())


def build_table(content: DataFrame, headers: DataFrame) -> DataFrame:
    """Long cells (file_id, row, col, col_name, value).  Header at row h:
    names from rows 0..h (joined with ``|`` when h > 0), data after it;
    headerless: positional names and every content row.  Missing-value
    strings become NULL."""
    j = content.join(headers, "file_id")
    cells = j.select("file_id", "gidx", "header_row", "no_header",
                     F.posexplode(_cells(F.col("line"), F.col("delimiter"))).alias("col", "value"))
    head = cells.filter(~F.col("no_header") & (F.col("gidx") <= F.col("header_row"))) \
        .groupBy("file_id", "col").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gidx", "value"))),
                                     lambda s: s["value"]), "|").alias("col_name"))
    data = cells.filter(F.col("no_header") | (F.col("gidx") > F.col("header_row")))
    data = data.withColumn("row", F.when(F.col("no_header"), F.col("gidx"))
                           .otherwise(F.col("gidx") - F.col("header_row") - 1))
    out = data.join(head, ["file_id", "col"], "left")
    name = F.coalesce(F.col("col_name"), F.col("col").cast("string"))
    value = F.when(F.col("value").isin(*NA_VALUES), F.lit(None)).otherwise(F.col("value"))
    return out.select("file_id", "row", F.col("col").cast("long").alias("col"), name.alias("col_name"),
                      value.alias("value"))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Remove the columns whose every value is missing."""
    keep = cells.groupBy("file_id", "col").agg(F.count("value").alias("_n")).filter("_n > 0")
    return cells.join(keep.select("file_id", "col"), ["file_id", "col"], "left_semi")


def table_shape_profile(cells: DataFrame) -> DataFrame:
    """Per table, rows, columns and the number of integer / float /
    object columns (integer: every value an integer and none missing; float:
    every present value numeric; object otherwise)."""
    per_col = cells.groupBy("file_id", "col").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"),
        F.count_if(is_int(F.col("value"))).alias("n_int"),
        F.count_if(is_int(F.col("value")) | is_float(F.col("value"))).alias("n_num"))
    kind = (F.when((F.col("n_int") == F.col("n")), F.lit("integer"))
            .when(F.col("n_num") == F.col("n_present"), F.lit("float")).otherwise(F.lit("object")))
    typed = per_col.withColumn("kind", kind)
    rows = cells.groupBy("file_id").agg(F.count_distinct("row").alias("x"))
    prof = typed.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("y"),
        F.count_if(F.col("kind") == "integer").alias("integer"),
        F.count_if(F.col("kind") == "float").alias("float"),
        F.count_if(F.col("kind") == "object").alias("object"))
    return rows.join(prof, "file_id").select("file_id", F.col("x").cast("long"), "y", "integer",
                                             "float", "object")


def cleaning_log_record(profile: DataFrame, headers: DataFrame, extradata: DataFrame,
                        names: DataFrame, meta: DataFrame) -> DataFrame:
    """One 14-field log row per table.  ``meta`` gives (file_id,
    file_name, source_file, extension, zipfile); spaces become ``_`` in
    names and ``;`` becomes ``,`` in values."""
    j = (profile.join(headers, "file_id").join(extradata, "file_id", "left")
         .join(names, "file_id", "left").join(meta, "file_id", "left"))

    def clean(c):
        return F.replace(c.cast("string"), F.lit(";"), F.lit(","))

    return j.select(
        clean(F.replace(F.col("file_id").cast("string"), F.lit(" "), F.lit("_"))).alias("matrix_name"),
        clean(F.replace(F.col("file_name"), F.lit(" "), F.lit("_"))).alias("file_name"),
        clean(F.col("source_file")).alias("source_file"),
        "x", "y", "integer", "float", "object",
        (F.coalesce(F.col("extradata"), F.lit("")) != "").alias("extradata"),
        (~F.col("no_header")).alias("header"),
        ((~F.col("no_header")) & (F.col("header_row") > 0)).alias("multiheader"),
        clean(F.col("header_name")).alias("header_name"),
        clean(F.col("extension")).alias("extension"),
        F.col("zipfile").cast("boolean").alias("zipfile"))


def tablize_delimited(files: DataFrame, id_col: str = "file_id",
                      text_col: str = "text") -> dict[str, DataFrame]:
    """T8 → T13, T15, T16 end to end over a corpus of text files; all
    lines of a file decide its delimiter and, by the same counts, its width.
    A quoted field may run over lines; they become one line of the table.

    Returns ``cells`` (file_id, row, col, col_name, value), ``profile``,
    ``headers``, ``extradata`` and ``errors`` (file_id, error_type) for the
    files that gave no table."""
    from ..session import cut_lineage

    lns = lines(files, id_col, text_col)
    # stage boundaries: each of these feeds several branches below
    lns, delims = sniff_records(lns)
    shape = delims.filter(F.col("agree") > WIDTH_SHARE).select(
        "file_id", "delimiter", "share", (F.col("mode") + 1).alias("n_col"))
    content, extradata = split_content_extradata(lns, shape)
    content = cut_lineage(content)
    extradata = cut_lineage(extradata)
    headers = cut_lineage(search_header(header_vote(content)))
    cells = cut_lineage(drop_empty_columns(build_table(content, headers)))
    profile = cut_lineage(table_shape_profile(cells).filter((F.col("x") * F.col("y")) > 0))
    cells = cells.join(profile.select("file_id"), "file_id", "left_semi")
    all_files = files.select(F.col(id_col).alias("file_id"))
    errors = (all_files.join(delims.select("file_id", F.lit(1).alias("_d")), "file_id", "left")
              .join(shape.select("file_id", F.lit(1).alias("_s")), "file_id", "left")
              .join(headers.select("file_id", F.lit(1).alias("_h")), "file_id", "left")
              .join(profile.select("file_id", F.lit(1).alias("_p")), "file_id", "left")
              .filter(F.col("_p").isNull())
              .select("file_id", F.when(F.col("_d").isNull(), F.lit("no_delimiter"))
                      .when(F.col("_s").isNull(), F.lit("no_width"))
                      .when(F.col("_h").isNull(), F.lit("no_header"))
                      .otherwise(F.lit("empty_table")).alias("error_type")))
    return {"cells": cells, "profile": profile, "headers": headers, "extradata": extradata,
            "errors": errors, "shape": shape, "content": content}


def header_names(cells: DataFrame) -> DataFrame:
    """The header as one string (``[name, ...]``) per table, for the log."""
    per = cells.select("file_id", "col", "col_name").distinct()
    return per.groupBy("file_id").agg(F.concat(F.lit("["), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col", "col_name"))), lambda s: s["col_name"]), ", "),
        F.lit("]")).alias("header_name"))


def stage_counts(files: DataFrame, result: dict[str, DataFrame], id_col: str = "file_id") -> DataFrame:
    """Files cleaned, logged (cleaned + failed), with extradata, and
    failed, in one pass over a per-file status."""
    st = (files.select(F.col(id_col).alias("file_id"))
          .join(result["profile"].select("file_id", F.lit("cleaned").alias("status")), "file_id", "left")
          .join(result["extradata"], "file_id", "left")
          .select("file_id", F.coalesce("status", F.lit("failed")).alias("status"),
                  ((F.coalesce("extradata", F.lit("")) != "") & F.col("status").isNotNull())
                  .alias("extradata")))
    return st.agg(
        F.count_if(F.col("status") == "cleaned").alias("n_cleaned"),
        F.count(F.lit(1)).alias("n_logged"),
        F.count_if(F.col("extradata")).alias("n_extradata"),
        F.count_if(F.col("status") == "failed").alias("n_failed"))
