"""Catalogue tables (C1–C23, T27): flattening of nested catalogue records,
bridge tables, download / cleaning status merges and their reports.

All operators are projections, explodes, equi joins and grouped
aggregates.  Duplicate-id repair uses a grouped minimum joined back instead
of a window so that a hot id never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_text

# ---------------------------------------------------------------------------
# MIME type -> short extension name (cleaning reports).
EXTENSION_NAMES = [
    ("text/plain", "csv"),
    ("application/CDFV2-unknown", "cdfv2"),
    ("application/octet-stream", "other"),
    ("application/vnd.ms-excel", "excel"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "excel"),
    ("text/xml", "xml"),
    ("application/zip", "zipfile"),
]
# End of fixed values.
# ---------------------------------------------------------------------------


def rename_extension(mime: Column) -> Column:
    """MIME type -> csv / cdfv2 / other / excel / xml / zipfile, other
    values unchanged."""
    expr = None
    for src, dst in EXTENSION_NAMES:
        expr = (F.when(mime == src, F.lit(dst)) if expr is None
                else expr.when(mime == src, F.lit(dst)))
    return expr.otherwise(mime)


def explode_resources(pages: DataFrame, resources_col: str = "resources",
                      page_cols: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per file (element of ``resources``), with the columns of
    its page repeated; pages without files yield no row."""
    page_cols = page_cols or [c for c in pages.columns if c != resources_col]
    ex = pages.select(*page_cols, F.explode(resources_col).alias("_r"))
    fields = ex.schema["_r"].dataType.fieldNames()
    return ex.select(*page_cols, *[F.col(f"_r.{f}").alias(prefix + f) for f in fields])


def organization_rows(orgs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One flat row per organisation, ``paths`` maps output name to a
    (possibly nested) column path; a missing sub-record gives NULL leaves."""
    return orgs.select(*[F.col(p).alias(name) for name, p in paths.items()])


def explode_reuse_pages(reuses: DataFrame, datasets_col: str = "datasets",
                        reuse_cols: list[str] | None = None, prefix: str = "page_") -> DataFrame:
    """One row per (reuse, page) from a reuse's list of pages."""
    return explode_resources(reuses, datasets_col, reuse_cols, prefix)


def sanitize_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """C4: ``;`` -> ``,``, ``"`` -> ``'``, line breaks dropped, on string columns."""
    return df.select(*[sanitize_text(F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def join_tags(tags: Column) -> Column:
    """Non-NULL tags joined with spaces, ``-`` -> ``_``."""
    return F.replace(F.array_join(F.filter(tags, lambda t: t.isNotNull()), " "),
                     F.lit("-"), F.lit("_"))


def first_descendant_text(xml: Column, name: str) -> Column:
    """Text of the first element called ``name`` at any depth, in
    document order (NULL when absent)."""
    v = F.xpath_string(xml, F.lit(f"//{name}"))
    exists = F.xpath_boolean(xml, F.lit(f"//{name}"))
    return F.when(exists, v)


def check_key_uniqueness(df: DataFrame, id_col: str, other_cols: list[str]) -> DataFrame:
    """One report row: rows, distinct ids, distinct values of each other
    column, and the number of surplus id occurrences."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(id_col).alias("n_ids")]
    aggs += [F.count_distinct(c).alias(f"n_distinct_{c}") for c in other_cols]
    out = df.agg(*aggs)
    return out.withColumn("n_duplicate_ids", F.col("n_rows") - F.col("n_ids"))


def repair_duplicate_ids(df: DataFrame, id_col: str, url_col: str, order_col: str) -> DataFrame:
    """The second and later occurrences of an id (in ``order_col``
    order) get ``sha2(url, 224)`` as id; ``repaired`` flags them.

    The first occurrence is found with a grouped ``min`` (partial
    aggregation) joined back, so a very frequent id is skew-split by AQE
    rather than buffered in one window task.
    """
    first = df.groupBy(F.col(id_col).alias("_id")).agg(F.min(order_col).alias("_first"))
    j = df.join(first, F.col(id_col).eqNullSafe(F.col("_id")))  # rows without an id stay
    repaired = F.col(order_col) != F.col("_first")
    return j.select(*[c for c in df.columns if c != id_col],
                    F.col(id_col).alias("original_id"),
                    F.when(repaired, F.sha2(F.col(url_col), 224)).otherwise(F.col(id_col)).alias(id_col),
                    repaired.alias("repaired"))


def distinct_reuses(bridge: DataFrame, reuse_cols: list[str]) -> DataFrame:
    """The reuse columns of the bridge, duplicates removed."""
    return bridge.select(*reuse_cols).distinct()


def project_page_reuse(bridge: DataFrame, cols: list[str]) -> DataFrame:
    """The bridge columns kept downstream."""
    return bridge.select(*cols)


def reuses_per_page(bridge: DataFrame, page_col: str, reuse_col: str) -> DataFrame:
    """C11: per page, its distinct reuse ids space-joined (ascending) and
    their count.  Distinct (page, reuse) pairs are reduced first."""
    pairs = bridge.select(page_col, reuse_col).distinct()
    return pairs.groupBy(page_col).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(reuse_col))), " ").alias("reuses"),
        F.count(F.lit(1)).alias("n_reuses"))


def attach_reuses(files: DataFrame, per_page: DataFrame, page_col: str) -> DataFrame:
    """Left join of the per-page reuses to the files; ``''`` and 0 for
    pages without reuse."""
    j = files.join(per_page, page_col, "left")
    return j.withColumn("reuses", F.coalesce("reuses", F.lit(""))) \
            .withColumn("n_reuses", F.coalesce("n_reuses", F.lit(0)).cast("long"))


def downloadable_files(files: DataFrame, dest_col: str = "url_destination",
                       cols: tuple[str, ...] = ("url", "id", "format")) -> DataFrame:
    """Files whose destination is ``'file'``, projected to (url, id, format)."""
    return files.filter(F.col(dest_col) == "file").select(*cols)


def merge_download_status(files: DataFrame, downloads: DataFrame, errors: DataFrame,
                          key: str = "id_file") -> DataFrame:
    """C14: files ⟕ download summary ⟕ error summary; ``downloaded`` NULL ->
    false."""
    j = files.join(downloads, key, "left").join(errors, key, "left")
    return j.withColumn("downloaded", F.coalesce(F.col("downloaded"), F.lit(False)))


def download_consistency(merged: DataFrame) -> DataFrame:
    """Rows both downloaded and in error; rows in neither set."""
    return merged.agg(
        F.count_if(F.col("downloaded") & F.col("error").isNotNull()).alias("n_downloaded_and_error"),
        F.count_if(~F.col("downloaded") & F.col("error").isNull()).alias("n_neither"))


def download_counts(merged: DataFrame, dest_col: str = "url_destination") -> DataFrame:
    """Files, remote, downloaded, empty, errors and
    ignored = files - remote - downloaded - errors, in one pass."""
    out = merged.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col(dest_col) != "file").alias("n_remote"),
        F.count_if(F.col("downloaded")).alias("n_downloaded"),
        F.count_if(F.col("size_file") == 0).alias("n_empty"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return out.withColumn("n_ignored", F.col("n_files") - F.col("n_remote")
                          - F.col("n_downloaded") - F.col("n_errors"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """C17: frequency of each value, most frequent first, ties by value."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")))


def error_breakdown(errors: DataFrame, format_col: str, error_col: str,
                    message_col: str) -> DataFrame:
    """Per declared format, its most frequent error (ties: smallest
    value) and the message counts of that error."""
    per_error = errors.groupBy(format_col, error_col).agg(F.count(F.lit(1)).alias("n_error"))
    top = per_error.groupBy(format_col).agg(
        F.min(F.struct((-F.col("n_error")).alias("neg"), F.col(error_col).alias("e")))
        .alias("_top"))
    top = top.select(format_col, F.col("_top.e").alias("top_error"),
                     (-F.col("_top.neg")).alias("n_top_error"))
    msgs = errors.join(top, (errors[format_col] == top[format_col])
                       & (errors[error_col] == top["top_error"]), "left_semi")
    counts = msgs.groupBy(format_col, F.col(message_col).alias("message")).agg(
        F.count(F.lit(1)).alias("n_message"))
    return top.join(counts, format_col)


def success_rate(attempts: DataFrame, group_col: str, failed: Column) -> DataFrame:
    """Per group, successes and ``round(100 * s / (s + f), 2)`` (0 when
    the group has no attempt)."""
    agg = attempts.groupBy(group_col).agg(F.count_if(~failed).alias("n_success"),
                                          F.count_if(failed).alias("n_fail"))
    total = F.col("n_success") + F.col("n_fail")
    return agg.select(group_col, "n_success",
                      F.when(total == 0, F.lit(0.0))
                      .otherwise(F.round(F.col("n_success") / total * 100, 2)).alias("rate"))


def merge_cleaning_log(log: DataFrame, summary: DataFrame, reduced_cols: list[str],
                       key_log: str = "source_file", key_summary: str = "id_file",
                       ext_col: str = "extension"):
    """C20: cleaning log ⟕ download summary on source_file = id_file, with
    extensions renamed; returns (full, reduced) projections."""
    j = log.join(summary, log[key_log] == summary[key_summary], "left")
    full = j.withColumn(ext_col, rename_extension(F.col(ext_col)))
    return full, full.select(*reduced_cols)


def merge_cleaning_errors(errors: DataFrame, summary: DataFrame, cols: list[str],
                          key_log: str = "source_file", key_summary: str = "id_file",
                          ext_col: str = "extension") -> DataFrame:
    """Error log ⟕ download summary, extension renamed, projected."""
    j = errors.join(summary, errors[key_log] == summary[key_summary], "left")
    return j.withColumn(ext_col, rename_extension(F.col(ext_col))).select(*cols)


def stage_counts(log: DataFrame, status_col: str = "status") -> DataFrame:
    """Totals of cleaned tables, logged tables, tables with extradata
    and failures, from a per-table status log (one pass)."""
    return log.agg(
        F.count_if(F.col(status_col) == "cleaned").alias("n_cleaned"),
        F.count_if(F.col(status_col).isin("cleaned", "failed")).alias("n_logged"),
        F.count_if(F.col("extradata")).alias("n_extradata"),
        F.count_if(F.col(status_col) == "failed").alias("n_failed"))


def size_by_extension(tables: DataFrame, ext_col: str, rows_col: str, cols_col: str) -> DataFrame:
    """Per extension, number of tables and the quartiles of their row and
    column counts (exact percentiles)."""
    from ..functions.stats import group_quantiles, join_null_safe

    t = tables.select(F.col(ext_col).alias("extension"), F.col(rows_col).alias("rows"),
                      F.col(cols_col).alias("cols"))
    out = t.groupBy("extension").agg(F.count(F.lit(1)).alias("n_tables"))
    for name in ("rows", "cols"):
        quartiles = {f"{name}_p{p}": p / 100 for p in (25, 50, 75)}
        out = join_null_safe(out, group_quantiles(t, ["extension"], F.col(name), quartiles), ["extension"])
    return out
