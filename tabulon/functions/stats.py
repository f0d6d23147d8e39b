"""Small helpers shared by operators: scalar results of tiny aggregates and
deterministic hash-based ordering (identical in Spark SQL and DuckDB)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(df: DataFrame, expr: Column):
    """Value of a one-row global aggregate (bounded: one row to the driver)."""
    row = df.agg(expr.alias("v")).first()
    return None if row is None else row["v"]


def md5_rank(*parts: Column) -> Column:
    """Deterministic pseudo-random 60-bit integer from ``md5`` of the parts
    joined by ``|``.  DuckDB twin: ``('0x' || substr(md5(s), 1, 15))::BIGINT``."""
    s = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def md5_rank_sql(*parts: str) -> str:
    """DuckDB / ANSI text of :func:`md5_rank` (for oracle SQL)."""
    s = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({s}), 1, 15))::BIGINT"


def _ranged(df: DataFrame, order: list[Column], n_partitions: int | None):
    """Range-partitioned rows with their partition id, stored as a stage
    table: range bounds are sampled, so two computations of a
    non-deterministic input could disagree on the ids; every later branch
    (and any recomputation after an executor loss) reads the stored ids."""
    from ..session import cut_lineage

    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def _partition_offsets(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per range partition, the totals of all earlier partitions (one row
    per partition: bounded by the partition count)."""
    from pyspark.sql.window import Window

    totals = ranged.groupBy("_pid").agg(*[e.alias(k) for k, e in sums.items()])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_off_{k}")
                                   for k in sums])


def global_index(df: DataFrame, order_col: str | list[str], out_col: str = "index",
                 n_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``order_col`` (one column
    or several, unique together), computed without pulling rows into one
    task: range partitioning, a per-partition count (one row per partition),
    running offsets, and a per-partition row number.  The partition ids are
    stored with the rows (see ``_ranged``), so every branch agrees on them."""
    from pyspark.sql.window import Window

    order = [F.col(c) for c in ([order_col] if isinstance(order_col, str) else order_col)]
    ranged = _ranged(df, order, n_partitions)
    offs = _partition_offsets(ranged, {"n": F.count(F.lit(1))})
    w = Window.partitionBy("_pid").orderBy(*order)
    return (ranged.join(F.broadcast(offs), "_pid")
            .withColumn(out_col, (F.col("_off_n") + F.row_number().over(w) - 1).cast("long"))
            .drop("_pid", "_off_n"))


def global_prefix_sums(df: DataFrame, order: list[Column], cols: list[str],
                       n_partitions: int | None = None) -> DataFrame:
    """Running sums of ``cols`` over the whole table in ``order`` (rows
    unique in that order), as ``cum_<col>``: the two-level form of an
    unpartitioned running-sum window."""
    from pyspark.sql.window import Window

    ranged = _ranged(df, order, n_partitions)
    offs = _partition_offsets(ranged, {c: F.sum(c) for c in cols})
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offs), "_pid")
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(w))
    return out.drop("_pid", *[f"_off_{c}" for c in cols])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, lazily (a
    broadcast of one row through a constant key; no driver round trip)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cluster before CPU-heavy row-wise work when the
    input has fewer partitions than the default parallelism (e.g. a table
    stored as one row group).  Large inputs already arrive in many
    partitions and are returned unchanged (no extra shuffle)."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover - sessions without an RDD view
        return df
    return df.repartition(target) if n < target else df


def group_row_number(df: DataFrame, group_cols: list[str], order: list[Column],
                     out_col: str = "rn", n_partitions: int | None = None) -> DataFrame:
    """1-based row number within each group in ``order`` (rows unique in
    that order), without putting a whole group in one task: rows are range
    partitioned on (group, order) so a hot group spans several partitions;
    per (partition, group) counts give each piece its offset (a window over
    the partitions a group spans), and the final numbering is a window per
    (partition, group)."""
    from pyspark.sql.window import Window

    ranged = _ranged(df, [*[F.col(c) for c in group_cols], *order], n_partitions)
    counts = ranged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", *group_cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid", *group_cols).orderBy(*order)
    return (join_null_safe(ranged, offs, ["_pid", *group_cols])
            .withColumn(out_col, (F.col("_off") + F.row_number().over(w)).cast("long"))
            .drop("_pid", "_off"))


def join_null_safe(df: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on ``cols`` where NULL equals NULL (groups of a grouped
    aggregate joined back); the key columns of ``df`` stay."""
    renamed = other.select(*[F.col(c).alias(f"_eq_{c}") if c in cols else F.col(c) for c in other.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_eq_{c}")) for c in cols]
    return df.join(renamed, on).drop(*[f"_eq_{c}" for c in cols])


def group_prefix_sums(df: DataFrame, group_cols: list[str], order: list[Column], cols: list[str],
                      n_partitions: int | None = None) -> DataFrame:
    """Running sums of ``cols`` within each group in ``order`` (rows unique
    in that order), as ``cum_<col>``; a hot group spans several partitions,
    each piece starting from the totals of the pieces before it."""
    from pyspark.sql.window import Window

    ranged = _ranged(df, [*[F.col(c) for c in group_cols], *order], n_partitions)
    totals = ranged.groupBy("_pid", *group_cols).agg(*[F.sum(c).alias(f"_sum_{c}") for c in cols])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", *group_cols, *[
        F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols])
    w = (Window.partitionBy("_pid", *group_cols).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    out = join_null_safe(ranged, offs, ["_pid", *group_cols])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(w))
    return out.drop("_pid", *[f"_off_{c}" for c in cols])


def group_quantiles(df: DataFrame, group_cols: list[str], value: Column,
                    quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per name:
    running counts over the distinct values instead of a buffer with all
    values of a group.  NULL values do not count; a group without any value
    keeps its row, with NULLs."""
    from ..session import cut_lineage

    counted = cut_lineage(df.select(*group_cols, value.cast("double").alias("_v"))
                          .groupBy(*group_cols, "_v").agg(F.count("_v").alias("_n")))
    sizes = counted.groupBy(*group_cols).agg(F.sum("_n").alias("_all"))
    cum = join_null_safe(group_prefix_sums(counted, group_cols, [F.col("_v")], ["_n"]), sizes, group_cols)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("cum__n") - F.col("_n") <= position) & (position < F.col("cum__n")),
                            F.col("_v")))

    aggs, out = [], []
    for name, q in quantiles.items():
        p = (F.col("_all") - 1) * F.lit(float(q))
        aggs += [at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"),
                 F.max(p - F.floor(p)).alias(f"_part_{name}")]
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_part_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part).alias(name))
    return cum.groupBy(*group_cols).agg(*aggs).select(*group_cols, *out)


def ranged_rows(df: DataFrame, order: list[Column], n_partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned on ``order`` and stored with their partition id
    ``_pid``, for several calls of :func:`group_running`."""
    return _ranged(df, order, n_partitions)


def group_running(ranged: DataFrame, group_cols: list[str], order: Column, how, value: Column, out_col: str,
                  before: bool = False, backwards: bool = False) -> DataFrame:
    """Running ``how`` (``F.sum``, ``F.max`` or ``F.min``) of ``value`` within
    each group over rows of :func:`ranged_rows`, as ``out_col``; ``before``
    leaves the row itself out and ``backwards`` runs from the end.  A hot group
    spans several partitions: each piece takes in the totals of those passed."""
    from pyspark.sql.window import Window

    def ordered(c: Column) -> Column:
        return c.desc() if backwards else c.asc()

    df = ranged.withColumn("_v", value)
    pieces = df.groupBy("_pid", *group_cols).agg(how("_v").alias("_t"))
    passed = (Window.partitionBy(*group_cols).orderBy(ordered(F.col("_pid")))
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = pieces.select("_pid", *group_cols, how("_t").over(passed).alias("_off"))
    w = (Window.partitionBy("_pid", *group_cols).orderBy(ordered(order))
         .rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    out = join_null_safe(df, offs, ["_pid", *group_cols]).withColumn("_own", how("_v").over(w))
    own, off = F.col("_own"), F.col("_off")
    both = own + off if how is F.sum else F.when((own > off) == F.lit(how is F.max), own).otherwise(off)
    both = F.when(own.isNull() | off.isNull(), F.coalesce(own, off)).otherwise(both)
    return out.withColumn(out_col, both).drop("_v", "_off", "_own")
