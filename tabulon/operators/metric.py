"""Scores and evaluation (P10–P13, P17–P21): pair scores from difference
vectors, average precision and precision/recall curves in window form,
label-shuffle baseline, radius choice and the result-table summaries.

Curves are computed on one row per distinct score (partial aggregation
first); the running sums over the global score order use range
partitioning plus per-partition offsets, never a single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import (global_index, global_prefix_sums, group_prefix_sums, group_quantiles,
                               join_null_safe, md5_rank)
from ..functions.vectors import norm_inf, norm_l1, norm_l2


def pair_score(x: Column, norm: str = "l2") -> Column:
    """P10: ``-norm(x)`` of a difference vector; ``l1``, ``l2`` or ``inf``
    (any other value falls back to ``l2``)."""
    if norm == "l1":
        return -norm_l1(x)
    if norm == "inf":
        return -norm_inf(x)
    return -norm_l2(x)


def _score_table(scored: DataFrame, label_col: str, score_col: str,
                 group_cols: list[str]) -> DataFrame:
    y = F.col(label_col).cast("long")
    return scored.groupBy(*group_cols, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def pr_points(scored: DataFrame, label_col: str = "y", score_col: str = "score",
              group_cols: list[str] | None = None) -> DataFrame:
    """One row per distinct score (descending thresholds) with tp, fp,
    precision, recall; points after the first one reaching full recall are
    dropped (they only add negatives)."""
    group_cols = group_cols or []
    agg = _score_table(scored, label_col, score_col, group_cols)
    if group_cols:
        cum = group_prefix_sums(agg, group_cols, [F.desc("score")], ["pos", "neg"])
        tot = agg.groupBy(*group_cols).agg(F.sum("pos").alias("n_pos"))
        cum = join_null_safe(cum, tot, group_cols)
    else:
        cum = global_prefix_sums(agg, [F.desc("score")], ["pos", "neg"])
        n_pos = agg.agg(F.sum("pos").alias("n_pos"))
        # one-row total attached through a constant key (bounded broadcast)
        cum = (cum.withColumn("_k", F.lit(1))
               .join(F.broadcast(n_pos.withColumn("_k", F.lit(1))), "_k").drop("_k"))
    return (cum.filter(F.col("cum_pos") - F.col("pos") < F.col("n_pos"))
            .select(*group_cols, "score", "pos", "neg",
                    F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    (F.col("cum_pos") / F.col("n_pos")).alias("recall")))


def average_precision(scored: DataFrame, label_col: str = "y", score_col: str = "score",
                      group_cols: list[str] | None = None) -> DataFrame:
    """AP = sum over thresholds of (R_n - R_{n-1}) * P_n, tied scores
    forming one threshold (not the trapezoid area)."""
    return points_precision(pr_points(scored, label_col, score_col, group_cols), group_cols)


def points_precision(pts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """P11 of the points of :func:`pr_points`."""
    return pts.groupBy(*(group_cols or [])).agg(
        (F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("ap"))


def precision_recall_curve(scored: DataFrame, label_col: str = "y", score_col: str = "score",
                           group_cols: list[str] | None = None) -> DataFrame:
    """(precision, recall, threshold) per distinct score plus the
    closing point (1, 0) without threshold."""
    return points_curve(pr_points(scored, label_col, score_col, group_cols), group_cols)


def points_curve(pts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """P12 of the points of :func:`pr_points`."""
    group_cols = group_cols or []
    pts = pts.select(*group_cols, "precision", "recall", F.col("score").alias("threshold"))
    if group_cols:
        closing = pts.select(*group_cols).distinct()
    else:
        closing = pts.sparkSession.range(1).select()
    closing = closing.select(*group_cols, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                             F.lit(None).cast(pts.schema["threshold"].dataType).alias("threshold"))
    return pts.unionByName(closing)


def shuffle_labels(scored: DataFrame, id_col: str, label_col: str = "y",
                   seed: int = 0) -> DataFrame:
    """P13 helper: permute the labels among rows (position by id receives the
    label of the same position by ``md5(seed|id)``), distributed."""
    by_id = global_index(scored.select(id_col, "score"), id_col, "_pos")
    keyed = scored.select(id_col, label_col, md5_rank(F.lit(seed), F.col(id_col)).alias("_h"))
    by_hash = global_index(keyed, ["_h", id_col], "_pos").select("_pos", F.col(label_col).alias("_y"))
    return by_id.join(by_hash, "_pos").select(id_col, "score", F.col("_y").alias(label_col))


def label_shuffle_baseline(scored: DataFrame, id_col: str, label_col: str = "y",
                           seed: int = 0) -> DataFrame:
    """AP with permuted labels (close to the positive share)."""
    return average_precision(shuffle_labels(scored, id_col, label_col, seed), label_col)


def find_radius(curve: DataFrame, min_precision: float = 0.5) -> DataFrame:
    """Among curve points with precision > min_precision (closing point
    excluded), the largest recall, first in increasing-threshold order on
    ties; radius = -threshold."""
    pts = curve.filter(F.col("threshold").isNotNull() & (F.col("precision") > min_precision))
    best = pts.agg(F.max(F.struct("recall", (-F.col("threshold")).alias("neg_t"),
                                  "precision")).alias("b"))
    return best.select(F.col("b.neg_t").alias("radius"), F.col("b.precision").alias("precision"),
                       F.col("b.recall").alias("recall"))


def _nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def summarize_auc(results: DataFrame, group_cols: list[str], auc_col: str = "auc") -> DataFrame:
    """Per setting, nan-mean, sample std (ddof 1), p5 and p95 of AUC."""
    a = _nan_to_null(F.col(auc_col))
    moments = results.groupBy(*group_cols).agg(
        F.avg(a).alias("mean_auc"), F.stddev_samp(a).alias("std_auc"), F.count(a).alias("n"))
    tails = group_quantiles(results, group_cols, a, {"p5_auc": 0.05, "p95_auc": 0.95})
    return join_null_safe(moments, tails, group_cols).select(
        *group_cols, "mean_auc", "std_auc", "p5_auc", "p95_auc", "n")


def auc_quartiles(results: DataFrame, by: str, auc_col: str = "auc") -> DataFrame:
    """Min, quartiles and max of AUC per model / topic count / norm."""
    return group_quantiles(results, [by], _nan_to_null(F.col(auc_col)),
                           {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})


def mean_auc_pivot(results: DataFrame, index_col: str, pivot_col: str, values: list,
                   auc_col: str = "auc") -> DataFrame:
    """Mean AUC by ``index_col`` with one column per ``pivot_col``
    value (values listed up front: no extra job to discover them)."""
    a = _nan_to_null(F.col(auc_col))
    return results.groupBy(index_col).pivot(pivot_col, values).agg(F.avg(a))
