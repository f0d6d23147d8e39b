"""Registered queries for pairs, samples and evaluation (P1–P13,
P17–P21) and their DuckDB oracles.

Scores: ``labels.quality`` is the reused-together label and
``documents.n_chars`` the score.  Topic space: ``embeddings`` (file =
vec_id, page = label); reuses of a file: orders of ``lineitem`` lines with
``l_partkey = vec_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import md5_rank_sql
from ..functions.vectors import norm_l1, norm_l2
from ..operators import metric as M
from ..operators import pairs as P
from .fixtures import table, topic_space

R = 6
SEED = 0
FOLD = 1
RATIO = 0.5
BALANCE = 0.3
MAX_REUSE = 30000
LABEL_STOP = ["small", "large"]
# fixed L for the transform: identity plus 0.1 on the first upper diagonal
def fixed_L(k: int) -> list[list[float]]:
    return [[1.0 if i == j else (0.1 if j == i + 1 else 0.0) for j in range(k)] for i in range(k)]


def _scored(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"),
                                           F.col("n_chars").alias("score"))


def _space_pairs(spark, sf):
    """Co-reused pairs among topic-space files, page = embedding label."""
    space = topic_space(spark, sf)
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"),
                                             F.col("l_orderkey").alias("reuse"))
    edges = li.join(space.select("file"), "file", "left_semi")
    return space, P.co_reused_pairs(edges, space.select("file", F.col("page").cast("string").alias("page")))


def q_split_labels(spark, sf):
    p = table(spark, sf, "part")
    s = F.concat_ws(" ", F.col("p_name"), F.lower("p_type"), F.col("p_name"))
    return p.select("p_partkey", F.array_join(F.array_sort(P.split_labels(s, LABEL_STOP)), " ")
                    .alias("labels"))


def q_co_reused_pairs(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"),
                                             F.col("l_orderkey").alias("reuse"))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("file"),
                                            F.col("p_brand").alias("page"))
    return P.co_reused_pairs(li, pages)


def _test_pages(spark, sf):
    d = table(spark, sf, "documents")
    return P.choose_test_pages(d, "source", RATIO, SEED, FOLD)


def q_choose_test_pages(spark, sf):
    return _test_pages(spark, sf)


def q_train_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return P.train_sample(d, "source", _test_pages(spark, sf))


def q_test_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return P.test_sample(d, "source", _test_pages(spark, sf))


def _pos(spark, sf):
    space, pairs = _space_pairs(spark, sf)
    return space, pairs, P.positive_pairs(pairs, space, same_page=False, max_reuse=MAX_REUSE, seed=SEED)


def q_positive_pairs(spark, sf):
    _, _, pos = _pos(spark, sf)
    return pos.select("x1", "x2", "y", F.round(norm_l2(F.col("x")), R).alias("x_l2"))


def _neg(spark, sf):
    space, pairs, pos = _pos(spark, sf)
    n_pos = pos.count()
    n_neg = int((1 - BALANCE) * n_pos / BALANCE)
    return pos, P.negative_pairs(space, pairs, n_neg, same_page=False, seed=SEED)


def q_negative_pairs(spark, sf):
    _, neg = _neg(spark, sf)
    return neg.select("t", "x1", "x2", "y", F.round(norm_l2(F.col("x")), R).alias("x_l2"))


def q_balanced_dataset(spark, sf):
    pos, neg = _neg(spark, sf)
    b = P.balanced_dataset(pos, neg)
    return b.select("x1", "x2", "y", F.round(norm_l1(F.col("x")), R).alias("x_l1"))


def q_transform_space(spark, sf):
    space = topic_space(spark, sf)
    t = P.transform_space(space, fixed_L(64))
    return t.select(F.col("file").alias("vec_id"), F.round(norm_l2(F.col("w")), R).alias("w_l2"),
                    F.round(F.col("w")[0], R).alias("w_0"))


def q_pair_score(spark, sf):
    space = topic_space(spark, sf)
    return space.select(F.col("file").alias("vec_id"),
                        *[F.round(M.pair_score(F.col("w"), n), R).alias(f"score_{n}")
                          for n in ("l1", "l2", "inf")])


def q_average_precision(spark, sf):
    return M.average_precision(_scored(spark, sf)).select(F.round("ap", R).alias("ap"))


def _curve(spark, sf):
    return M.precision_recall_curve(_scored(spark, sf))


def q_precision_recall_curve(spark, sf):
    c = _curve(spark, sf)
    return c.select(F.round("precision", R).alias("precision"), F.round("recall", R).alias("recall"),
                    "threshold")


def q_label_shuffle_baseline(spark, sf):
    return M.label_shuffle_baseline(_scored(spark, sf), "doc_id", "y", SEED) \
        .select(F.round("ap", R).alias("ap"))


def q_find_radius(spark, sf):
    r = M.find_radius(_curve(spark, sf), 0.5)
    return r.select(F.col("radius").cast("double").alias("radius"),
                    F.round("precision", R).alias("precision"), F.round("recall", R).alias("recall"))


def _results(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linestatus", "l_linenumber",
                     (F.col("l_discount") * 10).alias("auc"), F.col("l_tax").alias("auc_tax"))


def q_summarize_auc(spark, sf):
    s = M.summarize_auc(_results(spark, sf), ["l_returnflag", "l_linestatus"], "auc")
    return s.select("l_returnflag", "l_linestatus", *[F.round(c, R).alias(c) for c in
                                                      ("mean_auc", "std_auc", "p5_auc", "p95_auc")], "n")


def _quart(spark, sf, by):
    q = M.auc_quartiles(_results(spark, sf), by, "auc_tax")
    return q.select(by, *[F.round(c, R).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


def q_compare_models(spark, sf):
    return _quart(spark, sf, "l_returnflag")


def q_compare_topics(spark, sf):
    return _quart(spark, sf, "l_linenumber")


def q_compare_norms(spark, sf):
    return _quart(spark, sf, "l_linestatus")


def q_compare_page_rule(spark, sf):
    r = _results(spark, sf).withColumn("same_page", F.col("l_returnflag") == "R")
    p = M.mean_auc_pivot(r, "l_linenumber", "same_page", [True, False], "auc")
    return p.select("l_linenumber", F.round("true", R).alias("same_page_in"),
                    F.round("false", R).alias("same_page_out"))


def q_curves_by_norm(spark, sf):
    p = M.mean_auc_pivot(_results(spark, sf), "l_linenumber", "l_linestatus", ["F", "O"], "auc")
    return p.select("l_linenumber", F.round("F", R).alias("norm_f"), F.round("O", R).alias("norm_o"))


def q_fold_pr_curves(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    s = _scored(spark, sf).join(docs, "doc_id")
    curves = M.precision_recall_curve(s, group_cols=["source"])
    ap = M.average_precision(s, group_cols=["source"])
    mean_ap = ap.agg(F.avg(F.nanvl("ap", F.lit(None).cast("double"))).alias("mean_ap")) \
        .withColumn("_k", F.lit(1))
    out = curves.withColumn("_k", F.lit(1)).join(F.broadcast(mean_ap), "_k")
    return out.select("source", F.round("precision", R).alias("precision"),
                      F.round("recall", R).alias("recall"), "threshold",
                      F.round("mean_ap", R).alias("mean_ap"))


QUERIES = {
    "split_labels": q_split_labels,
    "co_reused_pairs": q_co_reused_pairs,
    "choose_test_pages": q_choose_test_pages,
    "train_sample": q_train_sample,
    "test_sample": q_test_sample,
    "positive_pairs": q_positive_pairs,
    "negative_pairs": q_negative_pairs,
    "balanced_dataset": q_balanced_dataset,
    "transform_space": q_transform_space,
    "pair_score": q_pair_score,
    "average_precision": q_average_precision,
    "precision_recall_curve": q_precision_recall_curve,
    "label_shuffle_baseline": q_label_shuffle_baseline,
    "summarize_auc": q_summarize_auc,
    "compare_models": q_compare_models,
    "compare_topics": q_compare_topics,
    "compare_norms": q_compare_norms,
    "compare_page_rule": q_compare_page_rule,
    "curves_by_norm": q_curves_by_norm,
    "fold_pr_curves": q_fold_pr_curves,
    "find_radius": q_find_radius,
}

# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

SCORED = "scored AS (SELECT doc_id, quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id))"
CURVE = f"""{SCORED},
agg AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score),
cum AS (SELECT score, pos, neg,
          sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER () AS np FROM agg),
pts AS (SELECT score, pos, tp / (tp + fp) AS precision, tp / np AS recall FROM cum WHERE tp - pos < np)"""

W = "CAST(embedding AS DOUBLE[])"
SPACE_PAIRS = f"""
sp AS (SELECT vec_id AS file, label AS page, {W} AS w FROM embeddings),
ed AS (SELECT DISTINCT l_partkey AS file, l_orderkey AS reuse FROM lineitem WHERE l_partkey IN (SELECT file FROM sp)),
pr AS (SELECT DISTINCT a.file AS x1, b.file AS x2 FROM ed a JOIN ed b ON a.reuse = b.reuse AND a.file < b.file),
prp AS (SELECT x1, x2, CASE WHEN pa.page = pb.page THEN 1 ELSE 0 END AS same_page
        FROM pr JOIN sp pa ON pa.file = x1 JOIN sp pb ON pb.file = x2),
pos AS (SELECT x1, x2, 1 AS y, list_transform(list_zip(a.w, b.w), lambda z: abs(z[1] - z[2])) AS x,
               {md5_rank_sql(str(SEED), "'pos'", 'x1', 'x2')} AS h
        FROM prp JOIN sp a ON a.file = x1 JOIN sp b ON b.file = x2
        WHERE same_page = 0 ORDER BY h, x1, x2 LIMIT {MAX_REUSE})"""

NEG = f"""{SPACE_PAIRS},
npos AS (SELECT count(*) AS c FROM pos),
need AS (SELECT CAST(floor((1 - {BALANCE}) * c / {BALANCE}) AS BIGINT) AS k FROM npos),
ix AS (SELECT file, page, w, row_number() OVER (ORDER BY file) - 1 AS i FROM sp),
nn AS (SELECT count(*) AS n FROM ix),
draws AS (SELECT t,
            ({md5_rank_sql(str(SEED), "'a'", 't')}) % (SELECT n FROM nn) AS i1,
            ({md5_rank_sql(str(SEED), "'b'", 't')}) % (SELECT n FROM nn) AS i2
          FROM range(0, CAST((SELECT k FROM need) * 2.0 AS BIGINT) + 16) r(t)),
cand AS (SELECT t, a.file AS x1, b.file AS x2, a.page AS p1, b.page AS p2,
                list_transform(list_zip(a.w, b.w), lambda z: abs(z[1] - z[2])) AS x
         FROM draws JOIN ix a ON a.i = draws.i1 JOIN ix b ON b.i = draws.i2 WHERE i1 <> i2),
neg AS (SELECT t, x1, x2, 0 AS y, x FROM cand
        WHERE (least(x1, x2), greatest(x1, x2)) NOT IN (SELECT (x1, x2) FROM pr) AND p1 <> p2
        ORDER BY t LIMIT (SELECT k FROM need))"""

L2 = "sqrt(list_sum(list_transform(x, lambda v: v * v)))"
L1 = "list_sum(list_transform(x, lambda v: abs(v)))"

QUART = """SELECT {by}, round(quantile_cont(l_tax, 0.0), 6) AS q0, round(quantile_cont(l_tax, 0.25), 6) AS q25,
    round(quantile_cont(l_tax, 0.5), 6) AS q50, round(quantile_cont(l_tax, 0.75), 6) AS q75,
    round(quantile_cont(l_tax, 1.0), 6) AS q100 FROM lineitem GROUP BY {by}"""

TEST_PAGES = f"""tp AS (SELECT page FROM (
    SELECT page, row_number() OVER (ORDER BY {md5_rank_sql(str(SEED), str(FOLD), 'page')}, page) AS rn
    FROM (SELECT DISTINCT source AS page FROM documents))
  WHERE rn <= (SELECT CAST(floor(count(DISTINCT source) * {RATIO}) AS BIGINT) FROM documents))"""

ORACLE = {
    "split_labels": f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(
        string_split(concat_ws(' ', p_name, lower(p_type), p_name), ' '),
        lambda x: NOT list_contains({LABEL_STOP!r}, x)))), ' ') AS labels FROM part""".replace('"', "'"),
    "co_reused_pairs": """SELECT DISTINCT a.l_partkey AS x1, b.l_partkey AS x2,
        CASE WHEN pa.p_brand = pb.p_brand THEN 1 ELSE 0 END AS same_page, 1 AS same_reuse
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
        JOIN part pa ON pa.p_partkey = a.l_partkey JOIN part pb ON pb.p_partkey = b.l_partkey""",
    "choose_test_pages": f"WITH {TEST_PAGES} SELECT page FROM tp",
    "train_sample": f"WITH {TEST_PAGES} SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT page FROM tp)",
    "test_sample": f"WITH {TEST_PAGES} SELECT doc_id, source FROM documents WHERE source IN (SELECT page FROM tp)",
    "positive_pairs": f"WITH {SPACE_PAIRS} SELECT x1, x2, y, round({L2}, {R}) AS x_l2 FROM pos",
    "negative_pairs": f"WITH {NEG} SELECT t, x1, x2, y, round({L2}, {R}) AS x_l2 FROM neg",
    "balanced_dataset": f"""WITH {NEG}
        SELECT x1, x2, y, round({L1}, {R}) AS x_l1 FROM (SELECT x1, x2, y, x FROM pos UNION ALL SELECT x1, x2, y, x FROM neg)""",
    "transform_space": f"""WITH t AS (SELECT vec_id, list_transform(range(1, 65),
            lambda i: w[i] + 0.1 * coalesce(w[i + 1], 0.0)) AS x FROM (SELECT vec_id, {W} AS w FROM embeddings))
        SELECT vec_id, round({L2}, {R}) AS w_l2, round(x[1], {R}) AS w_0 FROM t""",
    "pair_score": f"""SELECT vec_id, round(-{L1}, {R}) AS score_l1, round(-{L2}, {R}) AS score_l2,
        round(-list_max(list_transform(x, lambda v: abs(v))), {R}) AS score_inf
        FROM (SELECT vec_id, {W} AS x FROM embeddings)""",
    "average_precision": f"WITH {CURVE} SELECT round(sum(pos * precision) / sum(pos), {R}) AS ap FROM pts",
    "precision_recall_curve": f"""WITH {CURVE}
        SELECT round(precision, {R}) AS precision, round(recall, {R}) AS recall, score AS threshold FROM pts
        UNION ALL SELECT 1.0, 0.0, NULL""",
    "label_shuffle_baseline": f"""WITH s0 AS (SELECT doc_id, quality AS y0, n_chars AS score FROM labels JOIN documents USING (doc_id)),
        byid AS (SELECT doc_id, score, row_number() OVER (ORDER BY doc_id) AS p FROM s0),
        byh AS (SELECT y0, row_number() OVER (ORDER BY {md5_rank_sql(str(SEED), 'doc_id')}) AS p FROM s0),
        scored AS (SELECT doc_id, y0 AS y, score FROM byid JOIN byh USING (p)),
        agg AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score),
        cum AS (SELECT score, pos, neg,
          sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER () AS np FROM agg),
        pts AS (SELECT pos, tp / (tp + fp) AS precision FROM cum WHERE tp - pos < np)
        SELECT round(sum(pos * precision) / sum(pos), {R}) AS ap FROM pts""",
    "find_radius": f"""WITH {CURVE}
        SELECT CAST(-score AS DOUBLE) AS radius, round(precision, {R}) AS precision, round(recall, {R}) AS recall
        FROM pts WHERE precision > 0.5 ORDER BY recall DESC, -score DESC, precision DESC LIMIT 1""",
    "summarize_auc": f"""SELECT l_returnflag, l_linestatus, round(avg(l_discount * 10), {R}) AS mean_auc,
        round(stddev_samp(l_discount * 10), {R}) AS std_auc, round(quantile_cont(l_discount * 10, 0.05), {R}) AS p5_auc,
        round(quantile_cont(l_discount * 10, 0.95), {R}) AS p95_auc, count(*) AS n
        FROM lineitem GROUP BY ALL""",
    "compare_models": QUART.format(by="l_returnflag"),
    "compare_topics": QUART.format(by="l_linenumber"),
    "compare_norms": QUART.format(by="l_linestatus"),
    "compare_page_rule": f"""SELECT l_linenumber,
        round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END), {R}) AS same_page_in,
        round(avg(CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END), {R}) AS same_page_out
        FROM lineitem GROUP BY l_linenumber""",
    "curves_by_norm": f"""SELECT l_linenumber,
        round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount * 10 END), {R}) AS norm_f,
        round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount * 10 END), {R}) AS norm_o
        FROM lineitem GROUP BY l_linenumber""",
    "fold_pr_curves": f"""WITH s AS (SELECT source, quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)),
        agg AS (SELECT source, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL),
        cum AS (SELECT source, score, pos,
          sum(pos) OVER (PARTITION BY source ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (PARTITION BY source ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER (PARTITION BY source) AS np FROM agg),
        pts AS (SELECT source, score, pos, tp / (tp + fp) AS precision, tp / np AS recall FROM cum WHERE tp - pos < np),
        ap AS (SELECT source, sum(pos * precision) / sum(pos) AS ap FROM pts GROUP BY source),
        m AS (SELECT avg(CASE WHEN isnan(ap) THEN NULL ELSE ap END) AS mean_ap FROM ap),
        c AS (SELECT source, precision, recall, score AS threshold FROM pts
              UNION ALL SELECT DISTINCT source, 1.0, 0.0, NULL FROM pts)
        SELECT source, round(precision, {R}) AS precision, round(recall, {R}) AS recall, threshold,
               round((SELECT mean_ap FROM m), {R}) AS mean_ap FROM c""",
}
