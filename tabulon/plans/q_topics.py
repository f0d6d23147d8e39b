"""Registered queries for the topic space and metric learning (M1, M2,
M4, M6, M7, P8, P14–P16, P22, P23, S13).  Factorisations are not unique
and the learning is iterative, so these carry no oracle: the tests check
invariants (non-negativity, non-increasing objective, PSD metric,
singular values against NumPy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metric_learning as ML
from ..operators import neighbors as N
from ..operators import pairs as P
from ..operators import textfeat as tf
from ..operators import topics as T
from ..session import cut_lineage, let_go, scratch_dir
from ..sources import results as RL
from .fixtures import table, topic_space

R = 6
SEED = 0


def _tfidf_long(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = tf.n_documents(docs)
    counts = tf.counted_terms(docs)
    weights = tf.tfidf(tf.df_filter(counts, n), n, "count", df_col="df")
    let_go(counts)
    return weights


def _emb_long(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("file"),
                    F.posexplode(F.col("embedding").cast("array<double>")).alias("term", "value"))


def _files(spark, sf):
    return topic_space(spark, sf).select("file", "page")


def _pairs(spark, sf):
    space = topic_space(spark, sf)
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"),
                                             F.col("l_orderkey").alias("reuse"))
    return P.co_reused_pairs(li.join(space.select("file"), "file", "left_semi"),
                             space.select("file", F.col("page").cast("string").alias("page")))


def _doc_matrix(spark, sf):
    return _tfidf_long(spark, sf).select(F.col("doc_id").alias("file"), "term", F.col("weight").alias("value"))


def _doc_files(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("page"))


def _doc_pairs(spark, sf):
    files = _doc_files(spark, sf)
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("reuse"))
    return P.co_reused_pairs(li.join(files.select("file"), "file", "left_semi"), files)


def q_nmf_fit(spark, sf):
    W, H, _ = T.nmf_fit(_doc_matrix(spark, sf), k=5, seed=SEED, row="file", col="term")
    both = W.select(F.lit("W").alias("part"), F.col("file").cast("string").alias("id"), "topic", "w") \
        .unionByName(H.select(F.lit("H").alias("part"), F.col("term").alias("id"), "topic", "w"))
    return both.select("part", "id", F.col("topic").cast("long").alias("topic"), F.round("w", R).alias("w"))


def q_svd_fit(spark, sf):
    W, H, sing = T.svd_fit(_emb_long(spark, sf), k=10, seed=SEED, row="file", col="term")
    both = W.select(F.lit("W").alias("part"), F.col("file").cast("long").alias("id"), "topic", "w") \
        .unionByName(H.select(F.lit("H").alias("part"), F.col("term").cast("long").alias("id"), "topic", "w"))
    values = F.array(*[F.lit(float(s)) for s in sing])
    return both.select("part", "id", F.col("topic").cast("long").alias("topic"),
                       values[F.col("topic").cast("int")].alias("singular_value"), "w")


def q_project_topics(spark, sf):
    """Held-out half of the documents in the space fitted to the other, by both models."""
    V = cut_lineage(_doc_matrix(spark, sf))
    held = F.crc32(F.col("file").cast("string")) % 2 == 0
    train, test = V.where(~held), V.where(held)
    of_svd, of_nmf = T.both_topics(train, 10, SEED, row="file", col="term")
    svd = T.svd_project(test, of_svd, row="file", col="term").select(F.lit("svd").alias("model"), "file", "topic", "w")
    nmf = T.nmf_project(test, of_nmf, 10, row="file", col="term").select(F.lit("nmf").alias("model"), "file", "topic", "w")
    return svd.unionByName(nmf).select("model", "file", F.col("topic").cast("long").alias("topic"), F.round("w", R).alias("w"))


def q_pca_reduce(spark, sf):
    coords, ratio = T.pca_reduce(topic_space(spark, sf), 2)
    return coords.select("file", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"),
                         F.lit(ratio[0]).alias("explained_1"), F.lit(ratio[1]).alias("explained_2"))


def q_local_pca(spark, sf):
    space = topic_space(spark, sf)
    edges = N.radius_neighbors(space, 1.2)
    best = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.max(F.struct("n", (-F.col("a")).alias("neg"))).alias("b")).first()["b"]
    target = -best["neg"]
    hood = N.radius_neighbors(space, 1.2, targets=[target]).select("b")
    coords, ratio = T.local_pca(space, hood, 3)
    return coords.select(F.lit(target).cast("long").alias("target"), "file",
                         *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(3)])


def _dataset(spark, sf):
    space = topic_space(spark, sf)
    pairs = _pairs(spark, sf)
    pos = P.positive_pairs(pairs, space, True, 30000, SEED)
    n_pos = pos.count()
    neg = P.negative_pairs(space, pairs, int(0.7 * n_pos / 0.3), True, SEED)
    return P.balanced_dataset(pos, neg)


def q_learn_metric(spark, sf):
    L, _, losses = ML.learn_metric(ML.make_constraints(_dataset(spark, sf), SEED), 64)
    rows = [(i, j, float(L[i, j])) for i in range(L.shape[0]) for j in range(L.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, value double")


def q_train_test_matrix(spark, sf):
    space = topic_space(spark, sf)
    tp = P.choose_test_pages(space, "page", 0.5, SEED, 1)
    L, test, test_t = ML.train_test_matrix(space, _pairs(spark, sf), tp, True)
    out = test.select("x1", "x2", "y", F.lit("plain").alias("space"))
    if test_t is not None:
        out = out.unionByName(test_t.select("x1", "x2", "y", F.lit("learned").alias("space")))
    return out


def q_run_fold(spark, sf):
    return ML.run_fold(topic_space(spark, sf), _pairs(spark, sf), 1)


MODELS, TOPICS, FOLDS = ["nmf", "svd"], [5, 10, 15], [1, 2, 3, 4, 5]


def q_grid_search(spark, sf):
    path = scratch_dir(spark, "grid")
    RL.create_result_log(spark, path)
    ML.grid_search(_doc_matrix(spark, sf), _doc_files(spark, sf), _doc_pairs(spark, sf), folds=FOLDS,
                   models=MODELS, topic_counts=TOPICS, results_path=path, seed=SEED)
    return RL.read_result_log(spark, path)


def q_append_result_row(spark, sf):
    path = scratch_dir(spark, "results")
    RL.create_result_log(spark, path)
    li = table(spark, sf, "lineitem")
    summary = li.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("auc"))
    for flag in ("A", "N", "R"):
        rows = summary.filter(F.col("l_returnflag") == flag).select(
            F.lit("svd").alias("model"), F.lit(5).alias("n_topics"), F.lit(0).alias("fold"),
            F.lit(True).alias("page"), F.lit(False).alias("metric_learning"),
            F.col("l_linestatus").alias("norm"), F.lit(False).alias("random"), "auc")
        RL.append_result_rows(rows, path)
    log = RL.read_result_log(spark, path)
    return log.withColumn("auc", F.round("auc", R))


def _best_space(spark, sf):
    return ML.fitted_space(_doc_matrix(spark, sf), _doc_files(spark, sf), "nmf", 25, SEED)


def q_best_topic_space(spark, sf):
    _, curve, _, _ = ML.best_topic_space(_best_space(spark, sf), _doc_pairs(spark, sf), learn=True, seed=SEED)
    return curve.select(F.round("precision", R).alias("precision"), F.round("recall", R).alias("recall"),
                        F.round("threshold", R).alias("threshold"))


def q_both_topic_spaces(spark, sf):
    before, after, _ = ML.both_topic_spaces(_best_space(spark, sf), _doc_pairs(spark, sf), seed=SEED)
    return before.select("file", F.lit("before").alias("space"), "w") \
        .unionByName(after.select("file", F.lit("after").alias("space"), "w")) \
        .select("file", "space", F.array_join(F.transform("w", lambda v: F.round(v, R).cast("string")), " ")
                .alias("w"))


QUERIES = {
    "nmf_fit": q_nmf_fit,
    "svd_fit": q_svd_fit,
    "project_topics": q_project_topics,
    "pca_reduce": q_pca_reduce,
    "local_pca": q_local_pca,
    "learn_metric": q_learn_metric,
    "train_test_matrix": q_train_test_matrix,
    "run_fold": q_run_fold,
    "grid_search": q_grid_search,
    "append_result_row": q_append_result_row,
    "best_topic_space": q_best_topic_space,
    "both_topic_spaces": q_both_topic_spaces,
}

ORACLE: dict[str, str] = {
    "append_result_row": """SELECT 'svd' AS model, 5 AS n_topics, 0 AS fold, true AS page, false AS metric_learning,
        l_linestatus AS norm, false AS random, round(avg(l_discount), 6) AS auc
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
}
