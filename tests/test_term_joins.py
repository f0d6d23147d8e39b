"""Joins of a matrix to its terms or documents hash the side of one row per
key; what two branches read is computed once."""

from tabulon.operators import textfeat as tf

COUNTS = [(1, "aa", 2), (1, "bb", 1), (2, "aa", 1), (2, "cc", 3), (3, "bb", 1), (3, "cc", 1)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_matrix_is_never_sorted(spark):
    counts = spark.createDataFrame(COUNTS, "doc_id long, term string, count long")
    kept = tf.df_filter(counts, 4)
    scaled, _ = tf.normalize_rows(counts, 4)
    merged = tf.stem_merge(scaled)
    for df in (kept, scaled, merged, tf.tfidf(kept, 4, "count", df_col="df")):
        plan = _plan(df)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_weighted_rows_are_computed_once(spark):
    kept = tf.df_filter(spark.createDataFrame(COUNTS, "doc_id long, term string, count long"), 4)
    out = tf.tfidf(kept, 4, "count", df_col="df")
    assert _plan(out).count("ShuffledHashJoin") == 1  # of the norms; the terms' join is in the stage table
    rows = out.collect()
    assert len(rows) == len(COUNTS)
    for doc in (1, 2, 3):
        assert abs(sum(r["weight"] ** 2 for r in rows if r["doc_id"] == doc) - 1) < 1e-12
