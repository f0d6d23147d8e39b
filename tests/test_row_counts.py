"""A document's terms are counted in its row; rows of one id are added up."""
from tabulon.operators import textfeat as tf


def _rows(df):
    return sorted((tuple(map(str, r)) for r in df.select("doc_id", "term", "count").collect()))


def test_no_term_is_hashed_or_shuffled(spark):
    docs = spark.createDataFrame([(1, "Été ete xyz, ete"), (2, ""), (3, None), (4, "xyz")], "doc_id long, text string")
    counts = tf.term_counts(tf.tokenize(docs, strip_stopwords=False, stop=[]))
    assert _rows(counts) == [("1", "ete", "3"), ("1", "xyz", "1"), ("4", "xyz", "1")]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


def test_rows_of_one_id_are_added_up(spark):
    docs = spark.createDataFrame([(1, "abc abc xyz"), (1, "abc"), (None, "xyz"), (None, "xyz"), (2, "abc")],
                                 "doc_id long, text string")
    want = [("1", "abc", "3"), ("1", "xyz", "1"), ("2", "abc", "1"), ("None", "xyz", "2")]
    assert _rows(tf.counted_terms(docs)) == want
