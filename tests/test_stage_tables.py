"""Finished shuffles and spent stage tables leave the disk while a query goes on."""

import os

from pyspark.sql import functions as F

from tabulon import session
from tabulon.operators import textfeat as tf


def test_spent_tables_are_deleted(spark, monkeypatch):
    made = []
    cut = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: made.append(cut(df)) or made[-1])
    parts = spark.createDataFrame([(i, "head words", f"alpha beta gamma word{chr(97 + i % 5)} alpha", None) for i in range(20)],
                                  "doc_id long, header string, content string, extradata string")
    got = tf.extract_features(parts, content=True, header=True)
    assert got.count() > 0
    there = [os.path.exists(x._stage.replace("file:", "")) for x in made]
    assert there.count(False) == 4 and there[-1]


def test_finished_shuffles_are_let_go(spark, monkeypatch):
    monkeypatch.setattr(session, "RELEASE_BYTES", 1)
    monkeypatch.setattr(session, "_WRITTEN", {})
    out = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert out.count() == 7 and list(session._WRITTEN.values()) == [0]
