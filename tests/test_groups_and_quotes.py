"""Quoted fields, grouped quantiles and running sums, features in all modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.stats import group_prefix_sums, group_quantiles, group_row_number
from tabulon.operators import tablize as T
from tabulon.operators import textfeat as tf


@pytest.mark.parametrize("line,fields", [
    ('a;b', ['a', 'b']),
    ('"a;b";c', ['a;b', 'c']),
    ('"say ""x;y""";', ['say "x;y"', '']),
    ('a"b;c"d', ['a"b', 'c"d']),
    ('"open;rest', ['"open', 'rest']),
    ('"a"b;c', ['"a"b', 'c']),
    ('"";""', ['', '']),
    ('"', ['"']),
])
def test_fields_of_a_line(spark, line, fields):
    df = spark.createDataFrame([(line, ";")], "line string, d string")
    r = df.select(T._cells(F.col("line"), F.col("d")).alias("f"),
                  T._n_delimiters(F.col("line"), F.col("d")).alias("n")).first()
    assert r["f"] == fields and r["n"] == len(fields) - 1


@pytest.mark.parametrize("delim", T.DELIMITERS)
def test_every_delimiter_inside_quotes(spark, delim):
    df = spark.createDataFrame([(f'1{delim}"x{delim}y"{delim}2', delim)], "line string, d string")
    assert df.select(T._cells(F.col("line"), F.col("d"))).first()[0] == ["1", f"x{delim}y", "2"]


def test_a_very_long_quoted_field(spark):
    df = spark.range(1).select(F.concat(F.lit('"'), F.repeat(F.lit('ab""'), 200_000), F.lit('";z')).alias("line"),
                               F.lit(";").alias("d"))
    f = df.select(T._cells(F.col("line"), F.col("d"))).first()[0]
    assert [len(x) for x in f] == [600_000, 1]


def test_group_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 0 else f"g{g}", float(v)) for g in range(4) for v in rng.integers(0, 9, 50 * g + 1)]
    df = spark.createDataFrame(rows + [("empty", None), ("g1", None)], "g string, v double")
    got = {r["g"]: r for r in group_quantiles(df, ["g"], F.col("v"), {"a": 0.0, "b": 0.05, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {None, "g1", "g2", "g3", "empty"}
    assert got["empty"]["c"] is None
    for g in (None, "g1", "g2", "g3"):
        v = [x for k, x in rows if k == g]
        assert np.allclose([got[g][c] for c in "abcd"], np.quantile(v, [0.0, 0.05, 0.5, 1.0]))


def test_a_null_group_keeps_its_rows(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id") \
        .select(F.when(F.col("g") > 0, F.col("g")).alias("g"), "id")
    sums = group_prefix_sums(df, ["g"], [F.col("id")], ["id"], 5).collect()
    assert len(sums) == 100
    for g in (None, 1, 2):
        part = sorted((r["id"], r["cum_id"]) for r in sums if r["g"] == g)
        assert [c for _, c in part] == list(np.cumsum([i for i, _ in part]))
    numbered = group_row_number(df, ["g"], [F.col("id")], "rn", 5).filter("g is null").collect()
    assert sorted(r["rn"] for r in numbered) == list(range(1, 35))


def test_power_mixing_sums_powers_of_the_parts(spark):
    parts = spark.createDataFrame([(1, "maison maison jardin", "maison"), (2, "jardin arbre", "maison arbre"),
                                   (3, None, None)], "doc_id long, content string, header string")
    parts = parts.withColumn("extradata", F.lit(None).cast("string"))
    n = 3
    mats = {p: tf.count_part(parts.select("doc_id", F.coalesce(F.col(p), F.lit("")).alias("text")), n, 1)
            for p in ("content", "header")}
    for mode in ("linear", "power"):
        by_parts = tf.tfidf(tf.stem_merge(tf.mix_parts(mats, mode=mode)), n)
        want = {(r[0], r[1]): r[2] for r in by_parts.collect()}
        got = {(r[0], r[1]): r[2] for r in tf.extract_features(
            parts, header=True, mode=mode, min_df=1).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in got], [want[k] for k in got])
    assert tf.extract_features(parts, min_df=1, stem=False).count() == 4


def test_header_rows_are_cut_by_number(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",), ("",), (None,), ("a\n",)], "t string")
    cut = [[r[0] for r in df.select(tf.text_part_content(F.col("t"), n)).collect()] for n in (0, 1, 2)]
    assert cut == [["a\nb\nc", "a", "", "", "a\n"], ["b\nc", "", "", "", ""], ["c", "", "", "", ""]]
