"""Brute-force and invariant checks for the operators whose Spark plan
differs from the obvious one (salting, distributed prefix sums, blocked
search) and for the iterative / random operators (R rows of the survey)."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabulon.functions.stats import global_index, global_prefix_sums
from tabulon.functions.text import stopwords, token_array
from tabulon.operators import metric as M
from tabulon.operators import metric_learning as ML
from tabulon.operators import neighbors as N
from tabulon.operators import pairs as P
from tabulon.operators import tablize as T
from tabulon.operators import topics as TP
from tabulon.plans.fixtures import table, topic_space


def _py_tokens(s, stop):
    s = unicodedata.normalize("NFKD", s.lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return [t for t in re.findall(r"\b[a-zA-Z]{3,}\b", s) if t not in stop]


def test_tokens_match_python_regex(spark):
    texts = ["Élève straße déjà-vu, naïve café; les données ouvertes",
             "ÇA VA très bien über alles ñandú", "ab abc abcd 123abc abc_def"]
    stop = stopwords()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", token_array(F.col("text"), stop).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _py_tokens(t, set(stop)), t


def test_salted_pairs_equal_plain_and_brute_force(spark):
    li = table(spark, SF001, "lineitem").select(F.col("l_partkey").alias("file"),
                                                F.col("l_orderkey").alias("reuse"))
    pages = table(spark, SF001, "part").select(F.col("p_partkey").alias("file"),
                                               F.col("p_brand").alias("page"))
    plain = {tuple(r) for r in P.co_reused_pairs(li, pages).collect()}
    salted_df = P.co_reused_pairs(li, pages, max_group=2)
    salted = {tuple(r) for r in salted_df.collect()}
    assert plain == salted
    edges = li.distinct().collect()
    page = {r["file"]: r["page"] for r in pages.collect()}
    by_reuse = {}
    for r in edges:
        by_reuse.setdefault(r["reuse"], set()).add(r["file"])
    brute = set()
    for files in by_reuse.values():
        for a in files:
            for b in files:
                if a < b:
                    brute.add((a, b, int(page.get(a) == page.get(b) and page.get(a) is not None), 1))
    assert plain == brute
    plan = salted_df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def _ap_brute(y, s):
    order = sorted(set(s), reverse=True)
    P_ = sum(y)
    ap, tp, fp = 0.0, 0, 0
    for th in order:
        pos = sum(1 for a, b in zip(y, s) if b == th and a == 1)
        neg = sum(1 for a, b in zip(y, s) if b == th and a == 0)
        tp, fp = tp + pos, fp + neg
        ap += pos / P_ * tp / (tp + fp)
    return ap


def test_average_precision_with_ties(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0]
    s = [0.9, 0.9, 0.8, 0.5, 0.5, 0.4, 0.3, 0.3, 0.1, 0.05]
    df = spark.createDataFrame(list(zip(range(10), y, s)), "id int, y int, score double")
    ap = M.average_precision(df).first()["ap"]
    assert ap == pytest.approx(_ap_brute(y, s))
    curve = M.precision_recall_curve(df).collect()
    assert sum(1 for r in curve if r["threshold"] is None) == 1
    radius = M.find_radius(M.precision_recall_curve(df), 0.5).first()
    assert radius["precision"] > 0.5


def test_global_index_and_prefix_sums(spark):
    rows = [(int(k), int(k % 7)) for k in np.random.default_rng(0).permutation(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    idx = {r["k"]: r["index"] for r in global_index(df, "k").collect()}
    assert idx == {k: i for i, k in enumerate(sorted(k for k, _ in rows))}
    cum = {r["k"]: r["cum_v"] for r in global_prefix_sums(df, [F.desc("k")], ["v"]).collect()}
    acc, want = 0, {}
    for k, v in sorted(rows, reverse=True):
        acc += v
        want[k] = acc
    assert cum == want


def _emb(spark):
    sp = topic_space(spark, SF001)
    rows = sp.collect()
    ids = np.array([r["file"] for r in rows])
    W = np.array([r["w"] for r in rows])
    return sp, ids, W


def test_knn_and_radius_match_brute_force(spark):
    sp, ids, W = _emb(spark)
    D = np.sqrt(((W[:, None, :] - W[None, :, :]) ** 2).sum(-1))
    got = N.knn(sp, 5, block_rows=64).collect()
    for r in got:
        i = int(np.where(ids == r["a"])[0][0])
        d = D[i].copy()
        d[i] = np.inf
        kth = np.sort(d)[4]
        assert r["distance"] <= kth + 1e-9
    assert len(got) == 5 * len(ids)
    radius = float(np.quantile(D[D > 0], 0.02))
    edges = {(r["a"], r["b"]) for r in N.radius_neighbors(sp, radius, block_rows=64).collect()}
    brute = {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(D <= radius))}
    assert edges == brute
    lsh = {(r["a"], r["b"]) for r in N.radius_neighbors(sp, radius, method="lsh").collect()}
    assert lsh <= brute | {(b, a) for a, b in brute}
    copies = sp.unionByName(sp.withColumn("file", F.col("file") + 100000))
    twice = N.knn(copies, 1, block_rows=16).collect()  # a row's copy is its nearest
    assert {(r["a"], r["b"]) for r in twice} >= {(int(i), int(i) + 100000) for i in ids}


def test_svd_singular_values(spark):
    sp, ids, W = _emb(spark)
    V = sp.select("file", F.posexplode("w").alias("term", "value"))
    _, _, sing = TP.svd_fit(V, k=5, oversample=59, row="file", col="term")
    ref = np.linalg.svd(W, compute_uv=False)[:5]
    assert np.allclose(sing, ref, rtol=1e-6)


def test_nmf_nonnegative_and_decreasing(spark):
    sp, ids, W = _emb(spark)
    V = sp.select("file", F.posexplode(F.transform("w", lambda v: F.abs(v))).alias("term", "value"))
    Wf, Hf, obj = TP.nmf_fit(V, k=3, n_iter=5, row="file", col="term")
    assert Wf.filter(F.col("w") < 0).count() == 0
    assert Hf.filter(F.col("w") < 0).count() == 0
    assert all(b <= a * (1 + 1e-9) for a, b in zip(obj, obj[1:]))


def test_lsml_psd_and_loss_falls(spark):
    sp = topic_space(spark, "/root/testdata/sf0.01")
    li = table(spark, "/root/testdata/sf0.01", "lineitem").select(
        F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("reuse"))
    pairs = P.co_reused_pairs(li.join(sp.select("file"), "file", "left_semi"),
                              sp.select("file", F.col("page").cast("string").alias("page")))
    pos = P.positive_pairs(pairs, sp, True, 2000)
    neg = P.negative_pairs(sp, pairs, int(0.7 * pos.count() / 0.3), True)
    assert neg.join(pairs.select(F.col("x1"), F.col("x2")), ["x1", "x2"]).count() == 0
    ds = P.balanced_dataset(pos, neg)
    L, Mx, losses = ML.learn_metric(ML.make_constraints(ds), 64, max_iter=4)
    assert np.linalg.eigvalsh(Mx).min() > -1e-8
    assert losses[-1] <= losses[0]
    assert np.allclose(L.T @ L, Mx, atol=1e-6)


def test_tablize_headerless_and_failures(spark):
    files = spark.createDataFrame([
        # a text column of varying width is not typed, so the first row
        # scores -2/3: no header, table starts at row 0
        ("headerless", "\n".join(f"{i};{'x' * (i % 4 + 2)};{i}.5" for i in range(10, 22))),
        # every column of every candidate fits its type: score -1, no table
        ("numbers", "\n".join(f"{i};{i * 2};{i * 3}.5" for i in range(12))),
        ("prose", "just some words\nwithout any table at all\nreally none"),
    ], "file_id string, text string")
    r = T.tablize_delimited(files)
    heads = {x["file_id"]: x for x in r["headers"].collect()}
    assert heads["headerless"]["no_header"] is True and heads["headerless"]["header_row"] == 0
    errors = {x["file_id"]: x["error_type"] for x in r["errors"].collect()}
    assert errors == {"numbers": "no_header", "prose": "no_delimiter"}
    prof = r["profile"].first()
    assert (prof["x"], prof["y"], prof["integer"], prof["float"], prof["object"]) == (12, 3, 1, 1, 1)
    names = {x["col_name"] for x in r["cells"].collect()}
    assert names == {"0", "1", "2"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products_in_pair_plans(spark):
    from tabulon.plans import q_neigh

    for name in ("reuse_pairs_in_neighborhood", "sampled_pair_distances", "co_reused_pairs"):
        df = q_neigh.QUERIES[name](spark, SF001) if name in q_neigh.QUERIES else None
        if df is None:
            from tabulon.plans import q_pairs
            df = q_pairs.QUERIES[name](spark, SF001)
        df.count()
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
