"""op1 through Spark against brute force where vectors and vec_ids repeat."""

import numpy as np
import pandas as pd

from tabulon.llm import curves


def brute(ids, x, asked, k):
    out = {}
    for query in asked:
        score = (x[:, None, :] * x[ids == query][None]).sum(axis=2).max(axis=1)
        best = {}
        for i, s in zip(ids.tolist(), score.tolist()):
            if i != query:
                best[i] = max(s, best.get(i, s))
        out[query] = sorted(best, key=lambda i: (-best[i], i))[:k]
    return out


def test_repeated_vectors_and_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 10, (1100, 8)).astype(float)
    ids = rng.permutation(1100) + 1
    x[:300] = x[0]  # equal vectors
    x[300:360] = x[300]
    ids[400:460] = ids[400]  # one vec_id with many near vectors
    x[400:460] = x[300] * 2 + rng.integers(0, 2, (60, 8))
    x[500:520, 6:] = 0.0
    rows = [(int(i), v.tolist() if j % 2 else v[:6].tolist() if not v[6:].any() else v.tolist())
            for j, (i, v) in enumerate(zip(ids, x))] + [(None, [1.0]), (5000, [0.0, 0.0]), (5001, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [int(i) for i in [*ids[:8], *ids[300:304], ids[400], *ids[495:530]]]
    got = curves.neighbours(vectors, vectors.where(f"vec_id in ({','.join(map(str, asked))})"), 20).toPandas()
    want = brute(ids, x, sorted(set(asked)), 20)
    assert {q: g.sort_values("rank")["vec_id"].tolist() for q, g in got.groupby("query_id")} == want


def test_block_keeps_ties_and_counts_an_id_once():
    x = np.random.default_rng(1).normal(size=(200, 4))
    x[:60] = np.array([9.0, 0, 0, 0]) + np.arange(60)[:, None] * 1e-3  # all of vec_id 7
    x[60:120] = [5.0, 0, 0, 0]
    ids = np.concatenate([np.full(60, 7), 1000 - np.arange(140)])
    block = pd.DataFrame({"v": list(x), "ids": [[i] for i in ids]})
    asked = pd.DataFrame({"g": [3], "q": [np.array([1.0, 0, 0, 0])], "least": [-np.inf]})
    assert curves.block_best(block, asked, 20)["vec_id"].tolist() == [7, *range(941, 960)]
