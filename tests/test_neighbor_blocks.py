"""The neighbour search sends a row to few blocks and brings columns along."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import neighbors as N


def _space(spark, n=3000, dim=8):
    X = np.random.default_rng(5).normal(size=(n, dim)).astype(np.float32).astype(float)
    rows = [(i, X[i].tolist(), f"p{i % 7}" if i % 11 else None, [i % 50, 1000 + i % 3] if i % 2 else [])
            for i in range(n)]
    return X, rows, spark.createDataFrame(rows, "file long, w array<double>, page string, reuses array<long>")


def test_rows_visit_few_blocks(spark):
    _, _, space = _space(spark)
    cells = N._Cells(space, "euclidean", 16)  # 188 cells, that a row without structure visits all
    asked = cells.rows.select("file", "w", F.lit(100.0).alias("reach"))
    assert cells.n_blocks <= 30
    assert cells.visits(asked).count() == 3000 * cells.n_blocks
    assert cells.vector == "array<float>"


def test_edges_with_columns_and_shared_items(spark):
    X, rows, space = _space(spark)
    got = {(r.a, r.b): r for r in N.radius_neighbors(space, 1.5, block_rows=64, keep=["page"], shared="reuses").collect()}
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(axis=2))
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(d <= 1.5))))
    for (a, b), r in got.items():
        assert abs(r.distance - d[a, b]) < 1e-12
        assert (r.page_a, r.page_b) == (rows[a][2], rows[b][2])
        assert r.shared == bool(set(rows[a][3]) & set(rows[b][3]))


def test_carried_columns_give_the_same_reports(spark):
    _, _, space = _space(spark, 400, 3)
    pages = space.select("file", F.coalesce("page", F.lit("none")).alias("page"))
    reuses = space.select("file", F.explode("reuses").alias("reuse"))
    plain = N.radius_neighbors(space, 0.5)
    rich = N.radius_neighbors(space.drop("page").join(pages, "file"), 0.5, keep=["page"], shared="reuses")

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.fillna(-1.0).collect())

    for make in (lambda e: N.neighbor_counts(e, pages), lambda e: N.target_reuses(e, pages, reuses),
                 lambda e: N.describe_neighbors(e.select("a", "b", "distance", *[c for c in e.columns if c == "shared"]),
                                                pages, reuses)
                 .select("a", "b", "rank", "distance", "page", "common_reuse")):
        assert rows(make(plain)) == rows(make(rich))


def test_neighbours_of_given_targets(spark):
    _, _, space = _space(spark, 500, 3)
    some = N.radius_neighbors(space, 0.7, block_rows=64, targets=[3, 8])
    every = N.radius_neighbors(space, 0.7, block_rows=64).filter(F.col("a").isin(3, 8))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
