"""Co-reused pairs of neighbourhoods, without a row per (edge, reuse)."""

import numpy as np
import pytest

from tabulon.operators import neighbors as N


@pytest.mark.parametrize("held", [N.HELD_REUSES, 40])
def test_local_pairs_against_sets(spark, held):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))} | {(7, b) for b in range(60)})
    reuses = sorted({(int(f), int(r)) for f, r in rng.integers(0, 50, (160, 2))} | {(f, 99) for f in range(0, 60, 2)})
    held_by = {f: {r for g, r in reuses if g == f} for f in range(60)}
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    want = {(t, x, y) for t, bs in near.items() for x in bs for y in bs if x < y and held_by[x] & held_by[y]}
    # a repeated edge and a repeated or null reuse make no pair of their own
    e = spark.createDataFrame(edges + edges[:20], "a long, b long").selectExpr("*", "b % 3 = 0 AS s", "if(b % 5 = 0, null, b % 2 = 0) AS r")
    f = spark.createDataFrame(reuses + reuses[:9] + [(1, None), (3, None)], "file long, reuse long")
    local = N._local_pairs(e, f, "s", "r", held_reuses=held)
    got = [tuple(x) for x in local.collect()]
    assert len(got) == len(want) and {x[:3] for x in got} == want
    assert all((s1, s2) == (x % 3 == 0, y % 3 == 0) and (r1, r2) == tuple(b % 5 != 0 and b % 2 == 0 for b in (x, y))
               for _, x, y, s1, r1, s2, r2 in got)
    assert "Join" not in local._jdf.queryExecution().optimizedPlan().toString()


def test_stretches_hold_all_candidates_of_a_row():
    row, weight = np.repeat([0, 2, 3], [2, 3, 1]), np.array([5, 5, 0, 9, 9, 1])
    assert list(N._stretches(row, weight, 6)) == [(0, 2), (2, 5), (5, 6)]
