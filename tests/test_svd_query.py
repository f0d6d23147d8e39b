"""The registered svd_fit returns W and H beside the singular values."""

import numpy as np

from conftest import SF001
from tabulon.plans.fixtures import table
from tabulon.plans.q_topics import q_svd_fit


def test_svd_fit_returns_both_factors(spark):
    got = q_svd_fit(spark, SF001).toPandas()
    W, H = (got[got["part"] == p].pivot(index="id", columns="topic", values="w").to_numpy() for p in "WH")
    e = table(spark, SF001, "embeddings").orderBy("vec_id").toPandas()
    V = np.array([np.asarray(v, float) for v in e["embedding"]])
    sing = got.groupby("topic")["singular_value"].first().to_numpy()
    assert W.shape == (len(V), 10) and H.shape == (V.shape[1], 10)
    assert np.allclose(np.linalg.norm(W, axis=0), sing, rtol=1e-4)
    assert np.allclose(sing, np.linalg.svd(V, compute_uv=False)[:10], rtol=1e-3)
    assert np.allclose(V @ H, W, atol=1e-6 * sing[0])
