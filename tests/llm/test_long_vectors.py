"""Vectors of thousands of components: turned without a matrix, found all the same."""

import time

import numpy as np

from tallyline.llm import ann


def test_the_turn_is_orthogonal_and_spreads():
    for d in (1025, 1536, 3000):
        turn = ann.rotation(d)
        x = np.random.default_rng(1).normal(size=(6, d))
        assert np.allclose((x @ turn) @ (x @ turn).T, x @ x.T)
        one = np.zeros((1, d))
        one[0, 5] = 1.0
        assert np.abs(one @ turn).max() < 0.3 and ann.rotation(d) is turn


def test_estimates_of_long_vectors():
    rng = np.random.default_rng(2)
    d = 2500
    x, q = rng.normal(size=(200, d)) + 1, rng.normal(size=(10, d)) + 1
    c, turn = ann.centres(x[:100]), ann.rotation(d)
    estimate, bound = ann.Codes.of(x, c, turn).lower_bounds(q, c, turn)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (bound <= true).mean() > 0.97 and np.abs(estimate - true).mean() < 0.1 * true.mean()


def test_very_long_vectors_are_searched(spark):
    rng = np.random.default_rng(3)
    d = 50_000
    rows = [(k, rng.normal(size=d).round(3).tolist()) for k in range(1, 12)]
    rows += [(100, (np.array(rows[0][1]) + 0.01).tolist()), (13, rows[4][1])]
    began = time.time()
    found = ann.search_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert time.time() - began < 120
    own = np.array(rows[11][1])
    want = sorted((float(((np.array(v) - own) ** 2).sum()), i) for i, v in rows if i != 100)[:10]
    assert found.sort_values("rank").vec_id.tolist() == [i for _, i in want] and found.sort_values("rank").vec_id.iloc[0] == 1
