"""The 8-bit scorer against numpy, and the gate where one scale for all channels is too coarse."""

import numpy as np

from proselake.operators import quantized as Q


def test_integer_scores(spark):
    draw = np.random.default_rng(4)
    x, w = draw.standard_normal((200, 12)), draw.standard_normal((3, 12)) * np.array([[1.0], [0.01], [5.0]])
    x[0] = 0
    v = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    weights = spark.createDataFrame([(c, d, float(w[c, d])) for c in range(3) for d in range(12)], "channel int, dim int, w double")
    got = {(r["vec_id"], r["channel"]): (r["dot"], r["score"]) for r in Q.integer_scores(v, weights).collect()}
    xs, ws = np.abs(x).max(1) / 127, np.abs(w).max(1) / 127
    xs[xs == 0] = 1
    dots = np.rint(x / xs[:, None]).astype(int) @ np.rint(w / ws[:, None]).astype(int).T
    assert len(got) == 600
    for (k, c), (dot, score) in got.items():
        assert dot == dots[k, c] and abs(score - dot * xs[k] * ws[c]) < 1e-9
    exact = Q.scores(v, weights)
    assert all(abs(r["score"] - x[r["vec_id"]] @ w[r["channel"]]) < 1e-9 for r in exact.collect())
    fine, coarse = (Q.gate(exact, Q.integer_scores(v, weights, per_channel=p)).first() for p in (True, False))
    assert fine["n"] == 200 and fine["passes"] and fine["agreement"] >= coarse["agreement"]
    small = weights.where("channel = 1")
    error = lambda p: Q.gate(Q.scores(v, small), Q.integer_scores(v, weights, per_channel=p).where("channel = 1")).first()["mean_difference"]
    assert error(True) < error(False) / 20  # a channel of small weights is lost under one scale for all
