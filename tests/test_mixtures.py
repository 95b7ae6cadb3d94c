"""Fits by sums against NumPy on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailgrain.operators import mixtures as M


def on_rows(scores, rounds=60):
    x = np.log(scores[scores > 0])
    mu, var, w = np.quantile(x, [0.25, 0.75]), np.full(2, max(x.var(), 1e-4)), np.array([0.5, 0.5])
    density = lambda: np.stack([np.log(w[k]) - 0.5 * (np.log(2 * np.pi * var[k]) + (x - mu[k]) ** 2 / var[k]) for k in (0, 1)], 1)
    last = -np.inf
    for _ in range(rounds):
        norm = np.logaddexp(*density().T)
        r = np.exp(density() - norm[:, None])
        if abs(norm.sum() - last) <= 1e-7 * max(1, abs(norm.sum())):
            break
        last = norm.sum()
        w, mu = r.sum(0) / r.sum(), (r * x[:, None]).sum(0) / r.sum(0)
        var = np.maximum((r * (x[:, None] - mu) ** 2).sum(0) / r.sum(0), 1e-4)
    return mu, var, w, np.exp(density() - np.logaddexp(*density().T)[:, None])


def test_mixture(spark):
    rng = np.random.default_rng(2)
    scores = np.concatenate([np.exp(rng.normal(-4, 0.4, 400)), np.exp(rng.normal(-1, 0.3, 80)), np.zeros(20)])
    frame = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "edge_id long, score double").repartition(3)
    m = M.fit_mixture(frame)
    mu, var, w, resp = on_rows(scores)
    assert m.status == "fitted"
    assert np.allclose([m.means, m.variances, m.weights], [mu, var, w], atol=1e-6)
    got = {r.edge_id: r.membership for r in M.membership(frame, m).collect()}
    x, k = np.log(scores[:480]), int(mu.argmax())
    want = np.where(x >= mu.mean(), resp[:, k], 0.0)
    assert np.allclose([got[i] for i in range(480)], want, atol=1e-6)
    assert all(got[i] == 0 for i in range(480, 500))


def test_mixture_abstains(spark):
    rng = np.random.default_rng(4)
    one = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(-2, 0.5, 300))], "score double")
    assert M.fit_mixture(one).status == "abstained by BIC"
    assert M.fit_mixture(one.limit(5)).status.startswith("abstained: too little")
    assert M.fit_mixture(one.withColumn("score", F.lit(0.3))).status.startswith("abstained: too little")
    assert M.membership(one, M.fit_mixture(one)).agg(F.max("membership")).first()[0] == 0
    with pytest.raises(ValueError, match="finite"):
        M.fit_mixture(one.withColumn("score", F.lit(-1.0)))


def test_two_means_and_projection(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal([0.2, 0.3, 0.5], 0.05, (150, 3)), rng.normal([0.8, 0.7, 0.5], 0.08, (40, 3))])
    rows = spark.createDataFrame([(i, *map(float, v), 1.0) for i, v in enumerate(x)], "edge_id long, a double, b double, c double, d double").repartition(3)
    centres = M.two_means(rows, ["a", "b", "c"], "edge_id", restarts=5)
    labels = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    groups = sorted((x[labels == k] for k in (0, 1)), key=len)
    assert [len(g) for g in groups] == [40, 150]
    within = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups)
    want = np.linalg.pinv(within + np.eye(3) * 1e-6) @ (groups[0].mean(0) - groups[1].mean(0))
    got = M.projection(rows, ["a", "b", "d", "c"], "edge_id", restarts=5)
    assert np.allclose(got[[0, 1, 3]], want / np.linalg.norm(want), atol=1e-6)
    assert got[2] == 0
    same = rows.withColumns({f: F.lit(0.5) for f in "abcd"})
    assert M.two_means(same, ["a", "b"], "edge_id", restarts=2) is None
    assert (M.projection(same, ["a", "b"], "edge_id") == 0).all()


def test_scaled(spark):
    rows = spark.createDataFrame([(1, None, 2.0, 5.0), (2, 1.0, float("nan"), 5.0), (3, 2.0, 4.0, 5.0), (4, 5.0, 6.0, 5.0)], "edge_id long, a double, b double, c double")
    got = {r.edge_id: (r.a, r.b, r.c) for r in M.scaled(rows, ["a", "b", "c"]).collect()}
    assert got == {1: (0.25, 0.0, 0.5), 2: (0.0, 0.5, 0.5), 3: (0.25, 0.5, 0.5), 4: (1.0, 1.0, 0.5)}
    assert math.isclose(M.quantiles(spark.createDataFrame([(1.0, 3), (4.0, 1)], "x double, c long"), [0.9])[0], float(np.quantile([1, 1, 1, 4], 0.9)))
