"""Mixed models against dense solves of the same equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators.mixed import estimates, fit_mixed, predict_mixed


def simulate(groups, per, sigma, family, seed, ragged=False):
    rng = np.random.default_rng(seed)
    rows = []
    chol = np.linalg.cholesky(np.atleast_2d(sigma))
    for g in range(groups):
        u = chol @ rng.standard_normal(len(chol))
        for i in range(per if not ragged else 1 + g % per):
            a, b = rng.integers(0, 2, 2)
            x = [1.0, float(a), float(b), float(a * b)]
            eta = 1.0 + 0.5 * a - 0.7 * b + 0.3 * a * b + sum(v * x[j] for j, v in enumerate(u))
            mu = np.exp(eta)
            y = rng.gamma(3.0, mu / 3.0) if family == "gamma" else float(rng.poisson(mu))
            rows.append((f"g{g}" if g else None, x, float(y)))
    return rows


def dense(rows, random, family, iterations):
    """The same iteration on raw rows, with one large penalised system and no
    elimination: fixed effects and all group effects are solved together."""
    names = sorted({r[0] for r in rows}, key=str)
    x = np.array([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    gi = np.array([names.index(r[0]) for r in rows])
    p, q, G = x.shape[1], len(random), len(names)
    z = np.zeros((len(rows), G * q))
    for i, g in enumerate(gi):
        z[i, g * q:(g + 1) * q] = x[i, list(random)]
    t = np.hstack([x, z])
    beta, u, sigma, phi = np.zeros(p), np.zeros(G * q), np.eye(q) * 0.25, 1.0
    beta[0] = np.log(y.mean())
    for _ in range(iterations):
        pen = np.zeros((p + G * q,) * 2)
        pen[p:, p:] = np.kron(np.eye(G), np.linalg.inv(sigma))
        for _ in range(200):
            mu = np.exp(t @ np.r_[beta, u])
            w = np.full(len(y), 1 / phi) if family == "gamma" else mu
            h = t.T @ (w[:, None] * t) + pen
            new = np.linalg.solve(h, t.T @ (w * (t @ np.r_[beta, u] + (y - mu) / mu)))
            change = np.abs(new - np.r_[beta, u]).max()
            beta, u = new[:p], new[p:]
            if change < 1e-12:
                break
        mu = np.exp(t @ np.r_[beta, u])
        w = np.full(len(y), 1 / phi) if family == "gamma" else mu
        cov = np.linalg.inv(t.T @ (w[:, None] * t) + pen)
        sigma = sum(np.outer(u[g * q:(g + 1) * q], u[g * q:(g + 1) * q])
                    + cov[p + g * q:p + (g + 1) * q, p + g * q:p + (g + 1) * q] for g in range(G)) / G
        if family == "gamma":
            phi = (((y - mu) / mu) ** 2).sum() / (len(y) - p)
    return beta, sigma, phi, dict(zip(names, u.reshape(G, q))), cov[:p, :p]


@pytest.mark.parametrize("family,random,sigma,ragged", [
    ("gamma", (0,), 0.4, True), ("poisson", (0,), 0.3, False),
    ("gamma", (0, 1), [[0.5, 0.2], [0.2, 0.4]], False)])
def test_equals_dense_solve(spark, family, random, sigma, ragged):
    rows = simulate(40, 9, sigma, family, 7, ragged)
    df = spark.createDataFrame(rows, "g string, x array<double>, y double").repartition(5)
    fit = fit_mixed(df, "x", "y", "g", random, family, tolerance=1e-9)
    assert fit.converged and fit.n_groups == 40
    beta, s, phi, u, cov = dense(rows, random, family, 1500)
    np.testing.assert_allclose(fit.beta, beta, atol=2e-5)
    np.testing.assert_allclose(fit.sigma, s, atol=2e-4)
    np.testing.assert_allclose(fit.dispersion, phi, rtol=1e-4)
    np.testing.assert_allclose(fit.cov_beta, cov, atol=2e-4)
    got = {r.g: r.u for r in fit.effects().collect()}
    assert set(got) == set(u)
    for g in u:
        np.testing.assert_allclose(got[g], u[g], atol=1e-3)
    grid = spark.createDataFrame([(g, [1.0, 1.0, 0.0, 0.0]) for g in (None, "g3", "unseen")],
                                 "g string, x array<double>")
    seen = {r.g: r.epred for r in predict_mixed(fit, grid, "x").collect()}
    x = np.array([1.0, 1.0, 0.0, 0.0])
    for g in (None, "g3"):
        assert abs(seen[g] - np.exp(x @ beta + x[list(random)] @ u[g])) < 1e-2
    assert abs(seen["unseen"] - np.exp(x @ beta)) < 1e-3
    plain = predict_mixed(fit, grid, "x", group_effects=False).collect()
    assert len({round(r.epred, 9) for r in plain}) == 1
    table = estimates(spark, fit, ["(Intercept)", "a", "b", "a:b"]).collect()
    assert len(table) == 4 + len(random) + len(random) // 2 + (family == "gamma")


def test_recovers_parameters_and_partitions(spark):
    rows = simulate(400, 12, 0.36, "gamma", 3)
    df = spark.createDataFrame(rows, "g string, x array<double>, y double")
    one = fit_mixed(df.repartition(1), "x", "y", "g")
    many = fit_mixed(df.repartition(16), "x", "y", "g")
    np.testing.assert_allclose(one.beta, many.beta, atol=1e-6)
    np.testing.assert_allclose(one.beta, [1.0, 0.5, -0.7, 0.3], atol=0.15)
    assert abs(one.sigma[0, 0] - 0.36) < 0.1 and abs(one.dispersion - 1 / 3) < 0.05


def test_hot_group_and_limits(spark):
    """A group with most rows is summed per design row; bad responses fail."""
    rows = simulate(30, 4, 0.3, "gamma", 1) + [("hot", [1.0, 0.0, 0.0, 0.0], 2.0 + i % 3)
                                               for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y double")
    fit = fit_mixed(df, "x", "y", "g")
    assert fit.n_groups == 31
    effects = {r.g: r for r in fit.effects().collect()}
    assert effects["hot"].n == 2000
    assert abs(np.exp(fit.beta[0] + effects["hot"].u[0]) - 3.0) < 0.02
    with pytest.raises(Exception, match="positive"):
        fit_mixed(df.withColumn("y", F.lit(0.0)), "x", "y", "g")
    with pytest.raises(ValueError, match="no rows"):
        fit_mixed(df.where("false"), "x", "y", "g")
    with pytest.raises(Exception, match="design rows"):
        fit_mixed(df, "x", "y", "g", max_cells=1)
