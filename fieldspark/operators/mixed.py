"""Log-link mixed models: Gamma and Poisson with correlated group effects.

``y ~ x'beta + x_r'u_g`` on the log scale, ``u_g ~ N(0, sigma)``, where ``x_r``
are the columns of the design with group-level effects: the intercept alone
for ``(1 | g)``, several for correlated intercepts and slopes.

The rows of a factorial design are summed per (group, design row) once; a
group is then one row of at most as many cells as the design has rows, and a
hot group has been reduced by the partial aggregate.  An iteration is one
Spark aggregate over the group table: each task finds the modes of its groups'
effects by Newton steps, eliminates them from the normal equations (Schur
complement) and adds up a few design-sized matrices.  Only these sums reach
the driver, whatever the number of groups.  The iteration is penalised
quasi-likelihood: fixed effects and modes solve the penalised score equations,
and the covariance is updated by EM from modes and their curvature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.session import materialized

FAMILIES = ("gamma", "poisson")


@dataclass
class MixedFit:
    """Estimates of a mixed model; ``effects`` has one row per group."""

    beta: np.ndarray
    cov_beta: np.ndarray
    sigma: np.ndarray
    dispersion: float
    random: tuple[int, ...]
    family: str
    n_groups: int
    iterations: int
    converged: bool
    groups: DataFrame = field(repr=False)
    keys: tuple[str, ...] = ()

    def effects(self) -> DataFrame:
        """Modes of the group effects: the group columns, ``n`` and array ``u``."""
        schema = T.StructType([self.groups.schema["__g"], T.StructField("n", T.DoubleType()),
                               T.StructField("u", T.ArrayType(T.DoubleType()))])
        out = self.groups.mapInArrow(_modes_of(self), schema)
        return out.select(*[F.col("__g")[k].alias(k) for k in self.keys], "n", "u")


class _Cells:
    """Flat arrays of the cells of a batch of groups."""

    def __init__(self, batch: pa.RecordBatch, random: Sequence[int]):
        cells = batch["cells"]
        flat = cells.flatten()
        self.x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        self.n, self.y, self.yy = (flat.field(c).to_numpy(zero_copy_only=False)
                                   for c in ("n", "sy", "syy"))
        offsets = cells.offsets.to_numpy()
        self.starts = offsets[:-1] - offsets[0]
        self.of = np.repeat(np.arange(len(cells)), np.diff(offsets))
        self.z = self.x[:, list(random)]

    def per_group(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)


def _modes(c: _Cells, beta, precision, phi: float, family: str, steps: int = 60):
    """Group effects that maximise the penalised likelihood, linear predictor
    and curvature of each group."""
    fixed = c.x @ beta
    u = np.zeros((len(c.starts), c.z.shape[1]))
    zz = np.einsum("ci,cj->cij", c.z, c.z)
    for _ in range(steps):
        eta = fixed + (c.z * u[c.of]).sum(axis=1)
        mu = np.exp(eta)
        if family == "gamma":
            weight, score = c.n / phi, (c.y / mu - c.n) / phi
            curve = np.maximum(c.y / mu, c.n) / phi  # at least the expected one: steps stay short
        else:
            weight, score = c.n * mu, c.y - c.n * mu
            curve = weight
        gradient = c.per_group(c.z * score[:, None]) - u @ precision
        hessian = c.per_group(zz * curve[:, None, None]) + precision
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        step *= np.minimum(1.0, 2.0 / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
        u = u + step
        if np.abs(step).max() < 1e-11:
            break
    eta = fixed + (c.z * u[c.of]).sum(axis=1)
    mu = np.exp(eta)
    weight = c.n / phi if family == "gamma" else c.n * mu
    return u, eta, mu, weight, c.per_group(zz * weight[:, None, None]) + precision


def _statistics(beta, sigma, phi, cov_beta, random, family):
    """Batches of groups -> one array of sums each: normal equations without
    the group effects, second moments of the effects, Pearson's statistic."""
    precision = np.linalg.inv(sigma)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _Cells(batch, random)
            u, eta, mu, w, curvature = _modes(c, beta, precision, phi, family)
            work = eta + (c.y / np.where(c.n > 0, c.n, 1) - mu) / mu
            a = np.einsum("c,ci,cj->ij", w, c.x, c.x)
            b = c.per_group(np.einsum("c,ci,cj->cij", w, c.x, c.z))
            right = (c.x * (w * work)[:, None]).sum(axis=0)
            inside = c.per_group(c.z * (w * work)[:, None])
            inverse = np.linalg.inv(curvature)
            lift = np.einsum("gij,gjk->gik", b, inverse)
            schur = a - np.einsum("gik,gjk->ij", lift, b)
            right = right - np.einsum("gik,gk->i", lift, inside)
            moments = (np.einsum("gi,gj->ij", u, u) + inverse.sum(axis=0)
                       + np.einsum("gik,ij,gjl->kl", lift, cov_beta, lift))
            pearson = (c.yy / mu**2 - 2 * c.y / mu + c.n).sum()
            sums = np.concatenate([schur.ravel(), right, moments.ravel(),
                                   [pearson, c.n.sum(), len(u)]])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()])], names=["s"])

    return run


def _modes_of(fit: MixedFit):
    beta, sigma, phi = fit.beta, fit.sigma, fit.dispersion
    random, family = fit.random, fit.family

    def run(batches):
        precision = np.linalg.inv(sigma)
        for batch in batches:
            if batch.num_rows:
                c = _Cells(batch, random)
                u = _modes(c, beta, precision, phi, family)[0]
                yield pa.RecordBatch.from_arrays(
                    [batch["__g"], pa.array(c.per_group(c.n)), pa.array(u.tolist())],
                    names=["__g", "n", "u"])

    return run


def _accelerated(s0, s1, s2, longest: float):
    """Squared extrapolation of three covariances on the log-Cholesky scale, and
    whether the step had the length ``longest``."""

    def to(s):
        chol = np.linalg.cholesky(s)
        return np.where(np.eye(len(s)) > 0, np.log(np.diag(chol))[None, :], np.tril(chol, -1))

    def back(t):
        chol = np.tril(t, -1) + np.diag(np.exp(np.diag(t)))
        return chol @ chol.T

    t0, t1, t2 = map(to, (s0, s1, s2))
    r, v = t1 - t0, (t2 - t1) - (t1 - t0)
    if not np.abs(v).max() > 0:
        return s2, False
    alpha = -min(max(np.sqrt((r * r).sum() / (v * v).sum()), 1.0), longest)
    return back(t0 - 2 * alpha * r + alpha * alpha * v), alpha == -longest


def fit_mixed(df: DataFrame, x: str, y: str, group: str | Sequence[str],
              random: Sequence[int] = (0,), family: str = "gamma", max_cells: int = 10_000,
              tolerance: float = 1e-6, max_iterations: int = 200) -> MixedFit:
    """Fit ``family(log)`` with fixed effects of the design array ``x`` and
    group effects of its columns ``random`` (0-based; 0 is the intercept).

    Rows with a NULL ``y`` or ``x`` are left out; a NULL group is a group of
    its own.  A Gamma response must be positive, a Poisson response not
    negative: the fit fails at run time otherwise, as it does on a group with
    more than ``max_cells`` distinct design rows (the design is a factorial
    one) and on a table without rows.  A group with a single row is kept and
    shrunken.  If the groups do not differ, ``sigma`` goes to zero.
    """
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    keys = [group] if isinstance(group, str) else list(group)
    v = F.col(y).cast("double")
    wrong = v <= 0 if family == "gamma" else v < 0
    v = F.when(wrong, F.raise_error(F.lit(
        "Gamma response must be positive; add an offset" if family == "gamma"
        else "Poisson response must not be negative"))).otherwise(v)
    cells = (df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
             .select(F.struct(*[F.col(k).alias(k) for k in keys]).alias("__g"),
                     F.col(x).cast("array<double>").alias("x"), v.alias("__y"))
             .groupBy("__g", "x").agg(F.count("__y").cast("double").alias("n"),
                                      F.sum("__y").alias("sy"),
                                      F.sum(F.col("__y") * F.col("__y")).alias("syy")))
    listed = F.collect_list(F.struct("x", "n", "sy", "syy"))
    guarded = F.when(F.count("*") > max_cells, F.raise_error(F.lit(
        f"a group has more than {max_cells} design rows"))).otherwise(listed)
    groups = materialized(cells.groupBy("__g").agg(guarded.alias("cells")))
    start = groups.select(F.explode("cells").alias("c")).agg(
        F.sum("c.sy"), F.sum("c.n"), F.first(F.size("c.x"))).first()
    if start[2] is None:
        raise ValueError("no rows to fit")
    p, random = start[2], tuple(random)
    q = len(random)
    beta, sigma, phi = np.zeros(p), np.eye(q) * 0.25, 1.0
    beta[0] = np.log(start[0] / start[1]) if start[0] > 0 else 0.0
    cov = np.zeros((p, p))
    table = groups.select("cells")

    def step(beta, sigma, phi, cov):
        sums = (table.mapInArrow(_statistics(beta, sigma, phi, cov, random, family), "s array<double>")
                .select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")))
        s = np.array([r.v for r in sorted(sums.collect(), key=lambda r: r.i)])
        schur, right = s[:p * p].reshape(p, p), s[p * p:p * p + p]
        moments = s[p * p + p:-3].reshape(q, q)
        pearson, n, n_groups = s[-3:]
        cov = np.linalg.pinv((schur + schur.T) / 2, hermitian=True)
        new_phi = pearson / max(n - p, 1.0) if family == "gamma" else 1.0
        new_sigma = (moments + moments.T) / (2 * n_groups) + 1e-10 * np.eye(q)
        return cov @ right, new_sigma, max(new_phi, 1e-12), cov, int(n_groups)

    path, converged, done, longest = [sigma], False, 0, 4.0
    for done in range(1, max_iterations + 1):
        new_beta, new_sigma, new_phi, cov, n_groups = step(beta, sigma, phi, cov)
        # A variance far below a thousandth on the log scale no longer matters.
        scale = np.sqrt(np.outer(np.diag(new_sigma), np.diag(new_sigma))) + 1e-3
        moved = max(np.abs(new_beta - beta).max(), np.abs((new_sigma - sigma) / scale).max(),
                    abs(new_phi - phi) / new_phi)
        beta, sigma, phi = new_beta, new_sigma, new_phi
        if moved < tolerance:
            converged = True
            break
        path.append(sigma)
        if len(path) == 3 and done > 4:
            sigma, at_limit = _accelerated(*path, longest)
            longest *= 4.0 if at_limit else 1.0
            path = [sigma]
        elif len(path) == 3:
            path = [sigma]
    return MixedFit(beta, cov, sigma, phi, random, family, n_groups, done, converged, groups,
                    tuple(keys))


def predict_mixed(fit: MixedFit, grid: DataFrame, x: str, group_effects: bool = True,
                  out: str = "epred") -> DataFrame:
    """Expected value of each grid row, with the group effects
    (``re_formula = NULL``) or without (``NA``).  A group that the fit has not
    seen has the effect zero."""
    xs = F.col(x)
    eta = F.lit(0.0)
    for j, b in enumerate(fit.beta):
        eta = eta + xs[j].cast("double") * F.lit(float(b))
    if not group_effects:
        return grid.withColumn(out, F.exp(eta))
    effects = fit.effects().select(*[F.col(k).alias(f"__k_{k}") for k in fit.keys],
                                   F.col("u").alias("__u"))
    same: Column = F.lit(True)
    for k in fit.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = grid.join(effects, same, "left")
    for i, j in enumerate(fit.random):
        eta = eta + xs[j].cast("double") * F.coalesce(F.col("__u")[i], F.lit(0.0))
    return joined.withColumn(out, F.exp(eta)).select(*grid.columns, out)


def hurdle_mixed(df: DataFrame, x: str, y: str, group: str, hu_keys: Sequence[str],
                 random: Sequence[int], **args) -> tuple[MixedFit, DataFrame]:
    """Hurdle-Gamma model whose positive part has correlated group effects.

    The likelihood factorises: the positive values are fitted by ``fit_mixed``
    with group effects of the design columns ``random``; the zero part has the
    group as a fixed factor, so with ``hu_keys`` fully crossed its estimate is
    the share of zeros of each combination (0 without a zero, 1 without a
    positive value).  Returns the fit and ``hu_keys, n_hu, hu``.
    """
    seen = df.where(F.col(y).isNotNull())
    zero = seen.groupBy(*hu_keys).agg(
        F.count(F.lit(1)).alias("n_hu"),
        F.avg(F.when(F.col(y) == 0, 1.0).otherwise(0.0)).alias("hu"))
    return fit_mixed(seen.where(F.col(y) != 0), x, y, group, random, "gamma", **args), zero


def predict_hurdle(fit: MixedFit, zero: DataFrame, grid: DataFrame, x: str, hu_keys: Sequence[str],
                   group_effects: bool = True) -> DataFrame:
    """``mu``, ``hu`` and ``epred = mu * (1 - hu)`` of each grid row; a
    combination of ``hu_keys`` that was never seen has no ``hu`` and no ``epred``."""
    parts = zero.select(*[F.col(k).alias(f"__k_{k}") for k in hu_keys], "hu")
    same: Column = F.lit(True)
    for k in hu_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    mu = predict_mixed(fit, grid, x, group_effects, out="mu")
    return mu.join(parts, same, "left").select(
        *mu.columns, "hu", (F.col("mu") * (F.lit(1.0) - F.col("hu"))).alias("epred"))


def estimates(spark, fit: MixedFit, terms: Sequence[str]) -> DataFrame:
    """``term, estimate, se``: fixed effects, standard deviations and
    correlations of the group effects, dispersion (``se`` NULL for these)."""
    rows = [(t, float(b), float(np.sqrt(max(v, 0.0))))
            for t, b, v in zip(terms, fit.beta, np.diag(fit.cov_beta))]
    sd = np.sqrt(np.diag(fit.sigma))
    names = [terms[j] for j in fit.random]
    rows += [(f"sd({t})", float(s), None) for t, s in zip(names, sd)]
    rows += [(f"cor({names[i]},{names[j]})", float(fit.sigma[i, j] / (sd[i] * sd[j])), None)
             for i in range(len(sd)) for j in range(i)]
    if fit.family == "gamma":
        rows.append(("dispersion", float(fit.dispersion), None))
    return spark.createDataFrame(rows, "term string, estimate double, se double")


__all__ = ["MixedFit", "estimates", "fit_mixed", "hurdle_mixed", "predict_hurdle", "predict_mixed"]
