"""Model operators as Spark jobs.

With the designs used here (intercept-only, group means, fully crossed
factors) the maximum-likelihood expectation of a Gamma or Poisson GLM with
log link in each cell is the cell's sample mean, so fits are group-by
aggregates.  General fixed-effect formulas go to Spark ML's
``GeneralizedLinearRegression`` (distributed IRLS).  Random draws use
hashed uniforms (``fieldspark.functions.random``), so they do not depend on
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions.mathx import inv_logit
from fieldspark.functions.random import hashed_exponential, hashed_gamma, hashed_normal
from fieldspark.operators.joins import expand_with_levels, level_array


# ---- cell-mean fits (M1-M4) ------------------------------------------------

def cell_means(df: DataFrame, keys: Sequence[str], y: str, family: str = "gamma") -> DataFrame:
    """Per-cell log-link GLM fit of a fully crossed design.

    Returns n, mean, sd, the coefficient ``b = ln(mean)`` and its standard
    error.  A Gamma response with a zero or negative value is rejected at
    run time.  For Gamma the dispersion is the cell's squared coefficient of
    variation (``se = sd / (mean * sqrt(n))``); for Poisson ``se =
    1 / sqrt(n * mean)``.  One aggregate with partial aggregation.
    """
    g = df.groupBy(*keys).agg(F.count(F.col(y)).alias("n"), F.avg(y).alias("mean"),
                              F.stddev_samp(y).alias("sd"), F.min(y).alias("__min"))
    b = F.when(F.col("mean") > 0, F.log(F.col("mean")))
    if family == "gamma":
        # A Gamma response must be positive: fail in the same aggregate rather
        # than fit a non-positive cell (offset the response first, e.g. +0.01).
        b = F.when(F.col("__min") <= 0, F.raise_error(
            F.lit("Gamma response must be positive; add an offset"))).otherwise(b)
    g = g.withColumn("b", b).drop("__min")
    if family == "gamma":
        se = F.try_divide(F.col("sd"), F.col("mean") * F.sqrt(F.col("n")))
    elif family == "poisson":
        se = F.try_divide(F.lit(1.0), F.sqrt(F.col("n") * F.col("mean")))  # NULL for all zeros
    else:
        raise ValueError(f"unknown family {family}")
    return g.withColumn("se", se)


def glm_fit(df: DataFrame, formula: str, family: str = "gamma", link: str = "log",
            max_iter: int = 50):
    """Fit a fixed-effect GLM with Spark ML (IRLS); returns the fitted model.

    Factors are coded with the alphabetically first level as reference,
    as in R's default contrasts (RFormula drops the *last* indexed level,
    so levels are indexed in descending order).
    """
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    rf = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc")
    prepared = rf.fit(df).transform(df)
    glr = GeneralizedLinearRegression(family=family, link=link, maxIter=max_iter,
                                      solver="irls")
    return glr.fit(prepared)


def glm_fit_design(df: DataFrame, x: str, y: str, family: str = "gamma", link: str = "log",
                   max_iter: int = 50):
    """Fit a GLM on an explicit design-vector column (e.g. ``treatment_design``).

    The design's first column is the intercept, as in R's model matrix, so
    interactions are treatment-coded exactly like R (RFormula encodes
    interactions over every level combination).  Spark fits the
    intercept itself (a constant feature column would be zeroed), so the
    first column is dropped from the features.  Returns the coefficient
    list in design order, intercept first.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    feats = F.slice(F.col(x), 2, F.size(F.col(x)) - 1)
    prepared = df.select(array_to_vector(feats).alias("features"), F.col(y).alias("label"))
    glr = GeneralizedLinearRegression(family=family, link=link, maxIter=max_iter, solver="irls")
    model = glr.fit(prepared)
    return [float(model.intercept)] + [float(v) for v in model.coefficients]


def hurdle_means(df: DataFrame, y: str, mu_keys: Sequence[str], hu_keys: Sequence[str]) -> DataFrame:
    """Hurdle-Gamma expectation per cell: ``epred = mu * (1 - hu)``.

    The likelihood factorises: ``hu`` is the share of zeros at the grain
    of the zero part (``hu_keys``), ``mu`` the mean of positive values at
    the grain of the positive part (``mu_keys``, which must contain
    ``hu_keys``).  One aggregate at the finer grain carries the counts; the
    zero share is summed over the small aggregated table with a window, so
    the input is scanned once.
    """
    if not set(hu_keys) <= set(mu_keys):
        raise ValueError("hu_keys must be a subset of mu_keys")
    pos = F.col(y) > 0
    g = df.groupBy(*mu_keys).agg(
        F.avg(F.when(pos, F.col(y))).alias("mu"), F.count(F.when(pos, F.lit(1))).alias("n_pos"),
        F.count(F.when(F.col(y) == 0, F.lit(1))).alias("__z"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*hu_keys)
    out = (g.withColumn("n_hu", F.sum("__n").over(w))
           .withColumn("hu", F.sum("__z").over(w) / F.col("n_hu"))
           .drop("__z", "__n"))
    return out.withColumn("epred", F.col("mu") * (F.lit(1.0) - F.col("hu")))


def shrunken_means(df: DataFrame, group: str, y: str, log_scale: bool = True) -> DataFrame:
    """Empirical-Bayes group means (partial pooling of ``(1 | group)``).

    On ``ln(y)`` (or ``y``): per group n, mean and sum of squared deviations;
    pooled within-group variance ``s2``; between-group variance ``t2 =
    max(var(means) - s2 * mean(1/n), 0)``; grand mean ``m`` of the group
    means.  The shrunken mean is ``m + w * (mean - m)`` with ``w = t2 /
    (t2 + s2 / n)`` (0 when ``t2 = 0``: full pooling).  If every group has one
    row there is no within-group variance to estimate and ``w`` and the
    shrunken means are NULL.  ``n_left_out`` counts the group's rows that have
    no value on this scale (NULL, or not positive with ``log_scale``).  The
    global statistics are one 1-row aggregate over the per-group table.
    """
    v = F.when(F.col(y) > 0, F.log(F.col(y))) if log_scale else F.col(y).cast("double")
    base = df.select(F.col(group), v.alias("__v"))
    g = base.groupBy(group).agg(F.count("__v").alias("n"), F.avg("__v").alias("ybar"),
                                (F.var_pop("__v") * F.count("__v")).alias("ss"),
                                (F.count(F.lit(1)) - F.count("__v")).alias("n_left_out"))
    used = F.when(F.col("n") > 0, F.col("n"))
    stats = g.agg(F.struct(
        F.try_divide(F.sum("ss"), F.sum("n") - F.count(used)).alias("s2"),
        F.var_samp("ybar").alias("vb"),
        F.avg(F.lit(1.0) / used).alias("inv_n"),
        F.avg("ybar").alias("m"),
    ).alias("s")).scalar()
    t2 = stats["vb"] - stats["s2"] * stats["inv_n"]
    w = F.when(t2 > 0, t2 / (t2 + stats["s2"] / used)).when(t2 <= 0, F.lit(0.0))
    out = g.withColumn("w", w).withColumn("shrunk", stats["m"] + F.col("w") * (F.col("ybar") - stats["m"]))
    if log_scale:
        out = out.withColumn("shrunk_exp", F.exp(F.col("shrunk")))
    return out.drop("ss")


def means_with_block_effects(df: DataFrame, group: str, block: str, y: str) -> DataFrame:
    """Group means on the log scale with random block intercepts (M2).

    ``ln(y) = b_group + u_block + e``: block effects are the mean deviations
    from the group means, shrunken by ``w = t2 / (t2 + s2 / n)`` as in
    ``shrunken_means``, and the group coefficients are the means of what
    remains.  Everything after the first aggregate works on one row per
    (group, block).  Values that are NULL or not positive are left out and
    counted per group.  Returns ``group, n, n_left_out, b, mean``.
    """
    v = F.when(F.col(y) > 0, F.log(F.col(y)))
    cells = df.select(F.col(group), F.col(block), v.alias("__v")).groupBy(group, block).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("m"),
        (F.var_pop("__v") * F.count("__v")).alias("ss"),
        (F.count(F.lit(1)) - F.count("__v")).alias("out"))
    by = Window.partitionBy(group)
    cells = cells.withColumn("t", F.sum(F.col("n") * F.col("m")).over(by)
                             / F.nullif(F.sum("n").over(by), F.lit(0)))
    blocks = cells.groupBy(F.col(block).alias("__b")).agg(
        F.sum("n").alias("nb"), F.try_divide(F.sum(F.col("n") * (F.col("m") - F.col("t"))),
                                            F.sum("n")).alias("e"))
    within = cells.agg(F.try_divide(F.sum("ss"), F.sum("n") - F.count(F.nullif("n", F.lit(0))))).scalar()
    stats = blocks.agg(F.struct(F.var_samp("e").alias("vb"),
                                F.avg(F.try_divide(F.lit(1.0), F.col("nb"))).alias("inv"))).scalar()
    t2 = F.greatest(stats["vb"] - within * stats["inv"], F.lit(0.0))
    effect = blocks.select("__b", (F.coalesce(F.try_divide(t2, t2 + F.try_divide(within, F.col("nb"))),
                                              F.lit(0.0)) * F.col("e")).alias("u"))
    rest = cells.join(effect, F.col(block).eqNullSafe(F.col("__b")), "left")
    out = rest.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum("out").alias("n_left_out"),
        F.try_divide(F.sum(F.col("n") * (F.col("m") - F.coalesce("u", F.lit(0.0)))),
                     F.sum("n")).alias("b"))
    return out.withColumn("mean", F.exp("b"))


def crossed_means(df: DataFrame, group: str, block: str, y: str, tolerance: float = 1e-10,
                  max_iterations: int = 100) -> DataFrame:
    """Group means with crossed random block intercepts, solved jointly (M2).

    ``ln(y) = b_group + u_block + e`` as in ``means_with_block_effects``, with
    its variance estimates, but ``b`` and ``u`` solve the crossed penalised
    normal equations together, so an unbalanced layout is not biased.  Groups
    are eliminated; conjugate gradients find the block effects.  A product
    with the matrix is two joins and two sums over the (group, block) table;
    blocks and groups stay distributed and only two numbers per iteration
    reach the driver.  Without variance between blocks ``u`` is zero.

    Returns ``group, n, n_left_out, b, mean``.  NULL keys are keys of their own.
    """
    from fieldspark.session import materialized

    v = F.when(F.col(y) > 0, F.log(F.col(y)))
    cells = materialized(df.select(
        F.struct(F.col(group).alias("k")).alias("__g"), F.struct(F.col(block).alias("k")).alias("__b"),
        v.alias("__v")).groupBy("__g", "__b").agg(
        F.count("__v").cast("double").alias("n"), F.coalesce(F.avg("__v"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("__v") * F.count("__v"), F.lit(0.0)).alias("ss"),
        (F.count(F.lit(1)) - F.count("__v")).alias("out")))

    def centred(value: Column) -> DataFrame:
        """``n * (value - mean of its group)`` summed per block: ``__b, w``."""
        sums = cells_with.withColumn("__x", value)
        means = sums.groupBy("__g").agg(F.try_divide(F.sum(F.col("n") * F.col("__x")), F.sum("n"))
                                        .alias("__t")).withColumnRenamed("__g", "__h")
        return (sums.join(means, F.col("__g") == F.col("__h"))
                .groupBy(F.col("__b").alias("__c")).agg(
                    F.sum(F.col("n") * (F.col("__x") - F.coalesce("__t", F.lit(0.0)))).alias("w")))

    cells_with = cells
    blocks = cells.groupBy("__b").agg(F.sum("n").alias("nb")).where("nb > 0")
    start = blocks.join(centred(F.col("m")), F.col("__b") == F.col("__c")).select(
        "__b", "nb", F.col("w").alias("r"), (F.col("w") / F.col("nb")).alias("e"))
    start = materialized(start)
    within = cells.agg(F.try_divide(F.sum("ss"), F.sum("n") - F.count(F.nullif("n", F.lit(0.0))))).first()[0]
    between, inverse = start.agg(F.var_samp("e"), F.avg(F.lit(1.0) / F.col("nb"))).first()
    t2 = max((between or 0.0) - (within or 0.0) * (inverse or 0.0), 0.0)
    state = start.select("__b", "nb", F.lit(0.0).alias("u"), "r")
    if t2 > 0:
        ridge = (within or 0.0) / t2
        inverse_diagonal = F.lit(1.0) / (F.col("nb") + F.lit(ridge))
        state = materialized(state.withColumn("p", F.col("r") * inverse_diagonal))
        rz = first = state.agg(F.sum(F.col("r") * F.col("r") * inverse_diagonal)).first()[0] or 0.0
        for _ in range(max_iterations):
            if rz <= tolerance * tolerance * first or rz == 0.0:
                break
            cells_with = cells.join(state.select(F.col("__b").alias("__d"), "p"),
                                    F.col("__b") == F.col("__d"))
            product = centred(F.col("p"))
            ap = state.join(product, F.col("__b") == F.col("__c")).withColumn(
                "a", F.col("w") + F.lit(ridge) * F.col("p"))
            ap = materialized(ap.select("__b", "nb", "u", "r", "p", "a"))
            alpha = rz / ap.agg(F.sum(F.col("p") * F.col("a"))).first()[0]
            moved = ap.withColumns({"u": F.col("u") + F.lit(alpha) * F.col("p"),
                                    "r": F.col("r") - F.lit(alpha) * F.col("a")})
            new = moved.agg(F.sum(F.col("r") * F.col("r") * inverse_diagonal)).first()[0]
            state = moved.select("__b", "nb", "u", "r", (
                F.col("r") * inverse_diagonal + F.lit(new / rz) * F.col("p")).alias("p"))
            rz = new
    rest = cells.join(state.select(F.col("__b").alias("__d"), "u"), F.col("__b") == F.col("__d"), "left")
    out = rest.groupBy("__g").agg(
        F.sum("n").cast("long").alias("n"), F.sum("out").alias("n_left_out"),
        F.try_divide(F.sum(F.col("n") * (F.col("m") - F.coalesce("u", F.lit(0.0)))), F.sum("n")).alias("b"))
    return out.select(F.col("__g.k").alias(group), "n", "n_left_out", "b", F.exp("b").alias("mean"))


def gamma_shape(df: DataFrame, keys: Sequence[str], y: str, steps: int = 6) -> DataFrame:
    """Gamma shape per group by maximum likelihood.

    The shape ``k`` solves ``ln(k) - digamma(k) = ln(mean(y)) - mean(ln(y))``:
    one aggregate gives both means, and Newton steps on ``1 / k`` run on one
    row per group.  Returns ``keys, n, mean, shape, se, moment_shape``.  Zero and
    negative values are rejected at run time; a group without variation
    (a single row too) has no finite estimate and gets NULL.
    """
    from fieldspark.functions.mathx import digamma, trigamma

    v = F.when(F.col(y) <= 0, F.raise_error(F.lit("Gamma response must be positive; add an offset"))
               ).otherwise(F.col(y).cast("double"))
    g = df.withColumn("__v", v).groupBy(*keys).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.var_samp("__v").alias("__var"),
        (F.log(F.avg("__v")) - F.avg(F.log("__v"))).alias("__s"))
    s = F.col("__s")
    start = (F.lit(3.0) - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    g = g.withColumn("__k", F.when((s > 1e-12) & (F.col("__var") > 0), start))
    for _ in range(steps):
        k = F.col("__k")
        g = g.withColumn("__k", F.lit(1.0) / (F.lit(1.0) / k + (F.log(k) - digamma(k) - s) / (
            k * k * (F.lit(1.0) / k - trigamma(k)))))
    k = F.col("__k")
    se = F.lit(1.0) / F.sqrt(F.col("n") * (trigamma(k) - F.lit(1.0) / k))
    return g.select(*keys, "n", "mean", k.alias("shape"), se.alias("se"),
                    F.try_divide(F.col("mean") * F.col("mean"), F.col("__var")).alias("moment_shape"))


# ---- draws (M7, M9, M10) ---------------------------------------------------

def draws_from_cells(fit: DataFrame, keys: Sequence[str], n_draws: int, seed: int = 2020,
                     b: str = "b", se: str = "se", max_cells: int = 100_000) -> DataFrame:
    """Coefficient draws from the normal approximation of a cell-means fit.

    For a fully crossed design the coefficients are independent, so draw
    ``k`` of cell ``c`` is ``b_c + se_c * z(c, k)``.  Cells (bounded) are
    exploded onto ``spark.range(n_draws)``, so draws are generated in
    parallel and the output is partitioned by draw.
    """
    spark = fit.sparkSession
    cells = level_array(fit, [*keys, b, se], max_cells)
    draws = spark.range(1, n_draws + 1).withColumnRenamed("id", "draw")
    e = expand_with_levels(draws, cells, [*keys, b, se])
    z = hashed_normal([*keys, "draw"], seed)
    return e.withColumn("coef", F.col(b) + F.col(se) * z) \
        .withColumn("mean", F.exp(F.col("coef"))).drop(b, se)


def pooled_gamma_se(cells: DataFrame) -> DataFrame:
    """Standard errors of ``cell_means`` (Gamma) from one dispersion for all
    cells: Pearson's statistic over the residual degrees of freedom."""
    spread = (F.col("n") - 1) * F.col("sd") * F.col("sd") / (F.col("mean") * F.col("mean"))
    phi = cells.agg(F.try_divide(F.sum(spread), F.sum("n") - F.count(F.lit(1)))).scalar()
    return cells.withColumn("se", F.sqrt(phi / F.col("n")))


def saturated_draws(cells: DataFrame, factors: tuple[str, str], n_draws: int,
                    seed: int = 2020) -> DataFrame:
    """Coefficient draws of a two-factor saturated log-link fit (M7).

    ``cells`` is ``cell_means`` of two fully crossed factors.  In a saturated
    design the cell log-means are independent with standard error ``se`` and
    the coefficients are contrasts of them, so draws of the cells give draws
    with the full covariance of the coefficients: intercept, main effects and
    interactions against the first level of each factor.  Returns ``draw,
    term, coef``; only the cells (design-sized) meet the draws.
    """
    f, s = factors
    drawn = draws_from_cells(cells, [f, s], n_draws, seed).select(
        "draw", F.col(f).cast("string").alias("f"), F.col(s).cast("string").alias("s"),
        F.col("coef").alias("eta"))
    first = drawn.agg(F.struct(F.min("f").alias("f"), F.min("s").alias("s")).alias("x")).scalar()
    w = Window.partitionBy("draw")

    def cell(fc, sc):
        return F.max(F.when((F.col("f") == fc) & (F.col("s") == sc), F.col("eta")))

    base = cell(first["f"], first["s"]).over(w)
    row = F.max(F.when(F.col("s") == first["s"], F.col("eta"))).over(
        Window.partitionBy("draw", "f"))
    col = F.max(F.when(F.col("f") == first["f"], F.col("eta"))).over(
        Window.partitionBy("draw", "s"))
    main_f, main_s = F.col("f") == first["f"], F.col("s") == first["s"]
    term = F.when(main_f & main_s, F.lit("(Intercept)")).when(
        main_s, F.concat(F.lit(f), F.col("f"))).when(main_f, F.concat(F.lit(s), F.col("s"))).otherwise(
        F.concat(F.lit(f), F.col("f"), F.lit(":"), F.lit(s), F.col("s")))
    placed = drawn.withColumns({"__b": base, "__r": row, "__c": col})
    coef = F.when(main_f & main_s, F.col("eta")).when(
        main_f | main_s, F.col("eta") - F.col("__b")).otherwise(
        F.col("eta") - F.col("__r") - F.col("__c") + F.col("__b"))
    return placed.select("draw", term.alias("term"), coef.alias("coef"))


def beta_from_cells(cells: DataFrame, x: str = "x", b: str = "b", max_terms: int = 1000) -> list[float]:
    """MLE coefficients of a fully crossed design from its cell log-means.

    For a saturated design the fitted cell means equal the sample means,
    so ``X_cells beta = b_cells`` is a square system (one row per cell).
    Only the cells (at most ``max_terms``) reach the driver.
    """
    rows = cells.select(x, b).limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError("too many cells for a driver-side solve")
    xm = np.array([r[0] for r in rows], dtype=float)
    bv = np.array([r[1] for r in rows], dtype=float)
    if xm.shape[0] != xm.shape[1]:
        raise ValueError("design is not saturated: use glm_fit_design")
    return [float(v) for v in np.linalg.solve(xm, bv)]


def glm_draws(df: DataFrame, x: str, y: str, n_draws: int, family: str = "gamma",
              link: str = "log", seed: int = 2020, beta: Sequence[float] | None = None) -> DataFrame:
    """Coefficient draws from the full normal approximation of a GLM fit (M7).

    1. ``beta``: the MLE (Spark ML IRLS on the design column ``x``) unless given.
    2. One aggregate over the data assembles the p x p information
       ``X'WX`` (log link: ``W = 1`` for Gamma, ``W = mu`` for Poisson) and
       the Pearson statistic for the Gamma dispersion.  Only these
       p*(p+1)/2 + 2 numbers reach the driver.
    3. On the driver: ``V = phi * inv(X'WX)`` and its Cholesky factor ``L``
       (p x p, bounded by the design).
    4. Draw ``k`` is ``beta + L z_k`` with ``z_k`` hashed normals keyed by
       (draw, term), generated over ``spark.range`` - partition-invariant.

    Returns one row per draw with a ``coef`` array, ready for
    ``epred_draws``.
    """
    if link != "log":
        raise ValueError("only the log link is supported")
    b = list(beta) if beta is not None else glm_fit_design(df, x, y, family, link)
    p = len(b)
    xs = F.col(x)
    eta = None
    for j in range(p):
        t = xs[j] * F.lit(float(b[j]))
        eta = t if eta is None else eta + t
    mu = F.exp(eta)
    w = F.lit(1.0) if family == "gamma" else mu
    aggs = [F.sum(w * xs[i] * xs[j]).alias(f"i{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(((F.col(y) - mu) / mu) ** 2).alias("pearson"), F.count(F.lit(1)).alias("n")]
    r = df.agg(*aggs).first()
    info = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            info[i, j] = info[j, i] = r[f"i{i}_{j}"]
    phi = r["pearson"] / max(r["n"] - p, 1) if family == "gamma" else 1.0
    cov = phi * np.linalg.inv(info)
    chol = np.linalg.cholesky((cov + cov.T) / 2.0)
    spark = df.sparkSession
    draws = spark.range(1, n_draws + 1).withColumnRenamed("id", "draw")
    zs = [hashed_normal(["draw", F.lit(j)], seed, salt=j) for j in range(p)]
    draws = draws.select("draw", *[z.alias(f"z{j}") for j, z in enumerate(zs)])
    coefs = []
    for i in range(p):
        c = F.lit(float(b[i]))
        for j in range(i + 1):
            if chol[i, j] != 0.0:
                c = c + F.lit(float(chol[i, j])) * F.col(f"z{j}")
        coefs.append(c)
    return draws.select("draw", F.array(*coefs).alias("coef"))


def predicted_draws(epred: DataFrame, keys: Sequence[str], shape: float | str, seed: int = 2020,
                    mean_col: str = "epred", out: str = "prediction") -> DataFrame:
    """Gamma-distributed predictions around each expected value.

    ``shape`` is a number or a column; the scale is ``mean / shape``.  Draws
    are column expressions of seed and ``keys``; a NULL, NaN or non-positive
    shape gives NULL.
    """
    sh = F.col(shape) if isinstance(shape, str) else F.lit(float(shape))
    return epred.withColumn(out, hashed_gamma(keys, seed, sh, F.try_divide(F.col(mean_col), sh)))


def prior_grid(spark: SparkSession, n: int, grid: DataFrame, grid_cols: Sequence[str],
               species: DataFrame, species_col: str, first_date, base_stage: str,
               seed: int = 2020, sd: float = 2.0, rate: float = 2.0) -> DataFrame:
    """Prior-predictive simulation of the hurdle diet model (M9).

    A draw has an intercept and one slope for the positive part and the same
    for the zero part, all N(0, sd); species differ by Exp(rate) shifts of the
    intercept and of the three slopes.  The linear predictor is evaluated on
    the indicators of a later date, of the other stage and of both, once for
    each part: ``y`` from the positive part, ``hu`` (inverse logit) from the
    zero part, and their product ``y * (1 - hu)``.
    """
    date_c, stage_c = grid_cols
    names = ("int", "b1", "int_hu", "b1_hu")
    pri = spark.range(1, n + 1).select(F.col("id").alias("iter"), *[
        hashed_normal(["id"], seed, 0.0, sd, salt=i).alias(c) for i, c in enumerate(names)])
    cells = expand_with_levels(pri, level_array(grid, list(grid_cols)), list(grid_cols))
    cells = expand_with_levels(cells, level_array(species, [species_col]), [species_col])
    late = (F.col(date_c) != F.lit(first_date)).cast("int")
    other = (F.col(stage_c) != F.lit(base_stage)).cast("int")
    cells = cells.withColumns({"date_no": F.coalesce(late, F.lit(1)),
                               "prey_stage_no": F.coalesce(other, F.lit(1))})
    cells = cells.withColumn("date_prey_no", F.col("date_no") * F.col("prey_stage_no"))
    keys = ["iter", date_c, stage_c, species_col]
    shifts = ("r_int", "r_slopes1", "r_slopes2", "r_slopes3")
    cells = cells.withColumns({c: hashed_exponential(keys, seed, rate, salt=10 + i)
                               for i, c in enumerate(shifts)})
    indicators = [F.col(c) for c in ("date_no", "prey_stage_no", "date_prey_no")]

    def predictor(intercept, slopes):
        eta = intercept
        for slope, indicator in zip(slopes, indicators):
            eta = eta + slope * indicator
        return eta

    b1 = F.col("b1")
    hu = inv_logit(predictor(F.col("int_hu"), [F.col("b1_hu")] * 3))
    out = cells.withColumns({
        "y_sim": F.exp(predictor(F.col("int"), [b1] * 3)),
        "y_species_sim": F.exp(predictor(F.col("int") + F.col("r_int"),
                                         [b1 + F.col(c) for c in shifts[1:]])),
        "hu_sim": hu})
    return out.withColumns({"y_hu_sim": F.col("y_sim") * (F.lit(1.0) - F.col("hu_sim")),
                            "y_hu_sim_species": F.col("y_species_sim") * (F.lit(1.0) - F.col("hu_sim"))})


def ppc_bins(observed: DataFrame, group: str, y: str, obs_id: str, n_rep: int, lo: float,
             hi: float, n_bins: int, seed: int = 2020) -> DataFrame:
    """Observed vs replicated histogram of log10(y) per group.

    Each group's Gamma fit (mean and moment shape) generates ``n_rep``
    replicated values per observation; both sides are binned the same way
    and counted together.  The replicated side is averaged per replicate, so
    counts are on the observed scale.  A replicated value too small for a
    double falls into the first bin.
    """
    pos = observed.where(F.col(y) > 0).select(group, y, F.col(obs_id).alias("__obs"))
    fit = pos.groupBy(F.col(group).alias("__g")).agg(F.avg(y).alias("__m"),
                                                    F.var_samp(y).alias("__var"))
    fit = fit.withColumn("__shape", F.when(F.col("__var") > 0,
                                           F.col("__m") * F.col("__m") / F.col("__var"))
                         .otherwise(F.lit(1.0)))
    w = (hi - lo) / n_bins

    def binned(c):
        x = F.when(c > 0, F.log10(c)).otherwise(F.lit(float(lo)))
        return F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(0)),
                       F.lit(n_bins - 1)).cast("int")

    rows = pos.join(fit, F.col(group).eqNullSafe(F.col("__g"))).select(
        group, y, "__obs", "__m", "__shape",
        F.explode(F.sequence(F.lit(0), F.lit(n_rep))).alias("rep"))  # 0 is the observed value
    draw = hashed_gamma([group, "__obs", "rep"], seed, F.col("__shape"),
                        F.try_divide(F.col("__m"), F.col("__shape")))
    seen = F.col("rep") == 0
    binned_rows = rows.select(group, seen.alias("__seen"),
                              binned(F.when(seen, F.col(y)).otherwise(draw)).alias("bin"))
    return binned_rows.groupBy(group, "bin").agg(
        F.count(F.when(F.col("__seen"), F.lit(1))).alias("n_obs"),
        (F.count(F.when(~F.col("__seen"), F.lit(1))) / F.lit(float(n_rep))).alias("n_rep_mean"))


def prior_table(priors: DataFrame, model_col: str = "model", order_col: str = "row_id",
                chunk_rows: int = 4096) -> DataFrame:
    """Clean a stacked prior-specification table.

    Blank ``prior``/``coef`` become NULL and ``prior`` is carried down
    within each model in file order, in chunks of ``chunk_rows`` numbers.
    """
    from fieldspark.functions.strings import blank_to_null
    from fieldspark.operators.window import locf

    out = priors.withColumn("prior", blank_to_null("prior")).withColumn("coef", blank_to_null("coef"))
    return locf(out, [model_col], [order_col], ["prior"],
                chunk=F.floor(F.col(order_col) / F.lit(chunk_rows)))


__all__ = [
    "beta_from_cells", "cell_means", "crossed_means", "draws_from_cells", "gamma_shape", "glm_draws", "glm_fit", "glm_fit_design",
    "hurdle_means", "means_with_block_effects", "pooled_gamma_se", "ppc_bins", "predicted_draws", "prior_grid", "prior_table", "saturated_draws",
    "shrunken_means",
]
