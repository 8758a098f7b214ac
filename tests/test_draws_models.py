import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldspark.operators.draws import (
    cell_means_design, community_rollup, cumulative_draws, draws_to_wide, epred_cell_means,
    epred_draws,
    point_interval, scale_by_abundance, species_average, stage_levels, summarize_draws,
    thin_draws, to_long, treatment_design,
)
from fieldspark.operators.models import (
    beta_from_cells, cell_means, draws_from_cells, glm_draws, glm_fit,
    glm_fit_design,
    hurdle_means,
    predicted_draws,
    prior_grid, prior_table, shrunken_means,
)


def _draws(spark, n=40, p=6, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, [float(v) for v in rng.normal(0, 0.3, p)]) for i in range(n)]
    return spark.createDataFrame(data, "draw long, coef array<double>"), data


def test_epred_matches_numpy_dense_and_sparse(spark):
    draws, data = _draws(spark)
    grid = spark.createDataFrame([("A", "F"), ("A", "O"), ("N", "F"), ("N", "O")], "f string, s string")
    design, terms = treatment_design(grid, {"f": ["A", "N"], "s": ["F", "O"]})
    assert terms == ["(Intercept)", "fN", "sO", "fN:sO"]
    out = {(r["f"], r["s"], r["draw"]): r["epred"]
           for r in epred_draws(draws, design, ["f", "s"]).collect()}
    for d, c in data:
        assert math.isclose(out[("N", "O", d)], math.exp(c[0] + c[1] + c[2] + c[3]), rel_tol=1e-12)
        assert math.isclose(out[("A", "F", d)], math.exp(c[0]), rel_tol=1e-12)


def test_epred_many_cells_many_terms_and_nulls(spark):
    """200 cells of three and more terms; a missing coefficient gives NULL."""
    rng = np.random.default_rng(2)
    x = (rng.random((200, 30)) < 0.2) * rng.normal(0, 1, (200, 30))
    x[0] = 0.0
    x[1, :3] = [1.0, 2.0, 3.0]
    coefs = [[float(v) for v in rng.normal(0, 0.2, 30)] for _ in range(5)]
    coefs[4][1] = None
    draws = spark.createDataFrame(list(enumerate(coefs)), "draw long, coef array<double>")
    design = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                   "cell int, x array<double>")
    out = {(r["cell"], r["draw"]): r["epred"] for r in epred_draws(draws, design, ["cell"]).collect()}
    assert len(out) == 1000
    for i, row in enumerate(x):
        for d in range(5):
            if d == 4 and row[1] != 0:
                assert out[(i, d)] is None
            else:
                c = np.array([v or 0.0 for v in coefs[d]])
                assert math.isclose(out[(i, d)], math.exp(row @ c), rel_tol=1e-9)
    cells = spark.range(200).withColumnRenamed("id", "cell")
    few = {(r["cell"], r["draw"]): r["epred"] for r in epred_cell_means(draws, cells, ["cell"]).collect()}
    assert len(few) == 1000 and few[(30, 0)] is None and few[(199, 2)] is None
    assert math.isclose(few[(29, 3)], math.exp(coefs[3][29]))


def test_epred_hurdle(spark):
    draws = spark.createDataFrame([(1, [0.1, 0.2], [-1.0, 2.0])],
                                  "draw long, coef array<double>, hu array<double>")
    design = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "k string, x array<double>")
    out = {r["k"]: r for r in epred_draws(draws, design, ["k"], hurdle_coef="hu").collect()}
    hu = 1 / (1 + math.exp(-1.0))
    assert math.isclose(out["b"]["mu"], math.exp(0.3)) and math.isclose(out["b"]["hu"], hu)
    assert math.isclose(out["b"]["epred"], math.exp(0.3) * (1 - hu))


def test_cell_means_design_one_hot(spark):
    draws, data = _draws(spark, p=8)
    grid = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("a", 1)], "sp string, d int")
    design = cell_means_design(grid, ["sp", "d"], 8)
    idx = {(r["sp"], r["d"]): r["cell_index"] for r in design.collect()}
    assert idx == {("a", 1): 0, ("a", 2): 1, ("b", 1): 2}
    out = {(r["sp"], r["d"], r["draw"]): r["epred"]
           for r in epred_draws(draws, design, ["sp", "d"]).collect()}
    for d, c in data:
        assert math.isclose(out[("b", 1, d)], math.exp(c[2]), rel_tol=1e-14)
    fast = {(r["sp"], r["d"], r["draw"]): r["epred"]
            for r in epred_cell_means(draws, grid, ["sp", "d"]).collect()}
    assert fast == out
    with pytest.raises(Exception):
        cell_means_design(grid, ["sp", "d"], 2).collect()


def test_draws_to_wide_missing_term_null(spark):
    long = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3)],
                                 "draw long, term string, coef double")
    out = {r["draw"]: r["coef"] for r in draws_to_wide(long, ["a", "b"]).collect()}
    assert out == {1: [0.1, 0.2], 2: [0.3, None]}


def _posts(spark):
    ep = spark.createDataFrame(
        [("s1", "d1", "pa", 1, 2.0), ("s1", "d1", "not_pa", 1, 6.0), ("s2", "d1", "pa", 1, 1.0),
         ("s1", "d1", "pa", 2, 4.0), ("s1", "d1", "not_pa", 2, 4.0), ("s2", "d1", "not_pa", 2, 0.0)],
        "species string, date2 string, prey_stage string, draw long, epred double")
    ab = spark.createDataFrame([("d1", "s1", 10.0), ("d1", "s2", 100.0)],
                               "date2 string, species string, total_abund double")
    ep = scale_by_abundance(ep, ab)
    wide = stage_levels(ep, ["date2", "species", "draw"], "prey_stage", ("pa", "not_pa"),
                        {"Per capita": "epred", "Per population": "population_epred"})
    comm = community_rollup(wide.where(F.col("data_level") == "Per population"), ["date2", "draw"])
    return wide, comm


def test_stage_levels_fill_and_ratio(spark):
    wide, comm = _posts(spark)
    got = {(r["data_level"], r["species"], r["draw"]): (r["pa"], r["not_pa"], r["total"], r["prop_pa"])
           for r in wide.collect()}
    assert got[("Per capita", "s2", 1)] == (1.0, 0.0, 1.0, 1.0)     # missing stage filled with 0
    assert got[("Per capita", "s2", 2)] == (0.0, 0.0, 0.0, None)    # 0/0 -> NULL, no error
    assert got[("Per population", "s1", 1)] == (20.0, 60.0, 80.0, 0.25)
    c = {r["draw"]: (r["pa"], r["total"], r["species"]) for r in comm.collect()}
    # community = sum of populations
    assert c[1] == (120.0, 180.0, "Community") and c[2] == (40.0, 80.0, "Community")


def test_species_average_and_summary(spark):
    wide, comm = _posts(spark)
    posts = wide.unionByName(comm)
    long = to_long(posts, ["data_level", "species", "date2", "draw"], ["prop_pa", "total"])
    avg = species_average(long, "data_level", "draw", "species")
    a = {(r["data_level"], r["species"], r["draw"], r["name"]): r["value"] for r in avg.collect()}
    assert a[("Per capita", "All Species", 1, "total")] == (8.0 + 1.0) / 2
    assert a[("Per capita", "All Species", 2, "prop_pa")] == 0.5   # NULL skipped
    summ = summarize_draws(avg, ["data_level", "species", "name"], scale={"total": 1000}, digits=None)
    s = {(r["data_level"], r["species"], r["name"]): r for r in summ.collect()}
    r = s[("Per capita", "s1", "total")]
    assert r["mean"] == 8000.0 and r["median"] == 8000.0 and r["sd"] == 0.0
    assert s[("Per capita", "s2", "prop_pa")]["mean"] is None     # strict: a NULL draw -> NULL


def test_summarize_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.gamma(2.0, 3.0, 501)
    df = spark.createDataFrame([("g", "x", float(v)) for v in vals], "k string, name string, value double")
    r = summarize_draws(df, ["k", "name"], digits=None).first()
    assert math.isclose(r["median"], float(np.median(vals)), rel_tol=1e-12)
    assert math.isclose(r["sd"], float(np.std(vals, ddof=1)), rel_tol=1e-9)
    assert math.isclose(r["lower"], float(np.quantile(vals, 0.025)), rel_tol=1e-12)
    assert math.isclose(r["upper"], float(np.quantile(vals, 0.975)), rel_tol=1e-12)
    pi = point_interval(df.withColumnRenamed("value", "epred"), ["k"], "epred").first()
    assert math.isclose(pi["q170"], float(np.quantile(vals, 0.17)), rel_tol=1e-12)


def test_single_draw_and_thin(spark):
    df = spark.createDataFrame([("g", "total", 1, 2.0)], "k string, name string, draw long, value double")
    r = summarize_draws(df, ["k", "name"]).first()
    assert r["sd"] is None and r["median"] == 2.0
    assert thin_draws(spark.range(1, 1001).withColumnRenamed("id", "draw"), 300).count() == 300


def test_cumulative_draws_cell(spark):
    df = spark.createDataFrame([("fish", d, k, float(v)) for d, k, v in
                                [(1, 1, 100), (2, 1, 200), (1, 2, 300), (2, 2, 400)]],
                               "trt string, date int, draw long, v double")
    r = cumulative_draws(df, ["trt"], "draw", "v").first()
    assert r["mean"] == 500.0 and r["cell"] == "500 (283)"


# ---- models ----------------------------------------------------------------------

def _gamma_data(spark):
    rng = np.random.default_rng(5)
    data = []
    for f, mu_f in (("A", 2.0), ("B", 5.0)):
        for s, mu_s in (("x", 1.0), ("y", 3.0)):
            for v in rng.gamma(4.0, mu_f * mu_s / 4.0, 60):
                data.append((f, s, float(v), int(rng.poisson(mu_f * mu_s))))
    return spark.createDataFrame(data, "f string, s string, y double, c int")


def test_cell_means_equal_glm(spark):
    df = _gamma_data(spark)
    design, terms = treatment_design(df, {"f": ["A", "B"], "s": ["x", "y"]})
    cm = {(r["f"], r["s"]): r["b"] for r in cell_means(df, ["f", "s"], "y").collect()}
    b = glm_fit_design(design, "x", "y", "gamma", "log")
    assert terms == ["(Intercept)", "fB", "sy", "fB:sy"]
    assert math.isclose(cm[("A", "x")], b[0], rel_tol=1e-6, abs_tol=1e-6)
    assert math.isclose(cm[("B", "x")], b[0] + b[1], rel_tol=1e-6, abs_tol=1e-6)
    assert math.isclose(cm[("B", "y")], sum(b), rel_tol=1e-6, abs_tol=1e-6)
    pm = {(r["f"], r["s"]): r["b"] for r in cell_means(df, ["f", "s"], "c", "poisson").collect()}
    pb = glm_fit_design(design, "x", "c", "poisson", "log")
    assert math.isclose(pm[("A", "y")], pb[0] + pb[2], rel_tol=1e-6, abs_tol=1e-6)
    main = glm_fit(df, "y ~ f + s", "gamma", "log")   # main effects via RFormula
    assert main.coefficients.size == 2


def test_hurdle_means(spark):
    df = spark.createDataFrame([("a", "d1", 0.0), ("a", "d1", 4.0), ("a", "d2", 2.0), ("a", "d2", 0.0),
                                ("b", "d1", 0.0)], "sp string, d string, y double")
    out = {(r["sp"], r["d"]): r for r in hurdle_means(df, "y", ["sp", "d"], ["sp"]).collect()}
    assert out[("a", "d1")]["hu"] == 0.5 and out[("a", "d1")]["epred"] == 2.0
    assert out[("b", "d1")]["mu"] is None and out[("b", "d1")]["hu"] == 1.0   # all zeros in a cell


def test_shrinkage_limits(spark):
    same = spark.createDataFrame([(g, float(v)) for g in range(4) for v in (1.0, 2.0, 4.0)],
                                 "g int, y double")
    out = rows(shrunken_means(same, "g", "y"), ["g"])
    assert all(r["w"] == 0.0 for r in out)          # no between-group variance: full pooling
    apart = spark.createDataFrame([(g, float(10 ** g) * v) for g in range(4) for v in (1.0, 1.01, 0.99)],
                                  "g int, y double")
    out = rows(shrunken_means(apart, "g", "y"), ["g"])
    assert all(r["w"] > 0.99 for r in out)


def test_shrinkage_is_stable_and_handles_singletons(spark):
    far = spark.createDataFrame([(g, 1e8 + 2 * g + v) for g in range(3) for v in (0.0, 1.0)],
                                "g int, y double")
    w = {r["w"] for r in shrunken_means(far, "g", "y", log_scale=False).collect()}
    # by hand: s2 = 0.5, var(means) = 4, t2 = 4 - 0.5 / 2 = 3.75, w = 3.75 / (3.75 + 0.25)
    assert all(math.isclose(x, 3.75 / 4.0, rel_tol=1e-6) for x in w)
    single = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 0.0), (4, None)], "g int, y double")
    out = rows(shrunken_means(single, "g", "y"), ["g"])
    assert [r["w"] for r in out] == [None] * 4 and [r["n_left_out"] for r in out] == [0, 0, 1, 1]


def test_poisson_all_zero_cell(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 2.0)], "k string, y double")
    out = {r["k"]: r for r in cell_means(df, ["k"], "y", "poisson").collect()}
    assert out["a"]["mean"] == 0.0 and out["a"]["b"] is None and out["a"]["se"] is None


def test_gamma_sampler_moments_and_invariance(spark):
    from fieldspark.functions.random import hashed_gamma

    ids = spark.range(40_000)
    for a in (0.5, 2.0, 9.0):
        r = ids.select(hashed_gamma(["id"], 1, F.lit(a), F.lit(1.0 / a)).alias("x")).agg(
            F.avg("x"), F.var_samp("x")).first()
        assert abs(r[0] - 1.0) < 0.02 and abs(r[1] - 1.0 / a) < 0.08 / a + 0.01
    bad = spark.createDataFrame([(1, None), (2, float("nan")), (3, -1.0), (4, 0.0)], "id long, a double")
    assert {r[0] for r in bad.select(hashed_gamma(["id"], 1, F.col("a"), F.lit(1.0))).collect()} == {None}
    ep = spark.range(3000).select(F.col("id").alias("draw"), F.lit("c").alias("cell"),
                                  F.lit(5.0).alias("epred"))
    a = {r["draw"]: r["prediction"] for r in predicted_draws(ep.repartition(1), ["cell", "draw"], 2.0).collect()}
    b = {r["draw"]: r["prediction"] for r in predicted_draws(ep.repartition(7), ["cell", "draw"], 2.0).collect()}
    assert a == b
    vals = np.array(list(a.values()))
    assert abs(vals.mean() - 5.0) < 0.4 and abs(vals.var() - 12.5) < 2.5


def test_saturated_draws_match_full_covariance(spark):
    from fieldspark.operators.models import pooled_gamma_se, saturated_draws

    df = _gamma_data(spark)
    cells = pooled_gamma_se(cell_means(df, ["f", "s"], "y"))
    out = saturated_draws(cells, ("f", "s"), 3000).toPandas().pivot(index="draw", columns="term",
                                                                    values="coef")
    design, terms = treatment_design(df, {"f": ["A", "B"], "s": ["x", "y"]})
    beta = glm_fit_design(design, "x", "y", "gamma", "log")
    assert set(out.columns) == set(terms)
    assert np.allclose([out[t].mean() for t in terms], beta, atol=0.02)
    full = np.array([r["coef"] for r in glm_draws(design, "x", "y", 3000, "gamma", beta=beta).collect()])
    assert np.allclose(np.cov(out[terms].to_numpy().T), np.cov(full.T), atol=0.003)


def test_draws_from_cells(spark):
    fit = spark.createDataFrame([("A", 1.0, 0.1), ("B", 2.0, 0.5)], "k string, b double, se double")
    d = draws_from_cells(fit, ["k"], 4000)
    s = {r["k"]: (r["m"], r["s"]) for r in d.groupBy("k").agg(F.avg("coef").alias("m"),
                                                              F.stddev("coef").alias("s")).collect()}
    assert abs(s["A"][0] - 1.0) < 0.01 and abs(s["A"][1] - 0.1) < 0.01
    assert abs(s["B"][0] - 2.0) < 0.05 and abs(s["B"][1] - 0.5) < 0.03


def test_prior_grid_shape_and_invariance(spark):
    grid = spark.createDataFrame([("2017-06-13", "pa"), ("2017-06-13", "not_pa"), ("2017-06-23", "pa"),
                                  ("2017-06-23", "not_pa")], "date2 string, prey_stage string")
    sp = spark.createDataFrame([("bluegill",), ("spotfin",)], "species string")
    g1 = prior_grid(spark, 50, grid, ["date2", "prey_stage"], sp, "species", "2017-06-13", "not_pa")
    assert g1.count() == 50 * 4 * 2
    r = g1.where("date2 = '2017-06-13' AND prey_stage = 'not_pa'").first()
    assert r["date_no"] == 0 and r["prey_stage_no"] == 0 and math.isclose(r["y_sim"], math.exp(r["int"]))
    k = ["iter", "date2", "prey_stage", "species"]
    a = {tuple(r[c] for c in k): r["y_hu_sim_species"] for r in g1.repartition(1).collect()}
    b = {tuple(r[c] for c in k): r["y_hu_sim_species"] for r in g1.repartition(5).collect()}
    assert a == b


def test_prior_table_fill(spark):
    df = spark.createDataFrame(
        [(1, "normal(0, 2)", "b", "", "m1"), (2, "", "b", "x", "m1"), (3, "", "sd", "", "m1"),
         (4, "", "b", "", "m2"), (5, "gamma(1, 0.1)", "shape", "", "m2")],
        "row_id long, prior string, class string, coef string, model string")
    out = rows(prior_table(df), ["row_id"])
    assert [r["prior"] for r in out] == ["normal(0, 2)", "normal(0, 2)", "normal(0, 2)", None,
                                         "gamma(1, 0.1)"]
    assert [r["coef"] for r in out] == [None, "x", None, None, None]


def test_glm_draws_full_covariance(spark):
    df = _gamma_data(spark)
    design, _ = treatment_design(df, {"f": ["A", "B"], "s": ["x", "y"]})
    beta = glm_fit_design(design, "x", "y", "gamma", "log")
    cells, _ = treatment_design(cell_means(df, ["f", "s"], "y"), {"f": ["A", "B"], "s": ["x", "y"]})
    assert np.allclose(beta_from_cells(cells), beta, atol=1e-6)   # saturated: solve = IRLS
    d = glm_draws(design, "x", "y", 4000, "gamma", beta=beta)
    coefs = np.array([r["coef"] for r in d.collect()])
    assert coefs.shape == (4000, 4)
    assert np.allclose(coefs.mean(axis=0), beta, atol=0.02)
    # cell (A, x) is the intercept alone: its sd is the cell's log-mean se, sd/(mean*sqrt(n))
    cm = {(r["f"], r["s"]): r for r in cell_means(df, ["f", "s"], "y").collect()}
    se_ax = coefs[:, 0].std(ddof=1)
    assert 0.5 < se_ax / cm[("A", "x")]["se"] < 2.0
    # intercept and the main effect of f are negatively correlated, as in the exact covariance
    assert np.corrcoef(coefs[:, 0], coefs[:, 1])[0, 1] < -0.5
    # draws feed the expansion directly; dropping a term changes only cells that use it
    grid = spark.createDataFrame([("A", "x"), ("B", "y")], "f string, s string")
    gd, _ = treatment_design(grid, {"f": ["A", "B"], "s": ["x", "y"]})
    full = {(r["f"], r["draw"]): r["epred"] for r in epred_draws(d, gd, ["f", "s"]).collect()}
    part = {(r["f"], r["draw"]): r["epred"]
            for r in epred_draws(d, gd, ["f", "s"], exclude_terms=[3]).collect()}
    assert all(full[k] == part[k] for k in full if k[0] == "A")
    assert any(full[k] != part[k] for k in full if k[0] == "B")


def test_summary_null_rule(spark):
    """A NULL draw makes median, mean and sd NULL; the interval skips it."""
    df = spark.createDataFrame([("g", "x", v) for v in (1.0, None, 3.0, 4.0)],
                               "k string, name string, value double")
    r = summarize_draws(df, ["k", "name"], digits=None).first()
    assert r["median"] is None and r["mean"] is None and r["sd"] is None
    assert math.isclose(r["lower"], 1.1) and math.isclose(r["upper"], 3.95)
    assert summarize_draws(df, ["k", "name"], strict=False).first()["median"] == 3.0


def test_conditional_effects(spark):
    from fieldspark.plans.summaries import conditional_effects

    draws, data = _draws(spark, n=200, p=4)
    obs = spark.createDataFrame([("d1", "ctrl"), ("d2", "exc"), ("d1", "exc")], "date string, trt string")
    ce = conditional_effects(draws, obs, {"date": ["d1", "d2"], "trt": ["ctrl", "exc"]})
    out = {(r["date"], r["trt"]): r for r in ce.collect()}
    assert len(out) == 4                                   # (d2, ctrl) unobserved but in the grid
    vals = np.exp([c[0] + c[1] + c[2] + c[3] for _, c in data])
    assert math.isclose(out[("d2", "exc")]["q500"], float(np.median(vals)), rel_tol=1e-12)
    pinned = conditional_effects(draws, obs, {"date": ["d1", "d2"], "trt": ["ctrl", "exc"]},
                                 conditions={"trt": "exc"})
    assert pinned.count() == 2


def test_gamma_rejects_nonpositive(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0)], "k string, y double")
    with pytest.raises(Exception, match="positive"):
        cell_means(df, ["k"], "y").collect()
    offset = df.withColumn("y", F.col("y") + 0.01)
    assert cell_means(offset, ["k"], "y").first()["b"] == pytest.approx(math.log(0.51))
    assert cell_means(df, ["k"], "y", "poisson").first()["mean"] == 0.5
