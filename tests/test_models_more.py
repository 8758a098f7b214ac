"""Split joins, long expansions, crossed effects, Gamma shape, densities, file
order and round trips on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators.aggregate import density, distribution_bins
from fieldspark.operators.draws import epred_draws_long, group_terms
from fieldspark.operators.joins import left_join_suffixed, split_join
from fieldspark.operators.mixed import hurdle_mixed, predict_hurdle
from fieldspark.operators.models import crossed_means, gamma_shape
from fieldspark.operators.ranking import dense_names
from fieldspark.operators.window import locf
from fieldspark.sources.readers import read_csv_numbered, read_csv_typed
from fieldspark.sources.sinks import read_stage, write_csv, write_stage

from conftest import rows


# ---- split join (J2) -----------------------------------------------------------

def sides(spark):
    """One key holds a third of the rows on both sides; NULL keys, copies."""
    x = [(k % 40 if k % 3 else 7, k) for k in range(600)] + [(None, -1), (None, -1), (99, 1)]
    y = [(k % 40 if k % 3 else 7, f"y{k % 50}") for k in range(300)] + [(None, "n"), (98, "only right")]
    return (spark.createDataFrame(x, "k long, a long"), spark.createDataFrame(y, "k long, b string"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("block", [3, 64, 100_000])
def test_split_join_equals_join(spark, how, block):
    x, y = sides(spark)
    wanted = x.join(y.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, split_join(x, y, ["k"], how, block).collect()), key=key) == \
        sorted(map(tuple, wanted.collect()), key=key)


def test_split_join_deals_out_the_hot_key(spark):
    x, y = sides(spark)
    plan = split_join(x, y, ["k"], block=16)
    n = 16
    counts = plan.where("k = 7").groupBy("a").count()
    assert counts.count() == 200 + 10  # every third row and the other rows of key 7
    per = (plan.sparkSession.createDataFrame(plan.where("k = 7").collect(), plan.schema)
           .groupBy(F.pmod(F.xxhash64("k", "a"), F.lit(math.ceil(210 / n)))).count())
    assert per.count() > 8


def test_split_join_names_and_suffixes(spark):
    x, y = sides(spark)
    with pytest.raises(ValueError, match="clash"):
        split_join(x, x, ["k"])
    a, b = x.withColumnRenamed("a", "v"), y.withColumnRenamed("b", "v")
    out = left_join_suffixed(a, b, ["k"], split=32)
    assert out.columns == ["k", "v_x", "v_y"]
    assert out.count() == left_join_suffixed(a, b, ["k"]).count()


# ---- long expansion (J6, M5) -----------------------------------------------------

def test_long_expansion(spark):
    rng = np.random.default_rng(1)
    n_draws, n_cells = 40, 50
    beta = rng.normal(size=(n_draws, 3))
    groups = {g: rng.normal(size=n_draws) for g in ("a", "b", "NA")}
    draws = [(d, t, float(beta[d, i])) for d in range(n_draws) for i, t in enumerate(("i", "x", "z"))]
    draws += [(d, f"r[{g}]", float(v[d])) for g, v in groups.items() for d in range(n_draws)]
    draws = [r for r in draws if r[:2] != (3, "x")]  # a draw without this coefficient
    design, cells = [], []
    for c in range(n_cells):
        cells.append((c, [None, "a", "b"][c % 3]))
        design += [(c, "i", 1.0)] + ([(c, "x", 0.5 * c)] if c % 2 else [])
    cell_rows = spark.createDataFrame(cells, "cell long, g string")
    long = spark.createDataFrame(design, "cell long, term string, x double").unionByName(
        group_terms(cell_rows, ["cell"], "g"))
    got = {(r.cell, r.draw): r.epred for r in epred_draws_long(
        spark.createDataFrame(draws, "draw long, term string, coef double"), long, ["cell"],
        link="identity", block=8).collect()}
    assert len(got) == n_draws * n_cells
    for (c, d), v in got.items():
        if c % 2 and d == 3:
            assert v is None
        else:
            want = beta[d, 0] + (0.5 * c * beta[d, 1] if c % 2 else 0) + groups[["NA", "a", "b"][c % 3]][d]
            assert abs(v - want) < 1e-9


# ---- crossed effects (M2) --------------------------------------------------------

def test_crossed_means_equal_the_joint_solution(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(6):
        for b in range(12):
            for _ in range((g * 5 + b * 3) % 7 * (b != 11 or g == 0)):  # unbalanced
                data.append((f"g{g}" if g else None, f"b{b}", float(np.exp(
                    0.4 * g + 0.8 * math.sin(b) + 0.3 * rng.standard_normal()))))
    data += [("g1", "b1", None), ("g1", "b1", -1.0)]
    df = spark.createDataFrame(data, "g string, b string, y double").repartition(4)
    got = {r.g: r for r in crossed_means(df, "g", "b", "y").collect()}
    good = [r for r in data if r[2] is not None and r[2] > 0]
    gs, bs = sorted({r[0] for r in good}, key=str), sorted({r[1] for r in good})
    v = np.log([r[2] for r in good])
    gi, bi = (np.array([names.index(r[c]) for r in good]) for c, names in ((0, gs), (1, bs)))
    ss = sum(((v[(gi == g) & (bi == b)] - v[(gi == g) & (bi == b)].mean()) ** 2).sum()
             for g in range(len(gs)) for b in range(len(bs)) if ((gi == g) & (bi == b)).any())
    cells = len({(g, b) for g, b in zip(gi, bi)})
    s2 = ss / (len(v) - cells)
    gm = np.array([v[gi == g].mean() for g in range(len(gs))])
    e = np.array([(v - gm[gi])[bi == b].mean() for b in range(len(bs))])
    nb = np.bincount(bi)
    t2 = e.var(ddof=1) - s2 * (1 / nb).mean()
    x, z = np.eye(len(gs))[gi], np.eye(len(bs))[bi]
    t = np.hstack([x, z])
    pen = np.diag(np.r_[np.zeros(len(gs)), np.full(len(bs), s2 / t2)])
    want = np.linalg.solve(t.T @ t + pen, t.T @ v)
    for i, g in enumerate(gs):
        assert abs(got[g].b - want[i]) < 1e-8
    assert got["g1"].n_left_out == 2 and sum(r.n for r in got.values()) == len(v)


def test_crossed_means_without_block_variance(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", 3.0)],
                               "g string, b string, y double")
    got = {r.g: round(r.mean, 9) for r in crossed_means(df, "g", "b", "y").collect()}
    assert got == {"a": 2.0, "b": 3.0}
    assert crossed_means(df.where("false"), "g", "b", "y").count() == 0


# ---- Gamma shape (M1) ------------------------------------------------------------

def test_gamma_shape_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(2)
    data = [(f"s{s}", float(y)) for s in (0.4, 2.0, 50.0) for y in rng.gamma(s, 3.0 / s, 3000)]
    data += [("one", 2.0), ("same", 5.0), ("same", 5.0), (None, 1.0), (None, 3.0)]
    got = {r.g: r for r in gamma_shape(spark.createDataFrame(data, "g string, y double"), ["g"], "y").collect()}
    for s in (0.4, 2.0, 50.0):
        y = np.array([v for g, v in data if g == f"s{s}"])

        def loglik(k):
            return len(y) * (k * math.log(k / y.mean()) - math.lgamma(k)) + (k - 1) * np.log(y).sum() \
                - k / y.mean() * y.sum()

        k = got[f"s{s}"].shape
        assert loglik(k) >= max(loglik(k * 1.001), loglik(k * 0.999))
        h = k * 1e-4
        slope = (loglik(k + h) - loglik(k - h)) / (2 * h)
        curve = (loglik(k + h) - 2 * loglik(k) + loglik(k - h)) / h**2
        assert abs(slope) < 1e-3 * abs(curve) * k
        assert abs(got[f"s{s}"].se - 1 / math.sqrt(-curve)) < 0.01 * got[f"s{s}"].se
    assert got["one"].shape is None and got["same"].shape is None and got[None].shape > 0
    with pytest.raises(Exception, match="positive"):
        gamma_shape(spark.createDataFrame([("a", 0.0)], "g string, y double"), ["g"], "y").collect()


# ---- density (A19) ---------------------------------------------------------------

def test_density(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(2.0, 1.5, 500)
    data = [("a", float(v)) for v in y] + [(None, float(v) + 9) for v in y] + [("one", 1.0), ("a", None)]
    data += [("same", 4.0)] * 3
    out = rows(density(spark.createDataFrame(data, "g string, v double"), ["g"], "v"), ["g", "i"])
    a = [r for r in out if r["g"] == "a"]
    assert {r["g"] for r in out} == {"a", None, "same"} and len(a) == 128
    iqr = np.subtract(*np.percentile(y, [75, 25]))
    bw = 0.9 * min(y.std(ddof=1), iqr / 1.34) * 500 ** -0.2
    assert abs(a[0]["bandwidth"] - bw) < 1e-9
    for r in a[::9]:
        want = np.exp(-0.5 * ((r["x"] - y) / bw) ** 2).sum() / (500 * bw * math.sqrt(2 * math.pi))
        assert abs(r["density"] - want) < 2e-3
    step = a[1]["x"] - a[0]["x"]
    assert abs(sum(r["density"] for r in a) * step - 1) < 5e-3


# ---- hurdle with group effects (M6) ----------------------------------------------

def test_hurdle_with_group_effects(spark):
    rng = np.random.default_rng(6)
    data = []
    for s in range(30):
        u = rng.multivariate_normal([0, 0], [[0.3, 0.1], [0.1, 0.2]])
        for i in range(20):
            a = i % 2
            y = rng.gamma(4, np.exp(1 + 0.5 * a + u[0] + u[1] * a) / 4)
            zero = s % 3 == 0 and i % 5 == 0
            data.append((f"s{s}", a, [1.0, float(a)], 0.0 if zero else float(y)))
    data.append(("single", 0, [1.0, 0.0], 2.0))
    df = spark.createDataFrame(data, "s string, a int, x array<double>, y double")
    fit, zero = hurdle_mixed(df, "x", "y", "s", ["s", "a"], [0, 1])
    assert fit.converged and fit.n_groups == 31
    grid = spark.createDataFrame([("s0", 0, [1.0, 0.0]), ("s1", 1, [1.0, 1.0]), ("single", 0, [1.0, 0.0]),
                                  ("new", 0, [1.0, 0.0])], "s string, a int, x array<double>")
    got = {r.s: r for r in predict_hurdle(fit, zero, grid, "x", ["s", "a"]).collect()}
    assert abs(got["s0"].hu - 0.2) < 1e-9 and got["s1"].hu == 0.0
    assert abs(got["s0"].epred - got["s0"].mu * 0.8) < 1e-9
    mean = np.mean([y for s, a, _, y in data if s == "s1" and a == 1])
    assert abs(got["s1"].mu / mean - 1) < 0.25
    assert 1.9 < got["single"].mu < 3.5 and got["new"].hu is None and got["new"].epred is None
    assert abs(fit.sigma[0, 0] - 0.3) < 0.2


# ---- NULL keys, names with one prefix ---------------------------------------------

def test_null_keys_and_shared_prefixes(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), (None, 30, None), ("k", 1, "b"),
                                ("k", 31, None)], "k string, t long, v string")
    plain = rows(locf(df, ["k"], ["t"], ["v"]), ["k", "t"])
    assert plain == rows(locf(df, ["k"], ["t"], ["v"], chunk=F.floor(F.col("t") / 10)), ["k", "t"])
    assert {r["v"] for r in plain if r["k"] is None} == {"a"}
    bins = rows(distribution_bins(spark.createDataFrame([(None, 1.0), (None, 10.0), ("a", 5.0)],
                                                        "g string, v double"), ["g"], "v", -1, 2, 6))
    assert all(r["q50"] is not None for r in bins)
    names = [f"Customer#{i:05d}" for i in range(0, 3000, 7)] + ["Customer#"]
    coded = {r.n: r.code for r in dense_names(
        spark.createDataFrame([(n,) for n in names], "n string"), "n", "code").collect()}
    assert [coded[n] for n in sorted(names)] == list(range(1, len(names) + 1))


# ---- files (S1-S5) ----------------------------------------------------------------

def test_file_order(spark, tmp_path):
    """Several files, each read in many splits."""
    for f in range(3):
        lines = [f"{f * 1000 + i},text {f}-{i}" for i in range(200 + 50 * f)]
        (tmp_path / f"part-{f}.csv").write_text("a,b\n" + "\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(size), spark.conf.get(cost)
    wanted = [f * 1000 + i for f in range(3) for i in range(200 + 50 * f)]
    try:
        for bytes_, open_ in (("300b", "1b"), ("1m", "1b")):
            spark.conf.set(size, bytes_)
            spark.conf.set(cost, open_)
            df = read_csv_numbered(spark, str(tmp_path), schema)
            got = sorted((r.row_id, r.a) for r in df.collect())
            assert got == list(enumerate(wanted, 1))
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set(cost, before[1])


def test_round_trips(spark, tmp_path):
    schema = "i long, x double, d date, s string"
    df = spark.createDataFrame([(1, 1.5, None, 'say "hi", you'), (None, None, None, None),
                                (3, -2.0, None, "plain")], schema)
    for quoted in (True, False):
        path = str(tmp_path / f"csv{quoted}")
        write_csv(df, path, quote_strings=quoted)
        key = lambda r: (r[0] is None, r[0])
        assert sorted(map(tuple, read_csv_typed(spark, path, df.schema).collect()), key=key) == \
            sorted(map(tuple, df.collect()), key=key)
    path = str(tmp_path / "stage")
    write_stage(df.withColumn("level", F.col("i")), path, ["level"])
    kept = read_stage(spark, path).where("level = 3")
    assert [r.s for r in kept.collect()] == ["plain"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan
