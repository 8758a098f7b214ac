import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldspark.operators.aggregate import (
    distribution_bins, impute_zero_by_group_mean, lump_rare, proportion_within, quantile_agg,
    rank_by_mean, share_of_total, strict_mean, strict_sum,
)
from fieldspark.operators.joins import (
    complete_grid, expand_grid, inner_join_sorted, left_join_suffixed, natural_left_join,
)
from fieldspark.operators.project import arrange, fill_zero, round_numeric, select_range
from fieldspark.operators.reshape import (
    bind_rows, pivot_wider, unpivot, unpivot_all, unpivot_except, unpivot_range,
)
from fieldspark.operators.window import (
    dense_code, dense_rescale, first_per_key, locf, relevel_key, rescale,
)


# ---- reshape -------------------------------------------------------------------

def test_unpivot_widens_int_double(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "id int, a int, b double")
    out = rows(unpivot(df, ["id"], ["a", "b"]), ["name"])
    assert out == [{"id": 1, "name": "a", "value": 2.0}, {"id": 1, "name": "b", "value": 0.5}]


def test_unpivot_range_and_except(spark):
    df = spark.createDataFrame([("d", "t", 1, 2, 3)], "date string, trt string, x int, y int, z int")
    assert select_range(df, "x", "z") == ["x", "y", "z"]
    r = unpivot_range(df, "x", "y", "taxon", "abundance")
    assert r.columns == ["date", "trt", "z", "taxon", "abundance"] and r.count() == 2
    e = unpivot_except(df, ["date", "trt"], "taxon", "abund")
    assert e.count() == 3


def test_unpivot_all_mixed_types_to_text(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    out = rows(unpivot_all(df), ["key"])
    assert out == [{"key": "n", "value": "1"}, {"key": "s", "value": "a"}]


def test_pivot_round_trip_and_fill(spark):
    long = spark.createDataFrame([(1, "pa", 2.0), (1, "not_pa", 3.0), (2, "pa", 1.0)],
                                 "k int, stage string, v double")
    wide = pivot_wider(long, ["k"], "stage", "v", ["pa", "not_pa"], fill=0.0)
    assert rows(wide, ["k"]) == [{"k": 1, "pa": 2.0, "not_pa": 3.0}, {"k": 2, "pa": 1.0, "not_pa": 0.0}]
    back = unpivot(wide, ["k"], ["pa", "not_pa"], "stage", "v").where("v != 0")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_bind_rows_missing_columns(spark):
    a = spark.createDataFrame([("x", 1.0)], "species string, v double")
    b = spark.createDataFrame([(2.0,)], "v double")
    out = rows(bind_rows(a, b), ["v"])
    assert out == [{"species": "x", "v": 1.0}, {"species": None, "v": 2.0}]


def test_fill_zero_numeric_only_and_round(spark):
    df = spark.createDataFrame([(None, None, 1.234)], "a int, s string, d double")
    r = fill_zero(df).first()
    assert r["a"] == 0 and r["s"] is None
    assert round_numeric(df, 2).first()["d"] == 1.23
    half = spark.createDataFrame([(0.125,)], "d double")
    assert round_numeric(half, 2).first()["d"] == 0.12
    assert round_numeric(half, 2, half_even=False).first()["d"] == 0.13


# ---- aggregate --------------------------------------------------------------------

def test_strict_sum_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, v double")
    out = rows(df.groupBy("g").agg(strict_sum("v").alias("s"), strict_mean("v").alias("m"),
                                   F.sum("v").alias("s2")), ["g"])
    assert out == [{"g": "a", "s": None, "m": None, "s2": 1.0}, {"g": "b", "s": 6.0, "m": 3.0, "s2": 6.0}]


def test_share_of_total_sums_to_one_and_zero_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 4.0)], "k string, v double")
    out = rows(share_of_total(df, ["k"], "v"), ["k"])
    assert [r["proportion"] for r in out] == [5 / 8, 3 / 8]
    assert all(r["global"] == 8.0 for r in out)
    z = spark.createDataFrame([("a", 0.0)], "k string, v double")
    assert share_of_total(z, ["k"], "v").first()["proportion"] is None


def test_lump_rare_keeps_exception(spark):
    df = spark.createDataFrame(
        [(1, "big", 99.0), (1, "tiny", 0.05), (1, "coleo_a", 0.01), (2, "rare", 0.02)],
        "id int, prey_taxon string, mg double")
    out = rows(lump_rare(df, "prey_taxon", "mg", ["id"], 0.001, keep=["coleo_a"]),
               ["id", "prey_taxon_grouped"])
    got = {(r["id"], r["prey_taxon_grouped"]): r["mg"] for r in out}
    assert got == {(1, "big"): 99.0, (1, "coleo_a"): 0.01, (1, "other_unknown"): 0.05,
                   (2, "other_unknown"): 0.02}
    assert all(abs(r["mg01"] - r["mg"] - 0.1) < 1e-12 for r in out)


def test_impute_zero_mean_all_zero_species(spark):
    df = spark.createDataFrame([("bluegill", "d1", 16), ("bluegill", "d2", 0), ("bluegill", "d3", 5),
                                ("gar", "d1", 0), ("gar", "d2", 0)], "species string, d string, raw int")
    out = {(r["species"], r["d"]): r["total_abund"]
           for r in impute_zero_by_group_mean(df, ["species"], "raw").collect()}
    assert out[("bluegill", "d2")] == 7.0 and out[("bluegill", "d1")] == 16.0
    assert out[("gar", "d1")] == 0.0


def test_proportion_within_sums_to_one(spark):
    df = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 3.0), ("s2", "a", 2.0)],
                               "species string, prey string, v double")
    out = proportion_within(df, ["species"], ["prey"], "v")
    tot = {r["species"]: r["t"] for r in out.groupBy("species").agg(F.sum("proportion").alias("t")).collect()}
    assert tot == {"s1": 1.0, "s2": 1.0}


def test_rank_by_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 5.0)], "t string, v double")
    assert [r["t"] for r in rank_by_mean(df, "t", "v").orderBy("level").collect()] == ["b", "c", "a"]


def test_quantiles_type7_and_single_row(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 11)] + [("h", 3.0)], "k string, v double")
    out = {r["k"]: r for r in quantile_agg(df, ["k"], "v", [0.025, 0.5, 0.975], ["lo", "md", "hi"]).collect()}
    assert abs(out["g"]["lo"] - 1.225) < 1e-12 and out["g"]["md"] == 5.5
    assert abs(out["g"]["hi"] - 9.775) < 1e-12
    assert out["h"]["lo"] == out["h"]["hi"] == 3.0
    sd = df.groupBy("k").agg(F.stddev_samp("v").alias("sd")).where("k = 'h'").first()["sd"]
    assert sd is None


def test_distribution_bins(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 1.0), ("a", 1000.0), ("a", 0.0), ("a", 5000.0)],
                               "g string, v double")
    out = {r["bin"]: r["n"] for r in distribution_bins(df, ["g"], "v", -2.0, 3.0, 5).collect()}
    assert out == {0: 1, 2: 1, 4: 2}


def test_empty_table_aggregates(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert share_of_total(df, ["k"], "v").count() == 0
    assert rank_by_mean(df, "k", "v").count() == 0


# ---- joins and grids ----------------------------------------------------------------

def test_natural_left_join_null_keys_match(spark):
    x = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    y = spark.createDataFrame([("a", 10.0), (None, 20.0)], "k string, w double")
    out = rows(natural_left_join(x, y), ["v"])
    assert out == [{"k": "a", "v": 1, "w": 10.0}, {"k": None, "v": 2, "w": 20.0}]


def test_inner_join_sorted_key_first(spark):
    x = spark.createDataFrame([(1, "a")], "v int, taxon string")
    y = spark.createDataFrame([("a", 2.0)], "taxon string, m double")
    assert inner_join_sorted(x, y).columns == ["taxon", "v", "m"]


def test_left_join_suffixed_and_guard(spark):
    x = spark.createDataFrame([(1, "s", 5)], "stat2 int, date string, spid int")
    y = spark.createDataFrame([(1, "e1", 2.0), (1, "e2", 3.0)], "stat2 int, date string, tot double")
    out = left_join_suffixed(x, y, ["stat2"], max_multiplicity=2)
    assert set(out.columns) == {"stat2", "date_x", "spid", "date_y", "tot"} and out.count() == 2
    with pytest.raises(Exception):
        left_join_suffixed(x, y, ["stat2"], max_multiplicity=1).collect()
    xn = spark.createDataFrame([(None, "s", 1)], "stat2 int, date string, spid int")
    yn = spark.createDataFrame([(None, "e", 2.0)], "stat2 int, date string, tot double")
    assert left_join_suffixed(xn, yn, ["stat2"]).first()["tot"] == 2.0


def test_complete_grid_includes_unseen(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 2)], "f string, y int")
    out = {(r["f"], r["y"]) for r in complete_grid(df, ["f", "y"]).collect()}
    assert out == {("a", 1), ("a", 2), ("b", 1), ("b", 2), (None, 1), (None, 2)}


def test_complete_grid_guard(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(Exception):
        complete_grid(df, ["k"], max_levels=10).collect()


def test_expand_grid(spark):
    pri = spark.range(3).withColumnRenamed("id", "iter")
    other = spark.createDataFrame([("d1", "pa"), ("d1", "pa"), ("d2", "not_pa")], "d string, s string")
    assert expand_grid(pri, other).count() == 6


# ---- window ---------------------------------------------------------------------------

def test_locf_leading_nulls_and_chunked_equivalence(spark):
    data = []
    for user in range(3):
        for i in range(40):
            val = None if (i % 3 or i < 4) else f"v{user}_{i}"
            data.append((user, i, i // 7, val))
    df = spark.createDataFrame(data, "u int, t int, day int, p string").repartition(5)
    plain = {(r["u"], r["t"]): r["p"] for r in locf(df, ["u"], ["t"], ["p"]).collect()}
    chunk = {(r["u"], r["t"]): r["p"] for r in locf(df, ["u"], ["t"], ["p"], chunk="day").collect()}
    assert plain == chunk
    assert plain[(0, 0)] is None and plain[(0, 5)] is None and plain[(0, 7)] == "v0_6" and plain[(1, 39)] == "v1_39"


def test_first_per_key_ties_broken(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 1, 1, "y"), ("b", 5, 1, "z")],
                               "k string, t int, id int, v string")
    out = rows(first_per_key(df, ["k"], ["t", "id"]), ["k"])
    assert out == [{"k": "a", "t": 1, "id": 1, "v": "y"}, {"k": "b", "t": 5, "id": 1, "v": "z"}]


def test_dense_code_rescale_single_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    codes = [r["code"] for r in dense_code(df, "c", "code").collect()]
    assert codes == [2, 1, 2, None]
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r["y"] for r in rescale(one, "x", "y", 0.25, 0.75).collect()} == {0.5}
    two = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert sorted(r["y"] for r in rescale(two, "x", "y").collect()) == [0.0, 0.5, 1.0]


def test_dense_rescale_variants_agree(spark):
    df = spark.createDataFrame([("c1", "r1"), ("c1", "r2"), ("c2", "r3"), ("c3", "r1")],
                               "consumer string, resource string")
    spec = {"consumer": ("xend", 0.25, 0.75), "resource": ("x", 0.0, 1.0)}
    a = {(r["consumer"], r["resource"]): (r["xend"], r["x"]) for r in dense_rescale(df, spec).collect()}
    from fieldspark.plans.foodweb import layout

    b = {(r["consumer"], r["resource"]): (r["xend"], r["x"]) for r in layout(df).collect()}
    assert a == b and a[("c2", "r3")] == (0.5, 1.0)
    named = {r["resource"]: r["x"] for r in layout(df, resource_first=["r3", "zz"]).collect()}
    assert named == {"r3": 0.0, "r1": 0.5, "r2": 1.0}


def test_relevel_key(spark):
    df = spark.createDataFrame([("spotfin",), ("bluegill",), ("gar",), ("ash",)], "s string")
    out = {r["s"]: r["lv"] for r in relevel_key(df, "s", ["bluegill", "spotfin"], "lv").collect()}
    assert out == {"bluegill": 1, "spotfin": 2, "ash": 3, "gar": 4}


def test_hot_key_operators_exact(spark):
    """One key holds a third of the rows: chunked LOCF and first-per-key stay exact."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("u"),
        F.col("id").alias("t"), (F.col("id") / 1000).cast("int").alias("day"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("p"),
    ).repartition(16)
    plain = {(r["u"], r["t"]): r["p"] for r in locf(df, ["u"], ["t"], ["p"]).collect()}
    chunk = {(r["u"], r["t"]): r["p"] for r in locf(df, ["u"], ["t"], ["p"], chunk="day").collect()}
    assert plain == chunk
    first = {r["u"]: r["t"] for r in first_per_key(df, ["u"], ["t"]).collect()}
    assert first[0] == 0 and len(first) == 501
    assert first == {r["u"]: r["m"] for r in df.groupBy("u").agg(F.min("t").alias("m")).collect()}


def test_arrange_nulls_last(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "k int, v double")
    assert [r["k"] for r in arrange(df, "-v").collect()] == [3, 1, 2]
    assert [r["k"] for r in arrange(df, "v").collect()] == [1, 3, 2]


def test_number_rows_and_dense_names(spark):
    import random

    from fieldspark.operators.ranking import dense_names, number_rows

    rng = random.Random(1)
    names = [rng.choice("abcé") + str(rng.randrange(40)) for _ in range(300)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    want = {n: i + 1 for i, n in enumerate(sorted({n for n in names if n}, key=str.encode))}
    got = dense_names(df, "name", "code").collect()
    assert {r["name"]: r["code"] for r in got} == want and {r["levels"] for r in got} == {len(want)}
    x = spark.range(1000).select(((F.col("id") * 37) % 101).alias("v"), "id")
    out = number_rows(x, F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], "n").collect()
    assert [(r["v"], r["id"]) for r in sorted(out, key=lambda r: r["n"])] == sorted(
        (r["v"], r["id"]) for r in out)


def test_group_statistics_hot_values_and_nulls(spark):
    """Exact at any size: ties, a group of one value, NULL values and keys."""
    import numpy as np

    from fieldspark.operators.ranking import group_statistics

    rng = np.random.default_rng(4)
    groups = {"ties": rng.integers(0, 3, 900).astype(float), "wide": rng.lognormal(0, 4, 1201),
              "one": np.full(500, 7.0), "single": np.array([2.5]), None: rng.normal(0, 1, 50)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    data += [("ties", None), ("none", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    got = {r["g"]: r for r in group_statistics(df, ["g"], "v", probs).collect()}
    for g, vs in groups.items():
        r = got[g]
        assert np.allclose(r["q"], np.quantile(vs, probs), rtol=1e-12)
        assert np.isclose(r["mean"], vs.mean()) and r["n_obs"] == len(vs)
        assert r["sd"] is None if len(vs) == 1 else np.isclose(r["sd"], vs.std(ddof=1))
    assert got["ties"]["n"] == 901
    assert got["none"]["n"] == 2 and got["none"]["n_obs"] == 0 and got["none"]["q"] == [None] * 6
