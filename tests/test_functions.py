import datetime
import math

from conftest import rows
from pyspark.sql import functions as F

from fieldspark.functions import (
    add_fractional_days, blank_to_null, grepl, hashed_exponential, hashed_normal, hashed_uniform,
    in_set, inv_logit, parse_date_any, parse_dmy_mon, parse_mdy, r_ifelse, remove_first,
    replace_all_ordered, replace_first, separate_parts, unite_cols,
)
from fieldspark.functions.strings import snake_case


def test_replace_first_only_first(spark):
    df = spark.createDataFrame([("a_b_c",), (None,), ("abc",)], "s string")
    out = rows(df.select(replace_first("s", "_", "-").alias("r")))
    assert [r["r"] for r in out] == ["a-b_c", None, "abc"]


def test_replace_first_literal_dollar(spark):
    df = spark.createDataFrame([("x1",)], "s string")
    assert df.select(replace_first("s", "x", "$1").alias("r")).first()["r"] == "$11"


def test_replace_all_ordered_sequence_effects(spark):
    df = spark.createDataFrame([("corixid_l",), ("corixidae",), ("zoop",)], "s string")
    rules = [("corixid", "corixidae"), ("zoop", "zooplankton")]
    out = [r["r"] for r in df.select(replace_all_ordered("s", rules).alias("r")).collect()]
    # a rule re-matches text it already produced, as sequential replace-all does
    assert out == ["corixidae_l", "corixidaeae", "zooplankton"]


def test_remove_first(spark):
    df = spark.createDataFrame([("b_taxonChiro",)], "s string")
    assert df.select(F.lower(remove_first("s", "b_taxon")).alias("r")).first()["r"] == "chiro"


def test_separate_edges(spark):
    df = spark.createDataFrame([("chiro",), ("chiro_l_x",), ("chiro_",), ("_l",), (None,),
                                ("chiro-l",)], "s string")
    a, b = separate_parts("s", 2)
    out = [(r["a"], r["b"]) for r in df.select(a.alias("a"), b.alias("b")).collect()]
    assert out == [("chiro", None), ("chiro", "l"), ("chiro", ""), ("", "l"), (None, None),
                   ("chiro", "l")]


def test_unite_null_is_na(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    out = [r["u"] for r in df.select(unite_cols(["x", "y"]).alias("u")).collect()]
    assert out == ["a_NA", "a_b"]


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), ("  ",), ("x",), (None,)], "s string")
    assert [r["b"] for r in df.select(blank_to_null("s").alias("b")).collect()] == \
        [None, None, "x", None]


def test_snake_case():
    assert snake_case("Chiro_larvae") == "chiro_larvae"
    assert snake_case("C CustKey") == "c_cust_key"
    assert snake_case("cAcctBal") == "c_acct_bal"
    assert snake_case("C-MKTSegment") == "c_mkt_segment"
    assert snake_case("...1") == "x1"
    assert snake_case("pH") == "p_h"


def test_parse_mdy_formats(spark):
    df = spark.createDataFrame([("05/28/17",), ("6/2/2017",), ("06/13/95",), ("13/45/2017",),
                                ("junk",), (None,)], "s string")
    out = [r["d"] for r in df.select(parse_mdy("s").alias("d")).collect()]
    assert out == [datetime.date(2017, 5, 28), datetime.date(2017, 6, 2),
                   datetime.date(1995, 6, 13), None, None, None]


def test_parse_other_formats(spark):
    df = spark.createDataFrame([("7-Jun-17", "2017-06-07")], "a string, b string")
    r = df.select(parse_dmy_mon("a").alias("a"), parse_date_any("b").alias("b")).first()
    assert r["a"] == datetime.date(2017, 6, 7) and r["b"] == datetime.date(2017, 6, 7)


def test_add_fractional_days(spark):
    df = spark.createDataFrame([(datetime.date(2017, 6, 13), 0.25), (datetime.date(2017, 6, 13), -0.5)],
                               "d date, k double")
    out = [r["t"] for r in df.select(add_fractional_days("d", F.col("k")).alias("t")).collect()]
    assert out == [datetime.datetime(2017, 6, 13, 6), datetime.datetime(2017, 6, 12, 12)]


def test_r_ifelse_null_test_gives_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    out = [r["y"] for r in df.select(r_ifelse(F.col("x") > 2, "big", "small").alias("y")).collect()]
    assert out == ["small", None, "big"]


def test_in_set_and_grepl_null_false(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    r = rows(df.select(in_set("x", ["a"]).alias("i"), grepl("a", "x").alias("g")))
    assert r == [{"i": True, "g": True}, {"i": False, "g": False}]


def test_inv_logit(spark):
    v = spark.range(1).select(inv_logit(F.lit(0.0)).alias("p")).first()["p"]
    assert v == 0.5


def test_hashed_random_partition_invariant(spark):
    base = spark.range(2000)
    def draw(df):
        return {r["id"]: (r["u"], r["z"], r["e"]) for r in df.select(
            "id", hashed_uniform(["id"], 7).alias("u"), hashed_normal(["id"], 7).alias("z"),
            hashed_exponential(["id"], 7, rate=2.0).alias("e")).collect()}
    a = draw(base.repartition(1))
    b = draw(base.repartition(7))
    assert a == b
    us = [v[0] for v in a.values()]
    zs = [v[1] for v in a.values()]
    es = [v[2] for v in a.values()]
    assert all(0 < u < 1 for u in us)
    assert abs(sum(zs) / len(zs)) < 0.1
    assert abs(math.sqrt(sum(z * z for z in zs) / len(zs)) - 1) < 0.1
    assert abs(sum(es) / len(es) - 0.5) < 0.05
