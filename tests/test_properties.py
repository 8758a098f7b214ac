"""Property tests (hypothesis): helpers agree with plain-Python references."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspark.functions.strings import replace_first, separate_parts, unite_cols
from fieldspark.operators.aggregate import strict_sum
from fieldspark.operators.window import rescale

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.text(alphabet="ab1_- ", max_size=8)


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=25))
def test_separate_and_replace_first_match_python(spark, strings):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    a, b = separate_parts("s", 2)
    out = {r["i"]: r for r in df.select("i", a.alias("a"), b.alias("b"),
                                        replace_first("s", "_", "-").alias("r"),
                                        unite_cols([a, b]).alias("u")).collect()}
    for i, s in enumerate(strings):
        parts = re.split("[^A-Za-z0-9]+", s)
        exp_b = parts[1] if len(parts) > 1 else None
        assert out[i]["a"] == parts[0] and out[i]["b"] == exp_b
        assert out[i]["r"] == re.sub("_", "-", s, count=1)
        assert out[i]["u"] == f"{parts[0]}_{exp_b if exp_b is not None else 'NA'}"


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-50, 50))),
                min_size=1, max_size=40))
def test_strict_sum_matches_python(spark, rows):
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(strict_sum("v").alias("s")).collect()}
    for g in {r[0] for r in rows}:
        vals = [v for k, v in rows if k == g]
        assert got[g] == (None if any(v is None for v in vals) else sum(vals))


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30),
       st.floats(-5, 5), st.floats(0.1, 5))
def test_rescale_bounds(spark, xs, lo, width):
    hi = lo + width
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    ys = [r["y"] for r in rescale(df, "x", "y", lo, hi).collect()]
    if min(xs) == max(xs):
        assert all(abs(y - (lo + hi) / 2) < 1e-9 for y in ys)
    else:
        assert min(ys) == lo and abs(max(ys) - hi) < 1e-9
        assert all(lo - 1e-9 <= y <= hi + 1e-9 for y in ys)
