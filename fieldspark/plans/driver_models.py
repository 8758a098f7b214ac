"""Driver queries of the fitted models, long expansions, densities and files.

Queries with an equivalent DuckDB text are registered with the other driver
queries.  The two iterative mixed-model fits have none; ``QUERIES`` holds them
and ``tests/test_mixed.py`` compares their operators with dense solves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.plans.driver import SURVEY_DATES, draws_table, events, query, rounded
from fieldspark.plans.driver import ORACLE_SQL as DRIVER_SQL
from fieldspark.sources.readers import read_table

QUERIES = {}


def weekend(ts: str = "ts"):
    return F.when(F.dayofweek(ts).isin([1, 7]), "weekend").otherwise("weekday")


# ---- mixed models (M3, M6, M8) ------------------------------------------------

def q_mixed_gamma(spark: SparkSession, base: str) -> DataFrame:
    """Gamma fit of value on type x part of the week with ``(1 | user_id)``."""
    from fieldspark.operators.draws import factor_levels_all, treatment_design
    from fieldspark.operators.mixed import estimates, fit_mixed

    ev = events(spark, base).where(F.col("value") > 0).select(
        "event_type", weekend().alias("part"), "user_id", "value")
    design, terms = treatment_design(ev, factor_levels_all(ev, ["event_type", "part"]))
    return rounded(estimates(spark, fit_mixed(design, "x", "value", "user_id", tolerance=1e-4), terms), 4)


def q_hurdle_mixed(spark: SparkSession, base: str) -> DataFrame:
    """Hurdle-Gamma predictions with correlated intercepts and slopes by species."""
    from fieldspark.operators.draws import factor_levels_all, treatment_design
    from fieldspark.operators.mixed import hurdle_mixed, predict_hurdle

    ev = events(spark, base).select(
        F.col("event_type").alias("species"),
        F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("date2"),
        weekend().alias("prey_stage"), F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("y"))
    factors = factor_levels_all(ev, ["date2", "prey_stage"])
    design, _ = treatment_design(ev, factors)
    fit, zero = hurdle_mixed(design, "x", "y", "species", ["species", "prey_stage"], [0, 1, 2, 3],
                             tolerance=1e-3)
    grid, _ = treatment_design(ev.select("species", "date2", "prey_stage").distinct(), factors)
    return rounded(predict_hurdle(fit, zero, grid, "x", ["species", "prey_stage"]).drop("x"), 4)


QUERIES["mixed_gamma"] = q_mixed_gamma
QUERIES["hurdle_mixed"] = q_hurdle_mixed


# ---- crossed effects (M2) -------------------------------------------------------

_SWEEPS = 30


def _crossed_sql() -> str:
    steps = ["u0 AS (SELECT experiment, 0.0 AS u FROM b)"]
    for k in range(_SWEEPS):
        steps.append(f"""g{k} AS (SELECT taxon, sum(n * (m - u)) / sum(n) AS t
  FROM c JOIN u{k} USING (experiment) GROUP BY taxon),
u{k + 1} AS (SELECT experiment, coalesce(sum(n * (m - t)) / (sum(n) + any_value(ridge)), 0) AS u
  FROM c JOIN g{k} USING (taxon) CROSS JOIN s GROUP BY experiment)""")
    return """
WITH e AS (SELECT event_type AS taxon, CASE WHEN event_type = 'click' AND dayname(CAST(ts AS DATE)) < 'S'
                    THEN 'Rest' ELSE dayname(CAST(ts AS DATE)) END AS experiment,
                  CASE WHEN value > 0 THEN ln(value) END AS v FROM events),
c AS (SELECT taxon, experiment, count(v) AS n, coalesce(avg(v), 0) AS m,
             coalesce(var_pop(v) * count(v), 0) AS ss, count(*) - count(v) AS o FROM e GROUP BY ALL),
tm AS (SELECT taxon, sum(n * m) / sum(n) AS tm FROM c GROUP BY taxon),
b AS (SELECT experiment, sum(n) AS nb, sum(n * (m - tm)) / sum(n) AS e FROM c JOIN tm USING (taxon)
      GROUP BY experiment),
s AS (SELECT s2 / nullif(greatest(vb - s2 * inv, 0), 0) AS ridge FROM (
  SELECT (SELECT sum(ss) / (sum(n) - count(*)) FROM c) AS s2, var_samp(e) AS vb, avg(1.0 / nb) AS inv
  FROM b)),
""" + ",\n".join(steps) + f"""
SELECT taxon, CAST(sum(n) AS BIGINT) AS n, CAST(sum(o) AS BIGINT) AS n_left_out,
       round(sum(n * (m - u)) / sum(n), 6) AS b, round(exp(sum(n * (m - u)) / sum(n)), 6) AS mean
FROM c JOIN u{_SWEEPS} USING (experiment) GROUP BY taxon
"""


@query("experiment_means_joint", _crossed_sql())
def q_experiment_means_joint(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import crossed_means

    day = F.date_format(F.to_date("ts"), "EEEE")  # one taxon pools its days: unbalanced
    ev = events(spark, base).select(
        F.col("event_type").alias("taxon"),
        F.when((F.col("event_type") == "click") & (day < "S"), "Rest").otherwise(day).alias("experiment"),
        "value")
    return rounded(crossed_means(ev, "taxon", "experiment", "value"))


# ---- Gamma shape (M1, M10) ------------------------------------------------------

def _digamma_sql(x: str) -> str:
    z = f"({x} + 8.0)"
    shifts = " - ".join(f"1.0 / ({x} + {i}.0)" for i in range(8))
    return (f"(ln({z}) - 0.5 / {z} - 1.0 / (12 * pow({z}, 2)) + 1.0 / (120 * pow({z}, 4)) "
            f"- 1.0 / (252 * pow({z}, 6)) + 1.0 / (240 * pow({z}, 8)) - {shifts})")


def _trigamma_sql(x: str) -> str:
    z = f"({x} + 8.0)"
    shifts = " + ".join(f"1.0 / pow({x} + {i}.0, 2)" for i in range(8))
    return (f"(1.0 / {z} + 0.5 / pow({z}, 2) + 1.0 / (6 * pow({z}, 3)) - 1.0 / (30 * pow({z}, 5)) "
            f"+ 1.0 / (42 * pow({z}, 7)) - 1.0 / (30 * pow({z}, 9)) + {shifts})")


def _shape_sql(steps: int = 6) -> str:
    out = """
WITH k0 AS (
  SELECT event_type, n, mean, v, s, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS k FROM (
    SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS v,
           ln(avg(value)) - avg(ln(value)) AS s
    FROM events WHERE value > 0 GROUP BY event_type))"""
    for i in range(steps):
        out += f""",
k{i + 1} AS (SELECT event_type, n, mean, v, s, 1.0 / (1.0 / k + (ln(k) - {_digamma_sql('k')} - s)
  / (k * k * (1.0 / k - {_trigamma_sql('k')}))) AS k FROM k{i})"""
    return out + f"""
SELECT event_type, n, round(mean, 6) AS mean, round(k, 6) AS shape,
       round(1.0 / sqrt(n * ({_trigamma_sql('k')} - 1.0 / k)), 6) AS se,
       round(mean * mean / v, 6) AS moment_shape FROM k{steps}
"""


@query("gamma_shape", _shape_sql())
def q_gamma_shape(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import gamma_shape

    return rounded(gamma_shape(events(spark, base).where(F.col("value") > 0), ["event_type"], "value"))


# ---- densities (A19) ------------------------------------------------------------

@query("value_density", """
WITH v AS (SELECT event_type, log10(value) AS v FROM events WHERE value > 0),
q AS (SELECT event_type, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1,
             quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi FROM v GROUP BY event_type),
s AS (SELECT *, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) AS bw FROM q),
p AS (SELECT event_type, n, bw, lo - 3 * bw AS start, (hi - lo + 6 * bw) / 127.0 AS step FROM s),
placed AS (SELECT event_type, (v - start) / step AS place FROM v JOIN p USING (event_type)),
low AS (SELECT event_type, CAST(least(floor(place), 126) AS INTEGER) AS i, place FROM placed),
bins AS (
  SELECT event_type, i, sum(w) AS w FROM (
    SELECT event_type, i, 1 - (place - i) AS w FROM low
    UNION ALL SELECT event_type, i + 1, place - i FROM low) GROUP BY event_type, i),
grid AS (SELECT p.*, CAST(j AS INTEGER) AS j FROM p CROSS JOIN range(0, 128) AS r(j)),
pairs AS (
  SELECT g.event_type, g.j, sum(w / n * exp(-0.5 * pow((g.j - b.i) * step / bw, 2))
                                / (2.5066282746310002 * bw)) AS d
  FROM grid g JOIN bins b ON b.event_type = g.event_type AND abs(g.j - b.i) <= ceil(6 * bw / step)
  GROUP BY g.event_type, g.j)
SELECT event_type, j AS i, round(start + j * step, 6) AS x, round(coalesce(d, 0), 6) AS density,
       round(bw, 6) AS bandwidth, n
FROM grid LEFT JOIN pairs USING (event_type, j)
""")
def q_value_density(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.mathx import log10_pos
    from fieldspark.operators.aggregate import density

    ev = events(spark, base).where(F.col("value") > 0).select("event_type", log10_pos("value").alias("v"))
    return rounded(density(ev, ["event_type"], "v"))


# ---- long expansions (J6, M5) ---------------------------------------------------

def _long_draws(spark: SparkSession, base: str, terms: list[str]) -> DataFrame:
    """``draw, term, coef`` for the first coefficients of each draw."""
    named = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"),
                         F.slice("coef", 1, len(terms)).alias("coef"))
    return draws_table(spark, base).select("draw", F.explode(named).alias("t")).select(
        "draw", "t.term", F.col("t.coef").cast("double").alias("coef"))


def _flag_design(spark: SparkSession, base: str):
    from fieldspark.operators.draws import factor_levels_all, treatment_design
    from fieldspark.operators.joins import complete_grid

    li = read_table(spark, base, "lineitem").select("l_returnflag", "l_linestatus")
    factors = factor_levels_all(li, ["l_returnflag", "l_linestatus"])
    grid = complete_grid(li, list(factors))
    design, terms = treatment_design(grid, factors)
    return grid, design, terms, list(factors)


@query("epred_draws_long", DRIVER_SQL["epred_draws"])
def q_epred_draws_long(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import design_to_long, epred_draws_long

    _, design, terms, cells = _flag_design(spark, base)
    return rounded(epred_draws_long(_long_draws(spark, base, terms),
                                    design_to_long(design, cells, terms), cells))


@query("group_epred_draws", """
WITH g AS (
  SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem)
  CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem)
)
SELECT g.l_returnflag, g.l_linestatus, e.vec_id AS draw,
       round(exp(CAST(e.embedding[1] AS DOUBLE)
         + CAST(e.embedding[4] AS DOUBLE) * CAST(g.l_linestatus = 'O' AS DOUBLE)
         + CAST(e.embedding[CASE g.l_returnflag WHEN 'A' THEN 7 WHEN 'N' THEN 8 ELSE 9 END] AS DOUBLE)
       ), 6) AS epred
FROM g CROSS JOIN embeddings e
""")
def q_group_epred_draws(spark: SparkSession, base: str) -> DataFrame:
    """Main effect of the status, with an effect of each flag as a group."""
    from fieldspark.operators.draws import design_to_long, epred_draws_long, group_terms

    grid, design, terms, cells = _flag_design(spark, base)
    fixed = design_to_long(design, cells, terms, exclude_terms=[1, 2, 4, 5])
    groups = group_terms(grid, cells, "l_returnflag")
    draws = _long_draws(spark, base, [*terms, "r[A]", "r[N]", "r[R]"])
    return rounded(epred_draws_long(draws, fixed.unionByName(groups), cells))


# ---- many-to-many join without a hot task (J2) ---------------------------------

@query("survey_join_split", DRIVER_SQL["nearest_survey_join"])
def q_survey_join_split(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.joins import left_join_suffixed

    ev = events(spark, base).withColumn("date", F.to_date("ts"))
    left = ev.where(F.col("event_type") != "view").select("event_id", "user_id", "date", "value")
    right = (ev.where(F.col("date").isin([F.lit(x).cast("date") for x in SURVEY_DATES]))
             .groupBy("user_id", "date").agg(F.sum("value").alias("value"),
                                             F.count(F.lit(1)).alias("n")))
    out = left_join_suffixed(left, right, ["user_id"], split=64)
    return rounded(out.select("event_id", "user_id", "date_x", "value_x", "date_y", "value_y", "n"))


# ---- files (S1-S5) ----------------------------------------------------------------

@query("csv_round_trip", """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, 'a "' || o_orderstatus || '", b' AS note
FROM orders
""")
def q_csv_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Written with quoted strings and ``NA``, read back with types."""
    from fieldspark.session import scratch_path
    from fieldspark.sources.readers import read_csv_typed
    from fieldspark.sources.sinks import write_csv

    rows = read_table(spark, base, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.to_date("o_orderdate").alias("o_orderdate"),
        F.concat(F.lit('a "'), "o_orderstatus", F.lit('", b')).alias("note"))
    path = scratch_path(spark, "orders-csv")
    write_csv(rows, path, quote_strings=True)
    return read_csv_typed(spark, path, rows.schema)


@query("stage_round_trip", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
""")
def q_stage_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Hand-off partitioned by status; the reader prunes to one partition."""
    from fieldspark.session import scratch_path
    from fieldspark.sources.sinks import read_stage, write_stage

    path = scratch_path(spark, "orders-stage")
    write_stage(read_table(spark, base, "orders"), path, ["o_orderstatus"])
    kept = read_stage(spark, path).where(F.col("o_orderstatus") == "F")
    return rounded(kept.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), total=2)


@query("csv_file_order", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, o_orderkey, o_custkey FROM orders
""")
def q_csv_file_order(spark: SparkSession, base: str) -> DataFrame:
    """Rows written in order to several files, numbered in file order on reading."""
    from fieldspark.session import scratch_path
    from fieldspark.sources.readers import read_csv_numbered
    from fieldspark.sources.sinks import write_csv

    rows = read_table(spark, base, "orders").select("o_orderkey", "o_custkey")
    path = scratch_path(spark, "orders-ordered")
    write_csv(rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return read_csv_numbered(spark, path, rows.schema)
