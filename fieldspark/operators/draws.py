"""Posterior-draw algebra (J6/M5, F10, A2, A7-A10, A14-A16, R5 on draws).

Physical plan used throughout
-----------------------------
* A draw table holds one row per draw with its coefficient vector
  (``coef`` array<double>), i.e. the wide parameter table.  It is
  repartitioned by ``draw`` once - the cheapest shuffle available, before
  any expansion.
* The prediction grid is small and bounded (runtime guard): it travels as
  one scalar-subquery array and ``explode`` pairs every draw with every cell
  inside the task that holds the draw.  No join, no cross product operator.
* Every later aggregate that groups by ``draw`` (plus other keys) is then
  satisfied by the existing hash partitioning on ``draw``: Spark inserts no
  further exchange until the final summaries across draws, which use
  partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.mathx import safe_divide
from fieldspark.operators.aggregate import quantile_agg
from fieldspark.operators.joins import DEFAULT_MAX_LEVELS
from fieldspark.operators.ranking import group_statistics

DEFAULT_MAX_CELLS = 100_000


# ---- designs -----------------------------------------------------------------

def draws_to_wide(long: DataFrame, terms: Sequence[str], draw: str = "draw", term: str = "term",
                  coef: str = "coef") -> DataFrame:
    """(draw, term, coef) rows -> one row per draw with a coefficient array.

    ``terms`` fixes the position of each coefficient.  A missing term is
    NULL, which makes every prediction that uses it NULL.
    """
    cols = [F.first(F.when(F.col(term) == F.lit(t), F.col(coef)), ignorenulls=True)
            for t in terms]
    return long.groupBy(draw).agg(F.array(*cols).cast("array<double>").alias(coef))


def cell_means_design(grid: DataFrame, cells: Sequence[str], n_terms: int,
                      x: str = "x", carry: Sequence[str] = ()) -> DataFrame:
    """One-hot design: cell ``i`` (in sorted key order) uses coefficient ``i``.

    This is the full-factorial model in cell-means coding.  The sorted cell
    list is one scalar subquery; the design rows (cell keys, index, one-hot
    vector) are generated from it on a one-row relation, so nothing is
    computed per input row.  Fails at run time if there are more cells
    than coefficients.  ``carry`` columns (functions of the cell, e.g. an
    abundance) are kept on the design rows.
    """
    from fieldspark.operators.joins import level_array

    levels = level_array(grid, [*cells, *carry], n_terms)

    spark = grid.sparkSession
    rows = spark.range(1).select(F.posexplode(levels).alias("cell_index", "__s"))
    onehot = F.transform(F.sequence(F.lit(0), F.lit(n_terms - 1)),
                         lambda j: F.when(j == F.col("cell_index"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select(*[F.col("__s")[c].alias(c) for c in [*cells, *carry]],
                       F.col("cell_index").cast("int").alias("cell_index"), onehot.alias(x))


def factor_levels(df: DataFrame, col: str, max_levels: int = 1000) -> list:
    """Sorted distinct values of a factor column, for building a design.

    The design's dummy columns are expressions written per level, so the
    levels are needed when the plan is built (as for ``pivot`` without
    explicit values).  Only up to ``max_levels + 1`` distinct values reach
    the driver; more is an error (not a factor).
    """
    rows = df.select(col).distinct().orderBy(col).limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return [r[0] for r in rows]


def factor_levels_all(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict:
    """``factor_levels`` for several columns (each a bounded distinct)."""
    return {c: factor_levels(df, c, max_levels) for c in cols}


def treatment_design(grid: DataFrame, factors: Mapping[str, Sequence[str]],
                     x: str = "x") -> tuple[DataFrame, list[str]]:
    """Full-factorial treatment-coded design for factors with known levels.

    The first level of each factor is the reference.  Terms are the
    intercept, then main effects, then interactions of increasing order,
    each in factor order - the column order of ``a*b`` model matrices.
    Returns the grid with an ``x`` array and the term names.
    """
    from itertools import combinations, product

    names = list(factors)
    dummies = {f: [(lv, F.when(F.col(f) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)))
                   for lv in list(factors[f])[1:]] for f in names}
    terms: list[str] = ["(Intercept)"]
    exprs: list[Column] = [F.lit(1.0)]
    for order in range(1, len(names) + 1):
        for combo in combinations(names, order):
            for picks in product(*[dummies[f] for f in combo]):
                terms.append(":".join(f"{f}{lv}" for f, (lv, _) in zip(combo, picks)))
                e = F.lit(1.0)
                for _, d in picks:
                    e = e * d
                exprs.append(e)
    return grid.withColumn(x, F.array(*exprs)), terms


# ---- expansion ---------------------------------------------------------------

def _inverse_link(link: str):
    return {"log": F.exp, "identity": lambda v: v,
            "logit": lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v))}[link]


def epred_draws(draws: DataFrame, design: DataFrame, cells: Sequence[str], draw: str = "draw",
                coef: str = "coef", x: str = "x", link: str = "log", out: str = "epred",
                carry: Sequence[str] = (), max_cells: int = DEFAULT_MAX_CELLS,
                linpred: str | None = None, exclude_terms: Sequence[int] = (),
                hurdle_coef: str | None = None) -> DataFrame:
    """Expected value of every grid cell under every draw.

    ``eta = sum_j x_j * coef_j`` over the cell's design vector, then the
    inverse link (``log`` -> ``exp``, ``logit``, ``identity``).  Columns in
    ``carry`` (e.g. an abundance already attached to the grid) ride along.
    Output is partitioned by ``draw``.

    The design vector is turned into its non-zero (index, value) pairs once
    per cell, on the small grid, and every one of them is summed per (draw,
    cell).  A NULL or missing coefficient in a used term makes the prediction
    NULL.  ``exclude_terms`` (0-based positions) drops terms from every cell,
    e.g. group-level effects for predictions without them (``re_formula = NA``).

    With ``hurdle_coef`` (a second coefficient array) the model is a hurdle
    one: ``mu`` and ``hu`` (inverse logit of the zero part) are kept as
    columns and the expected value is ``mu * (1 - hu)``.
    """
    from fieldspark.operators.joins import level_array

    excluded = F.array(*[F.lit(int(t)) for t in exclude_terms]) if exclude_terms else None
    nz = F.filter(F.transform(F.sequence(F.lit(0), F.size(F.col(x)) - F.lit(1)),
                              lambda j: F.struct(j.alias("j"), F.col(x)[j].alias("v"))),
                  (lambda t: (t["v"] != F.lit(0.0)) & ~F.array_contains(excluded, t["j"]))
                  if excluded is not None else (lambda t: t["v"] != F.lit(0.0)))
    sparse = design.select(*cells, *carry, nz.alias("__nz"))
    cell_arr = level_array(sparse, [*cells, "__nz", *carry], max_cells)
    # An explicit partition count: AQE sizes an unnumbered repartition by its
    # input bytes, and the draw table is tiny next to the expansion it feeds,
    # so it could be coalesced into a single task.
    n_parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = [coef, hurdle_coef] if hurdle_coef else [coef]
    d = draws.select(F.col(draw), *[F.col(c).alias(f"__c_{c}") for c in arrays]).repartition(
        n_parts, draw)
    e = d.select(draw, *[f"__c_{c}" for c in arrays], F.explode(cell_arr).alias("__c"))
    pairs = F.col("__c")["__nz"]

    def eta(column: str) -> Column:
        coefs = F.col(f"__c_{column}")
        return F.aggregate(pairs, F.lit(0.0), lambda acc, t: acc + t["v"] * F.get(
            coefs, t["j"]).cast("double"))

    cols = [F.col("__c")[c].alias(c) for c in cells] + [F.col(draw)]
    if linpred:
        cols.append(eta(coef).alias(linpred))
    if hurdle_coef:
        cols += [F.exp(eta(coef)).alias("mu"), _inverse_link("logit")(eta(hurdle_coef)).alias("hu")]
        cols += [F.col("__c")[c].alias(c) for c in carry]
        return e.select(*cols).withColumn(out, F.col("mu") * (F.lit(1.0) - F.col("hu")))
    cols.append(_inverse_link(link)(eta(coef)).alias(out))
    cols += [F.col("__c")[c].alias(c) for c in carry]
    return e.select(*cols)


def design_to_long(design: DataFrame, cells: Sequence[str], terms: Sequence[str], x: str = "x",
                   exclude_terms: Sequence[int] = ()) -> DataFrame:
    """Design rows -> one row ``cells, term, x`` per non-zero entry."""
    names = F.array(*map(F.lit, terms))
    e = design.select(*cells, F.posexplode(x).alias("__j", "x"))
    keep = (F.col("x") != 0) & ~F.col("__j").isin(list(exclude_terms))
    return e.where(keep).select(*cells, names[F.col("__j")].alias("term"),
                                F.col("x").cast("double").alias("x"))


def group_terms(cells: DataFrame, keys: Sequence[str], group: str, prefix: str = "r") -> DataFrame:
    """One row per cell for the intercept of its group: term ``r[level]``."""
    level = F.coalesce(F.col(group).cast("string"), F.lit("NA"))
    return cells.select(*keys, F.concat(F.lit(f"{prefix}["), level, F.lit("]")).alias("term"),
                        F.lit(1.0).alias("x"))


def epred_draws_long(draws: DataFrame, design: DataFrame, cells: Sequence[str], draw: str = "draw",
                     link: str = "log", out: str = "epred", block: int = 4096) -> DataFrame:
    """Expected value of every cell under every draw, both sides long.

    ``draws`` has ``draw, term, coef``; ``design`` has ``cells, term, x`` (rows
    with the same cell and term add up).  Neither the grid nor the terms need
    fit anywhere as a whole, so a grid of any size and one term per group
    (predictions with group effects, ``re_formula = NULL``) are expanded alike.
    The join on ``term`` splits hot terms such as the intercept, which every
    cell and every draw has; the products are summed per (cell, draw).

    A cell is predicted for every draw: if one of its coefficients is missing
    or NULL in a draw, the prediction is NULL.  A cell whose terms are all
    absent from the design table cannot appear.
    """
    from fieldspark.operators.joins import split_join

    key = F.struct(*[F.col(c).alias(c) for c in cells])
    rows = design.groupBy(key.alias("__cell"), "term").agg(F.sum("x").alias("x"))
    needed = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__need"))
    # A term that every cell and every draw has, so that no pair is lost.
    marks = needed.select("__cell", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("x"))
    every = draws.select(draw).distinct().select(
        draw, F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("coef"))
    long = draws.where(F.col("term").isNotNull()).select(draw, "term", F.col("coef").cast("double")
                                                         .alias("coef"))
    pairs = split_join(rows.where(F.col("term").isNotNull()).unionByName(marks),
                       long.unionByName(every), ["term"], "inner", block)
    sums = pairs.groupBy("__cell", draw).agg(
        F.sum(F.col("x") * F.col("coef")).alias("__eta"), (F.count("coef") - 1).alias("__have"))
    eta = F.when(F.col("__have") == F.col("__need"), F.col("__eta"))
    return sums.join(needed, "__cell").select(*[F.col("__cell")[c].alias(c) for c in cells], draw,
                                              _inverse_link(link)(eta).alias(out))


def scale_by_abundance(epred: DataFrame, abundance: DataFrame, value: str = "epred",
                       abund: str = "total_abund", out: str = "population_epred",
                       by: Sequence[str] | None = None) -> DataFrame:
    """Left join an abundance table on shared keys and multiply.

    The abundance side has one row per key; Spark broadcasts it when its
    size allows.  When the grid is at hand, attaching abundance to the grid
    before expansion (``carry``) avoids the join entirely.
    """
    from fieldspark.operators.joins import natural_left_join

    j = natural_left_join(epred, abundance, by)
    return j.withColumn(out, F.col(value) * F.col(abund))


def epred_cell_means(draws: DataFrame, grid: DataFrame, cells: Sequence[str],
                     draw: str = "draw", coef: str = "coef", link: str = "log",
                     out: str = "epred", carry: Sequence[str] = (),
                     grid_is_distinct: bool = False,
                     max_cells: int = DEFAULT_MAX_CELLS) -> DataFrame:
    """``epred_draws`` for the cell-means design, in one scalar subquery.

    With one coefficient per cell (cells in sorted key order) the linear
    predictor of cell ``i`` is ``coef[i]``, so the sorted cell list itself
    is exploded with its position: no design table, no second level pass.
    A cell for which a draw has no coefficient is predicted as NULL.
    """
    from fieldspark.operators.joins import level_array

    levels = level_array(grid, [*cells, *carry], max_cells, assume_distinct=grid_is_distinct)
    n_parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = draws.select(F.col(draw), F.col(coef).alias("__coef")).repartition(n_parts, draw)
    e = d.select(draw, "__coef", F.posexplode(levels).alias("__i", "__c"))
    eta = F.get("__coef", F.col("__i")).cast("double")
    return e.select(*[F.col("__c")[c].alias(c) for c in cells], F.col(draw),
                    _inverse_link(link)(eta).alias(out),
                    *[F.col("__c")[c].alias(c) for c in carry])


def thin_draws(df: DataFrame, n: int, draw: str = "draw") -> DataFrame:
    """Keep draws numbered up to ``n`` (deterministic thinning for plots)."""
    return df.where(F.col(draw) <= F.lit(n))


# ---- per-cell reshaping and roll-ups (D9) ---------------------------------

def stage_levels(epred: DataFrame, keys: Sequence[str], stage: str, stages: tuple[str, str],
                 measures: Mapping[str, str], level_col: str = "data_level") -> DataFrame:
    """Pivot two stages to columns for several measures in one aggregate.

    ``measures`` maps a level label (e.g. ``"Per capita"``) to the column
    it sums.  For each label the output has ``stages[0]``, ``stages[1]``
    (missing cells 0), ``total`` and ``prop_pa = first / total`` (NULL when
    the total is 0).  All labels come from one group-by over ``keys``;
    they are stacked by a map-only ``explode``.
    """
    a, b = stages
    aggs = []
    for i, (_, col) in enumerate(measures.items()):
        aggs.append(F.coalesce(F.sum(F.when(F.col(stage) == F.lit(a), F.col(col))), F.lit(0.0))
                    .alias(f"__a{i}"))
        aggs.append(F.coalesce(F.sum(F.when(F.col(stage) == F.lit(b), F.col(col))), F.lit(0.0))
                    .alias(f"__b{i}"))
    wide = epred.groupBy(*keys).agg(*aggs)
    levels = F.array(*[
        F.struct(F.lit(lbl).alias(level_col), F.col(f"__a{i}").alias(a), F.col(f"__b{i}").alias(b))
        for i, lbl in enumerate(measures)
    ])
    st = wide.select(*keys, F.explode(levels).alias("__l"))
    return st.select(*keys, F.col(f"__l.{level_col}").alias(level_col), F.col(f"__l.{a}").alias(a),
                     F.col(f"__l.{b}").alias(b)) \
        .withColumn("total", F.col(a) + F.col(b)) \
        .withColumn(f"prop_{a}", safe_divide(F.col(a), F.col("total")))


def community_rollup(wide: DataFrame, keys: Sequence[str], stages: tuple[str, str] = ("pa", "not_pa"),
                     level: str = "Per community", species_col: str = "species",
                     species_label: str = "Community", level_col: str = "data_level") -> DataFrame:
    """Sum the stage columns over species per ``keys`` (e.g. date, draw), then ratio."""
    a, b = stages
    return (wide.groupBy(*keys)
            .agg(F.sum(a).alias(a), F.sum("total").alias("total"), F.sum(b).alias(b))
            .withColumn(f"prop_{a}", safe_divide(F.col(a), F.col("total")))
            .withColumn(level_col, F.lit(level))
            .withColumn(species_col, F.lit(species_label)))


def to_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """Wide measures -> (name, value) rows.

    Written as an ``explode`` of (name, value) structs rather than
    ``unpivot``: a Generate keeps the input's hash partitioning (by draw),
    an Expand does not, and the aggregates after it would shuffle again.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value))
                      for m in measures])
    e = df.select(*ids, F.explode(pairs).alias("__p"))
    return e.select(*ids, F.col(f"__p.{name}").alias(name), F.col(f"__p.{value}").alias(value))


def species_average(long: DataFrame, level: str, draw: str, species: str, extra: Sequence[str] = (),
                    label: str = "All Species", name: str = "name", value: str = "value") -> DataFrame:
    """Average over species per (level, draw, extra..., name), labelled ``label``.

    NULLs are skipped (``na.rm``).  The per-species means over the remaining
    keys are returned as well (each species' own value where ``extra`` holds
    all of them).

    One aggregate gives sum and count per (level, species, draw, extra,
    name); the all-species mean is the ratio of their sums over a window
    partitioned by the group without species, so it is exact for unequal
    group sizes.  Aggregate and window both key on ``draw`` and reuse the
    draw partitioning; no shuffle and no second pass over the input.
    """
    keys = [level, draw, *extra, name]
    per = long.groupBy(level, species, draw, *extra, name).agg(
        F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(*keys)
    per = (per.withColumn("__as", F.sum("__s").over(w)).withColumn("__an", F.sum("__n").over(w))
           .withColumn("__rn", F.row_number().over(w.orderBy(F.col(species).asc_nulls_first()))))
    out = F.array(
        F.struct(F.col(species).alias(species), F.try_divide(F.col("__s"), F.col("__n")).alias(value)),
        F.when(F.col("__rn") == 1, F.struct(F.lit(label).alias(species),
                                            F.try_divide(F.col("__as"), F.col("__an")).alias(value))))
    e = per.select(*keys, F.explode(out).alias("__o")).where(F.col("__o").isNotNull())
    return e.select(level, F.col(f"__o.{species}").alias(species), draw, *extra, name,
                    F.col(f"__o.{value}").alias(value))


def summarize_draws(long: DataFrame, keys: Sequence[str], value: str = "value",
                    scale: Mapping[str, float] | None = None, name: str = "name",
                    probs: tuple[float, float] = (0.025, 0.975), digits: int | None = 2,
                    strict: bool = True) -> DataFrame:
    """Median, mean, sd and an interval per group of draws, exact at any size.

    ``scale`` multiplies selected measures (by ``name``) before summarising.
    With ``strict`` (R's default) median, mean and sd are NULL when a group
    has a NULL value; the interval bounds skip NULLs (``na.rm = TRUE``).
    """
    v = F.col(value)
    if scale:
        expr = None
        for k, f in scale.items():
            expr = (F.when(F.col(name) == F.lit(k), v * F.lit(float(f))) if expr is None
                    else expr.when(F.col(name) == F.lit(k), v * F.lit(float(f))))
        v = expr.otherwise(v)
    stats = group_statistics(long.withColumn("__value", v), keys, "__value", [0.5, *probs])
    whole = F.col("n") == F.col("n_obs") if strict else F.lit(True)
    out = stats.select(*keys, F.when(whole, F.col("q")[0]).alias("median"),
                       F.when(whole, F.col("mean")).alias("mean"),
                       F.when(whole, F.col("sd")).alias("sd"), F.col("q")[1].alias("lower"),
                       F.col("q")[2].alias("upper"))
    if digits is not None:
        out = out.select(*keys, *[F.round(c, digits).alias(c)
                                  for c in ("median", "mean", "sd", "lower", "upper")])
    return out


def point_interval(df: DataFrame, keys: Sequence[str], value: str,
                   probs: Sequence[float] = (0.025, 0.17, 0.5, 0.83, 0.975),
                   names: Sequence[str] | None = None) -> DataFrame:
    """Median with 66 % and 95 % intervals per cell (``stat_pointinterval``)."""
    names = list(names) if names else [f"q{str(p).split('.')[1].ljust(3, '0')}" for p in probs]
    return quantile_agg(df, keys, value, probs, names)


def cumulative_draws(df: DataFrame, keys: Sequence[str], draw: str, value: str,
                     digits: int = 0) -> DataFrame:
    """Sum ``value`` over everything but ``keys`` within each draw, then mean and sd.

    Adds a formatted ``mean (sd)`` text cell rounded to ``digits``.
    """
    per_draw = df.groupBy(*keys, draw).agg(F.sum(value).alias("__cum"))
    stats = per_draw.groupBy(*keys).agg(F.avg("__cum").alias("mean"),
                                        F.stddev_samp("__cum").alias("sd"))

    def fmt(c: Column) -> Column:
        r = F.round(c, digits)
        return r.cast("bigint").cast("string") if digits == 0 else r.cast("string")

    return stats.withColumn("cell", F.concat(fmt(F.col("mean")), F.lit(" ("), fmt(F.col("sd")),
                                             F.lit(")")))


__all__ = [
    "DEFAULT_MAX_CELLS", "DEFAULT_MAX_LEVELS", "cell_means_design", "community_rollup",
    "cumulative_draws", "draws_to_wide", "epred_cell_means", "epred_draws", "point_interval",
    "scale_by_abundance",
    "species_average",
    "stage_levels", "summarize_draws", "thin_draws", "to_long", "treatment_design",
]
