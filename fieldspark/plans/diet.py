"""Diet pipelines.

Input columns (a diet observation table): ``id`` (fish), ``species``,
``date2``, ``prey_taxon`` (``taxon_stage``), ``mg_diet_dm`` and optionally
``prey_mg_dm``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.conditionals import case_when, in_set
from fieldspark.functions.mathx import safe_divide
from fieldspark.functions.strings import replace_all_ordered, replace_first, separate_parts, unite_cols
from fieldspark.operators.aggregate import lump_rare, strict_sum
from fieldspark.operators.draws import epred_cell_means, epred_draws


def clean_prey_names(dim: DataFrame, drop_species: Sequence[str] = (),
                     species_rules: Sequence[tuple[str, str]] = (),
                     prey_rules: Sequence[tuple[str, str]] = (),
                     stage_rules: Mapping[str, str] | None = None,
                     missing_stage: str = "unknown") -> DataFrame:
    """Name part of D1: drop species, recode species and prey, normalise stage.

    Works on any table with ``species`` and ``prey_taxon``.  When those
    come from a dimension table, apply it to the dimension *before* joining
    the observations: the regular expressions then run once per dimension
    row instead of once per observation.

    ``species_rules`` replace the first match each; ``prey_rules`` are
    replace-all rules applied in order.  ``prey_taxon`` is split on
    non-alphanumerics into taxon and stage; ``stage_rules`` recode stages,
    a missing stage becomes ``missing_stage``, and the two are united again
    with ``_``.
    """
    out = dim
    if drop_species:
        # NOT IN: a NULL species drops the row, as R's filter does; the
        # predicate also reaches the Parquet scan.
        out = out.where(~F.col("species").isin(list(drop_species)))
    sp = F.col("species")
    for pat, rep in species_rules:
        sp = replace_first(sp, pat, rep)
    prey = replace_all_ordered("prey_taxon", list(prey_rules)) if prey_rules else F.col("prey_taxon")
    taxon, stage = separate_parts(prey, 2)
    rules = [(stage == F.lit(k), F.lit(v)) for k, v in (stage_rules or {}).items()]
    stage_n = F.trim(case_when(rules + [(stage.isNull(), F.lit(missing_stage))], stage))
    return out.withColumn("species", sp).withColumn("prey_taxon", unite_cols([taxon, stage_n]))


def add_diet_measures(d: DataFrame, offset: float = 0.01) -> DataFrame:
    """Observation part of D1: offset response and inverse prey mass."""
    out = d.withColumn("mgdm01", F.lit(offset) + F.col("mg_diet_dm"))
    if "prey_mg_dm" in d.columns:
        out = out.withColumn("prey_mg_inverse", safe_divide(F.lit(1.0), F.col("prey_mg_dm")))
    return out


def clean_diet(d: DataFrame, drop_species: Sequence[str] = (),
               species_rules: Sequence[tuple[str, str]] = (),
               prey_rules: Sequence[tuple[str, str]] = (),
               stage_rules: Mapping[str, str] | None = None,
               missing_stage: str = "unknown", offset: float = 0.01) -> DataFrame:
    """D1 on an already joined diet table (names and measures in one projection)."""
    named = clean_prey_names(d, drop_species, species_rules, prey_rules, stage_rules, missing_stage)
    return add_diet_measures(named, offset)


def classify_stage(df: DataFrame, pa_stages: Sequence[str] = ("a", "p"),
                   col: str = "prey_taxon", out: str = "prey_stage") -> DataFrame:
    """Stage class of a ``taxon_stage`` name: ``pa`` if the stage is listed, else ``not_pa``.

    A function of the prey name only: when the names come from a dimension
    table, classify the dimension before the join so the split runs once
    per prey name instead of once per observation.
    """
    _, stage = separate_parts(col, 2)
    return df.withColumn(out, F.when(in_set(stage, pa_stages), F.lit("pa")).otherwise(F.lit("not_pa")))


def diet_stage_totals(d: DataFrame, pa_stages: Sequence[str] = ("a", "p"),
                      keys: Sequence[str] = ("id", "species", "date2"),
                      value: str = "mg_diet_dm", out: str = "mg_dmtotal") -> DataFrame:
    """Diet total per fish and stage class (``pa`` or ``not_pa``).

    The stage is the second piece of ``prey_taxon`` (or an existing
    ``prey_stage`` column from ``classify_stage``); a strict sum (NULL if any
    mass is) per key plus stage class (partial aggregation, one shuffle).
    """
    if "prey_stage" not in d.columns:
        d = classify_stage(d, pa_stages)
    return d.groupBy(*keys, "prey_stage").agg(strict_sum(value).alias(out))


def diet_stage_wide(d: DataFrame, pa_stages: Sequence[str] = ("a", "p"),
                    keys: Sequence[str] = ("id", "species", "date2"),
                    value: str = "mg_diet_dm") -> DataFrame:
    """D2 followed by the stage pivot, as one conditional aggregate.

    ``pa``/``not_pa`` sums per key (0 when a fish has no prey of that
    class), ``total`` and ``prop_pa``.  Equal to pivoting
    ``diet_stage_totals`` but with a single shuffle.
    """
    if "prey_stage" not in d.columns:
        d = classify_stage(d, pa_stages)
    is_pa = F.col("prey_stage") == F.lit("pa")

    def class_sum(test):  # 0 without rows of the class, NULL if one of them has no mass
        rows, seen = F.count(F.when(test, F.lit(1))), F.count(F.when(test, F.col(value)))
        return F.when(rows == 0, F.lit(0.0)).when(rows == seen, F.sum(F.when(test, F.col(value))))

    w = d.groupBy(*keys).agg(class_sum(is_pa).alias("pa"), class_sum(~is_pa).alias("not_pa"))
    return (w.withColumn("total", F.col("pa") + F.col("not_pa"))
            .withColumn("prop_pa", safe_divide(F.col("pa"), F.col("total"))))


def _levels_with_community(ep: DataFrame) -> DataFrame:
    """Per capita, per population and community rows from one aggregate.

    The stage pivot is a conditional aggregate per (date2, species, draw).
    Community sums over species come from a window over (date2, draw)
    (a handful of species rows each) and are emitted once per group by
    the first species row.  Everything keys on ``draw``, so the chain
    reuses the draw partitioning and the expansion is evaluated once.
    Equivalent to ``stage_levels`` + ``community_rollup`` + union.
    """
    def ssum(stage: str, col: str):
        return F.coalesce(F.sum(F.when(F.col("prey_stage") == stage, F.col(col))), F.lit(0.0))

    wide = ep.groupBy("date2", "species", "draw").agg(
        ssum("pa", "epred").alias("pa_c"), ssum("not_pa", "epred").alias("np_c"),
        ssum("pa", "population_epred").alias("pa_p"), ssum("not_pa", "population_epred").alias("np_p"))
    w = Window.partitionBy("date2", "draw")
    wide = (wide.withColumn("pa_k", F.sum("pa_p").over(w)).withColumn("np_k", F.sum("np_p").over(w))
            .withColumn("__rn", F.row_number().over(w.orderBy("species"))))

    def level(label, species, pa, npa):
        return F.struct(F.lit(label).alias("data_level"), species.alias("species"),
                        F.col(pa).alias("pa"), F.col(npa).alias("not_pa"))

    levels = F.array(level("Per capita", F.col("species"), "pa_c", "np_c"),
                     level("Per population", F.col("species"), "pa_p", "np_p"),
                     F.when(F.col("__rn") == 1,
                            level("Per community", F.lit("Community"), "pa_k", "np_k")))
    e = wide.select("date2", "draw", F.explode(levels).alias("__l")).where(F.col("__l").isNotNull())
    return (e.select("date2", F.col("__l.species").alias("species"), "draw",
                     F.col("__l.data_level").alias("data_level"), F.col("__l.pa").alias("pa"),
                     F.col("__l.not_pa").alias("not_pa"))
            .withColumn("total", F.col("pa") + F.col("not_pa"))
            .withColumn("prop_pa", safe_divide(F.col("pa"), F.col("total"))))


def lump_rare_prey(d: DataFrame, threshold: float = 0.001, keep: Sequence[str] = ("coleo_a",),
                   keys: Sequence[str] = ("date2", "species", "id")) -> DataFrame:
    """D3: prey taxa under ``threshold`` of all diet mass become ``other_unknown``."""
    return lump_rare(d, "prey_taxon", "mg_diet_dm", keys, threshold, keep)


def diet_posteriors(draws: DataFrame, design: DataFrame | None = None,
                    abundance: DataFrame | None = None,
                    cells: Sequence[str] = ("species", "date2", "prey_stage"),
                    species_names: Mapping[str, str] | None = None,
                    grid: DataFrame | None = None, grid_is_distinct: bool = False,
                    hurdle_coef: str | None = None) -> DataFrame:
    """Per-capita, per-population and per-community draw tables.

    ``design`` is the grid with a design vector ``x``; ``abundance`` has
    ``date2``, ``species``, ``total_abund`` (or ``design`` already carries
    ``total_abund``).  Abundance is attached to the small grid *before* the
    draw expansion, so the expanded table is never joined.  Both per-fish levels come from one aggregate over
    (date2, species, draw); the community level sums the population level
    over species.  Every aggregate keys on ``draw`` and reuses the draw
    partitioning, so the whole chain shuffles only the draw table.
    With ``grid`` instead of ``design`` the model is the cell-means one (one
    coefficient per cell) and expands in one pass.  With ``hurdle_coef`` (and
    ``design``) the expected value is the hurdle one, ``mu * (1 - hu)``.
    """
    if grid is not None:
        # cell-means model: the grid (with total_abund) is the design
        ep = epred_cell_means(draws, grid, list(cells), carry=["total_abund"],
                              grid_is_distinct=grid_is_distinct)
    else:
        g = design if abundance is None else design.join(abundance, ["date2", "species"], "left")
        ep = epred_draws(draws, g, list(cells), carry=["total_abund"],
                         hurdle_coef=hurdle_coef)
    ep = ep.withColumn("population_epred", F.col("epred") * F.col("total_abund"))
    posts = _levels_with_community(ep)
    if species_names:
        posts = posts.withColumn("species", case_when(
            [(F.col("species") == F.lit(k), F.lit(v)) for k, v in species_names.items()],
            F.col("species")))
    return posts
