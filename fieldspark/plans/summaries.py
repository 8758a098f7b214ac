"""Posterior summary tables and plot-ready draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.conditionals import case_when
from fieldspark.functions.dates import add_fractional_days
from fieldspark.operators.draws import (
    epred_draws,
    point_interval,
    species_average,
    summarize_draws,
    thin_draws,
    to_long,
    treatment_design,
)
from fieldspark.operators.joins import complete_grid
from fieldspark.operators.window import relevel_key

POST_IDS = ("data_level", "species", "date2", "draw")


def species_means_global(posts: DataFrame, measures: Sequence[str] = ("prop_pa", "total"),
                         scale: Mapping[str, float] | None = None,
                         digits: int | None = 2) -> DataFrame:
    """D11 global: species-averaged and per-species summaries over all dates.

    Only the reported measures are reshaped to long form; each measure is
    summarised independently, so dropping the others first changes nothing.
    """
    long = to_long(posts, POST_IDS, measures)
    avg = species_average(long, "data_level", "draw", "species")
    return summarize_draws(avg, ["data_level", "species", "name"], scale=scale, digits=digits)


def species_means_bydate(posts: DataFrame, measures: Sequence[str] = ("prop_pa", "total"),
                         scale: Mapping[str, float] | None = None,
                         digits: int | None = 2) -> DataFrame:
    """D11 by date: species average per date plus every species, in one pass."""
    long = to_long(posts, POST_IDS, measures)
    both = species_average(long, "data_level", "draw", "species", extra=["date2"])
    return summarize_draws(both, ["data_level", "date2", "species", "name"], scale=scale,
                           digits=digits)


def plot_ready_draws(posts: DataFrame, n_draws: int = 300, species_first: Sequence[str] = (),
                     dodge: Mapping[str, float] | None = None,
                     panel_labels: Mapping[str, str] | None = None,
                     species: DataFrame | None = None) -> DataFrame:
    """Thin to the first draws, order species, dodge dates, relabel panels.

    ``species`` may give the species (a ``species`` column) that occur in the
    draws, e.g. from the prediction grid, so that listing them does not expand
    the draws a second time.  ``dodge`` gives a fractional-day offset per species (others 0);
    ``panel_labels`` maps a ``data_level`` substring to a panel title.
    """
    out = thin_draws(posts, n_draws)
    out = relevel_key(out, "species", list(species_first), "species_level", levels_from=species)
    off = case_when([(F.col("species") == F.lit(k), F.lit(float(v))) for k, v in
                     (dodge or {}).items()], F.lit(0.0)) if dodge else F.lit(0.0)
    out = out.withColumn("dodge_manual", off) \
        .withColumn("date_dodged", add_fractional_days("date2", F.col("dodge_manual")))
    if panel_labels:
        items = list(panel_labels.items())
        label = case_when([(F.col("data_level").contains(k), F.lit(v)) for k, v in items[:-1]],
                          F.lit(items[-1][1]))
        out = out.withColumn("panel", label)
    return out


def conditional_effects(draws: DataFrame, data: DataFrame, factors: Mapping[str, Sequence[str]],
                        conditions: Mapping[str, object] | None = None,
                        exclude_terms: Sequence[int] = ()) -> DataFrame:
    """Expected value with 66 % and 95 % intervals over a factor grid.

    The grid is every combination of the factors' values in ``data``
    (optionally pinned by ``conditions``, e.g. one taxon); each cell gets
    the treatment-coded design of ``factors``, is expanded over the draws
    (group-level terms can be left out with ``exclude_terms``), and is
    summarised per cell.
    """
    grid = complete_grid(data, list(factors))
    for k, v in (conditions or {}).items():
        grid = grid.where(F.col(k) == F.lit(v))
    design, _ = treatment_design(grid, factors)
    ep = epred_draws(draws, design, list(factors), exclude_terms=exclude_terms)
    return point_interval(ep, list(factors), "epred")
