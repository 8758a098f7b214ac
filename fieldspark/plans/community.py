"""Community abundance with zero imputation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.conditionals import case_when
from fieldspark.operators.aggregate import impute_zero_by_group_mean, strict_sum
from fieldspark.operators.joins import complete_grid, natural_left_join


def community_totals(obs: DataFrame, date: str = "date", species: str = "species",
                     abund: str = "abund", snap: Mapping[object, object] | None = None,
                     drop_date: object | None = None,
                     rename: Mapping[str, str] | None = None,
                     complete: bool = False) -> DataFrame:
    """Total abundance per (date, species) with zeros replaced by the species mean.

    ``snap`` moves sampling dates onto others before totalling.  With
    ``complete`` the totals are completed to every (date, species)
    combination (missing -> 0, counted in the mean); by default only the
    observed combinations are kept, as in the source analysis.  The species
    mean is taken over *all* dates, and only afterwards is ``drop_date``
    removed.  Species names are recoded last.
    """
    d2 = F.col(date)
    if snap:
        d2 = case_when([(F.col(date) == F.lit(k), F.lit(v)) for k, v in snap.items()], F.col(date))
    o = obs.withColumn("date2", d2)
    raw = o.groupBy("date2", species).agg(strict_sum(abund).alias("total_abund_raw"))
    full = raw
    if complete:
        # levels from the totals, not the observations: the table is read once
        grid = complete_grid(raw, ["date2", species])
        seen = raw.withColumn("__seen", F.lit(True))
        full = natural_left_join(grid, seen, ["date2", species]).withColumn(
            "total_abund_raw", F.when(F.col("__seen"), F.col("total_abund_raw"))
            .otherwise(F.lit(0))).drop("__seen")
    out = impute_zero_by_group_mean(full, [species], "total_abund_raw")
    if drop_date is not None:
        out = out.where(F.col("date2") != F.lit(drop_date))
    if rename:
        out = out.withColumn(species, case_when(
            [(F.col(species) == F.lit(k), F.lit(v)) for k, v in rename.items()], F.col(species)))
    return out
