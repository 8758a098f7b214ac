"""Counts to biomass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.strings import unite_cols
from fieldspark.operators.aggregate import rank_by_mean
from fieldspark.operators.joins import inner_join_sorted
from fieldspark.operators.project import fill_zero
from fieldspark.operators.reshape import unpivot_except, unpivot_range

# Dry mass per individual (mg) of the emergence taxa.
EMERGENCE_MASS = {"chir": ("chiro_mg_dm", 0.99), "doli": ("doli_mg_dm", 0.65),
                  "tric": ("tric_mg_dm", 0.8), "odo": ("odo_mg_dm", 6.2),
                  "ephe": ("ephem_mg_dm", 1.1)}


def emergence_biomass(df: DataFrame, mass: Mapping[str, tuple[str, float]] | None = None,
                      area: str = "area", days: str = "days",
                      id_cols: Sequence[str] = ("stat", "loc")) -> DataFrame:
    """Counts -> dry mass per taxon, total, and per m2 per day.

    Missing counts are 0 first.  Later expressions build on earlier ones
    (each taxon mass, their total, then the areal daily rate); Catalyst
    folds the chain into one projection.  Without area or days (NULL or 0)
    there is no rate: NULL.
    """
    mass = dict(mass or EMERGENCE_MASS)
    out = fill_zero(df)
    total = None
    for src, (name, factor) in mass.items():
        out = out.withColumn(name, F.col(src).cast("double") * F.lit(float(factor)))
        total = F.col(name) if total is None else total + F.col(name)
    out = out.withColumn("tot_mg_dm", total)
    out = out.withColumn("tot_mg_dm_m2_d", F.try_divide(F.try_divide("tot_mg_dm", area), days))
    return out.withColumn("id", unite_cols(list(id_cols)))


def benthic_biomass(wide: DataFrame, mass: DataFrame, first: str, last: str,
                    sample_m2: float = 0.76 * 0.3) -> DataFrame:
    """Wide taxon counts -> long, joined to per-taxon mass, per m2.

    ``first``..``last`` is the contiguous range of taxon columns; the mass
    table has one row per taxon.
    """
    long = unpivot_range(wide, first, last, "taxon", "abundance")
    return (inner_join_sorted(long, mass, ["taxon"])
            .withColumn("sample_m2", F.lit(float(sample_m2)))
            .withColumn("benthic_mg_dm_m2", F.col("abundance") * F.col("mean_mgdm") / F.col("sample_m2"))
            .withColumn("benthic_mg01", F.lit(0.01) + F.col("benthic_mg_dm_m2"))
            .withColumn("benthic_g01", F.col("benthic_mg_dm_m2") / F.lit(1000.0) + F.lit(0.001)))


def cage_comparison(df: DataFrame, keep: Sequence[str], treatment: str = "trt",
                    exclude_treatment: str = "Exclusion", exclude_date: object | None = None,
                    date: str = "date") -> DataFrame:
    """Ambient vs cage-control rows in long form with taxa ordered by mean."""
    cond = F.col(treatment) != F.lit(exclude_treatment)
    if exclude_date is not None:
        cond = cond & (F.col(date) != F.lit(exclude_date))
    long = unpivot_except(df.where(cond), list(keep), "taxon", "abund")
    order = rank_by_mean(long, "taxon", "abund", rank_col="taxon_order")
    return long.join(order.select("taxon", "taxon_order"), ["taxon"], "left")


def add_pupae(benthic: DataFrame, larvae: str = "chiro_larvae", pupae: str = "pupae",
              out: str = "chiro", drop: Sequence[str] = ()) -> DataFrame:
    """Start of D6: midge larvae and pupae become one taxon, columns go.

    The sum is strict (NULL if either is), and takes the place of the larvae
    so that the range of taxon columns stays contiguous.
    """
    gone = {pupae, *drop}
    return benthic.select(*[
        (F.col(larvae) + F.col(pupae)).alias(out) if c == larvae else F.col(c)
        for c in benthic.columns if c not in gone])
