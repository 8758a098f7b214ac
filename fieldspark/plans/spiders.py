"""Spider and treatment-labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.joins import left_join_suffixed


def recode_treatment(df: DataFrame, drop_trt: str = "Ambient", count_col: str = "spid",
                     offset: float = 0.01, fish_label: str = "fish") -> DataFrame:
    """Drop one treatment, recode ``treatment`` to ``ctrl``/``exc`` as ``trt``.

    Adds ``<count>01 = count + offset`` for log-scale models.
    """
    out = df.where(F.col("trt") != F.lit(drop_trt)).drop("trt").withColumnRenamed("treatment", "trt")
    out = out.withColumn("trt", F.when(F.col("trt") == F.lit(fish_label), F.lit("ctrl"))
                         .otherwise(F.lit("exc")))
    return out.withColumn(f"{count_col}01", F.col(count_col) + F.lit(offset))


def label_treatment(df: DataFrame, col: str = "trt", control: str = "ctrl",
                    labels: tuple[str, str] = ("fish", "no fish")) -> DataFrame:
    """``ctrl`` -> ``fish``, anything else -> ``no fish`` (draw tables, D10)."""
    return df.withColumn(col, F.when(F.col(col) == F.lit(control), F.lit(labels[0]))
                         .otherwise(F.lit(labels[1])))


def spider_emergence(spiders: DataFrame, emergence: DataFrame, dates: Sequence[object],
                     drop_trt: str = "Ambient", by: str = "stat2",
                     max_multiplicity: int | None = None) -> DataFrame:
    """Spider counts matched to emergence at the same station on given dates.

    Emergence is filtered to ``dates`` (one row per station and date), so
    each spider row meets at most ``len(dates)`` emergence rows; the bound
    is checked at run time.
    """
    cond = None
    for d in dates:
        c = F.col("date2") == F.lit(d)
        cond = c if cond is None else cond | c
    emerge = emergence.where(cond & (F.col("trt") != F.lit(drop_trt)))
    sp = spiders.where(F.col("trt") != F.lit(drop_trt))
    return left_join_suffixed(sp, emerge, [by],
                              max_multiplicity=max_multiplicity or len(list(dates)))
