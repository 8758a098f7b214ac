"""Projection helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL with 0 in numeric columns (all numeric ones by default).

    Text and date columns are left as they are.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    return df.fillna(0, subset=cols) if cols else df


def drop_na(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any column (or in ``subset``)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def select_prefix(df: DataFrame, prefix: str, numeric_only: bool = False) -> DataFrame:
    cols = [c for c in df.columns if c.startswith(prefix)]
    if numeric_only:
        num = set(numeric_columns(df))
        cols = [c for c in cols if c in num]
    return df.select(*cols)


def select_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names of the contiguous column range ``first:last`` (inclusive)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        i, j = j, i
    return cols[i:j + 1]


def round_numeric(df: DataFrame, digits: int = 2, half_even: bool = True) -> DataFrame:
    """Round every floating-point column, half to even as R does (``bround``).

    ``half_even=False`` rounds half up, which is what SQL engines do.
    """
    rnd = F.bround if half_even else F.round
    return df.select(*[
        rnd(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def arrange(df: DataFrame, *cols: str) -> DataFrame:
    """Sort with NULLs last; a leading ``-`` sorts that column descending.

    A global sort is a range shuffle, so it belongs at a sink (a written
    report), not between operators.
    """
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in cols]
    return df.orderBy(*order)
