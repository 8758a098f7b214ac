"""Reshaping: wide <-> long and row binding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.operators.project import select_range


def _common_type(df: DataFrame, cols: Sequence[str]) -> T.DataType:
    types = {type(df.schema[c].dataType) for c in cols}
    if types <= {T.IntegerType, T.ShortType, T.ByteType}:
        return T.IntegerType()
    if types <= {T.IntegerType, T.ShortType, T.ByteType, T.LongType}:
        return T.LongType()
    if types <= {T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType}:
        return T.DoubleType()
    return T.StringType()


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
            value: str = "value") -> DataFrame:
    """Wide -> long over ``values``; mixed numeric types widen, else text.

    A map-only ``Expand``: one output row per (input row, value column).
    """
    if not values:
        raise ValueError("no columns to unpivot")
    t = _common_type(df, values)
    cast = df.select(*ids, *[F.col(c).cast(t).alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), name, value)


def unpivot_range(df: DataFrame, first: str, last: str, name: str = "name",
                  value: str = "value") -> DataFrame:
    """``gather(name, value, first:last)``: other columns are kept as ids."""
    vals = select_range(df, first, last)
    ids = [c for c in df.columns if c not in vals]
    return unpivot(df, ids, vals, name, value)


def unpivot_except(df: DataFrame, keep: Sequence[str], name: str = "name",
                   value: str = "value") -> DataFrame:
    """Every column except ``keep`` becomes a (name, value) row."""
    vals = [c for c in df.columns if c not in set(keep)]
    return unpivot(df, list(keep), vals, name, value)


def unpivot_all(df: DataFrame, name: str = "key", value: str = "value") -> DataFrame:
    """Every column becomes a (key, value) row; no id columns remain."""
    return unpivot(df, [], df.columns, name, value)


def pivot_wider(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                values: Sequence[str], fill: object = None, agg: str = "first") -> DataFrame:
    """Long -> wide with an explicit list of new columns.

    Written as conditional aggregates (``first``/``sum`` of ``value`` where
    ``name == v``), which is what ``pivot`` compiles to; giving the values
    avoids the extra job that discovers them.  Missing cells are NULL, or
    ``fill`` when given.
    """
    fn = {"first": lambda c: F.first(c, ignorenulls=True), "sum": F.sum, "max": F.max}[agg]
    cols = []
    for v in values:
        c = fn(F.when(F.col(names_from) == F.lit(v), F.col(values_from)))
        if fill is not None:
            c = F.coalesce(c, F.lit(fill))
        cols.append(c.alias(str(v)))
    return df.groupBy(*ids).agg(*cols)


def bind_rows(*dfs: DataFrame, fill_missing: bool = True) -> DataFrame:
    """Stack tables by column name; missing columns become NULL (UNION ALL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=fill_missing)
    return out


def stack_roles(df: DataFrame, columns: Sequence[str], key: str = "key",
                value: str = "value") -> DataFrame:
    """Two (or more) role columns stacked into one (``gather`` of a pair).

    The columns may be structs, so a role's name and coordinates move
    together without a detour through text.
    """
    rows = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in columns])
    return df.select(F.explode(rows).alias("__r")).select("__r.*")
