"""Order-dependent operators.

Spark tables have no row order, so every operator here takes an explicit
order.  Nothing uses an unpartitioned window over raw rows: level codes
come from a sorted level array (scalar subquery) and first-per-key is a
partial (map-side) ``min_by`` aggregate, so a key holding a third of all
rows is still reduced in parallel before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.joins import DEFAULT_MAX_LEVELS


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by ``order`` (``distinct(k, .keep_all = TRUE)``).

    ``order`` must break ties (include a unique column) for a deterministic
    result.  Implemented as ``min_by(struct(row), struct(order))`` so each
    task pre-reduces its rows before the shuffle.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    ordered = F.struct(*[_col(o) for o in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordered).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def locf(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
         columns: Sequence[str], chunk: str | Column | None = None) -> DataFrame:
    """Carry the last non-NULL value forward within each partition.

    Without ``chunk`` this is one window per partition key.  A key holding a
    large share of the rows would then sit in one task, so with ``chunk``
    (a coarse column that never decreases along ``order_by``, e.g. the day
    of a timestamp) the work is split in two levels:

    1. per (key, chunk): the last non-NULL value in the chunk (a partial
       aggregate);
    2. per key over the small chunk table: the value carried in from earlier
       chunks;
    3. per (key, chunk) window over the rows, falling back to the carry-in.

    Every task then holds at most one chunk of one key.
    """
    order_cols = [F.col(c) for c in order_by]
    if chunk is None:
        w = (Window.partitionBy(*partition_by).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = df
        for c in columns:
            out = out.withColumn(c, F.last(F.col(c), ignorenulls=True).over(w))
        return out

    ck = "__chunk"
    base = df.withColumn(ck, _col(chunk))
    ordkey = F.struct(*order_cols)
    summary = base.groupBy(*partition_by, ck).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(f"__last_{c}")
        for c in columns
    ])
    wk = (Window.partitionBy(*partition_by).orderBy(ck)
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = summary.select(*partition_by, ck, *[
        F.last(F.col(f"__last_{c}"), ignorenulls=True).over(wk).alias(f"__in_{c}") for c in columns
    ])
    renamed = carry.select(*[F.col(c).alias(f"__k_{c}") for c in (*partition_by, ck)],
                           *[f"__in_{c}" for c in columns])
    same = F.lit(True)
    for c in (*partition_by, ck):  # a NULL key is a key of its own
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = base.join(renamed, same, "left")
    wr = (Window.partitionBy(*partition_by, ck).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.last(F.col(c), ignorenulls=True).over(wr),
                                           F.col(f"__in_{c}")))
    return out.select(*df.columns)


def sorted_levels(df: DataFrame, col: str, max_levels: int = DEFAULT_MAX_LEVELS) -> Column:
    """Sorted distinct non-NULL values of ``col`` as a scalar array."""
    arr = F.array_sort(F.collect_list(F.col(col)))
    guarded = F.when(F.size(arr) > max_levels, F.raise_error(
        F.lit(f"more than {max_levels} levels in {col}"))).otherwise(arr)
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1)
    return distinct.agg(guarded.alias("levels")).scalar()


def dense_code(df: DataFrame, col: str, out: str, max_levels: int = DEFAULT_MAX_LEVELS) -> DataFrame:
    """1-based code of each value among the sorted distinct values (factor codes).

    Codes follow binary string order; NULL stays NULL.
    """
    levels = sorted_levels(df, col, max_levels)
    return df.withColumn(out, F.array_position(levels, F.col(col)).cast("int"))


def rescale(df: DataFrame, col: str, out: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Min-max rescale of ``col`` over the whole table to ``[lo, hi]``.

    Min and max come from one 1-row aggregate (scalar subquery).  When all
    values are equal the result is the midpoint of the target range.
    """
    stats = df.agg(F.struct(F.min(col).alias("mn"), F.max(col).alias("mx")).alias("s")).scalar()
    mn, mx = stats["mn"], stats["mx"]
    x = F.col(col).cast("double")
    span = (mx - mn).cast("double")
    scaled = (x - mn) / span * F.lit(hi - lo) + F.lit(lo)
    return df.withColumn(out, F.when(span == 0, F.lit((lo + hi) / 2.0)).otherwise(scaled))


def relevel_key(df: DataFrame, col: str, first: Sequence[str], out: str,
                max_levels: int = DEFAULT_MAX_LEVELS,
                levels_from: DataFrame | None = None) -> DataFrame:
    """Level number after moving ``first`` to the front (``fct_relevel``).

    Named levels get 1..k in the given order; the remaining values follow
    in sorted order.  NULL stays NULL.  ``levels_from`` may give the values of
    ``col`` from a smaller table.
    """
    named = F.array(*[F.lit(v) for v in first])
    others = (levels_from if levels_from is not None else df).where(~F.col(col).isin(list(first)))
    rest = sorted_levels(others, col, max_levels)
    pos = F.array_position(named, F.col(col))
    code = F.when(pos > 0, pos).otherwise(F.lit(len(first)) + F.array_position(rest, F.col(col)))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), code.cast("int")))


def dense_rescale(df: DataFrame, specs: dict[str, tuple[str, float, float]],
                  max_levels: int = DEFAULT_MAX_LEVELS) -> DataFrame:
    """Level codes of several columns, rescaled to target ranges, in one pass.

    ``specs`` maps a source column to ``(out, lo, hi)``.  Equivalent to
    ``rescale(dense_code(df, c), ...)`` for each column: codes run 1..k, so
    the rescaled value is ``lo + (code - 1) / (k - 1) * (hi - lo)`` (the
    midpoint when k = 1).  All level arrays come from one scalar subquery,
    so the input is evaluated once more, not once per column and statistic.
    """
    out = df
    for c, (name, lo, hi) in specs.items():
        arr = sorted_levels(df, c, max_levels)
        code = F.array_position(arr, F.col(c)).cast("double")
        k = F.size(arr).cast("double")
        val = F.when(k == 1, F.lit((lo + hi) / 2.0)).otherwise(
            (code - 1.0) / (k - 1.0) * F.lit(hi - lo) + F.lit(lo))
        out = out.withColumn(name, F.when(F.col(c).isNotNull(), val))
    return out
