"""Aggregations.

Whole-table totals are 1-row aggregates attached as scalar subqueries, never
unpartitioned windows (which would pull every row into one task).  Group
statistics that R attaches with a grouped ``mutate`` are computed on the
already aggregated table, where a group holds one row per sub-group instead
of one row per observation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.mathx import log10_pos, safe_divide
from fieldspark.operators.ranking import group_statistics, number_rows, value_range


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# ---- NULL-propagating aggregates (A5) -------------------------------------

def strict_sum(c: str | Column) -> Column:
    """``sum`` that is NULL when any input is NULL (R's default)."""
    col = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(col), F.sum(col))


def strict_mean(c: str | Column) -> Column:
    col = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(col), F.avg(col))


def strict_stddev(c: str | Column) -> Column:
    col = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(col), F.stddev_samp(col))


# ---- shares and lumping (A11, A12, W1) --------------------------------------

def share_of_total(df: DataFrame, keys: Sequence[str], value: str, total: str = "total",
                   global_total: str = "global", proportion: str = "proportion") -> DataFrame:
    """Sum of ``value`` per key and its share of the grand sum.

    The grand sum is a scalar subquery over the (small) per-key table, so
    the only shuffle is the partial + final group aggregate.
    """
    per_key = df.groupBy(*keys).agg(strict_sum(value).alias(total))
    grand = per_key.agg(strict_sum(total)).scalar()
    return (per_key.withColumn(global_total, grand)
            .withColumn(proportion, safe_divide(F.col(total), F.col(global_total))))


def lump_rare(df: DataFrame, category: str, value: str, group_keys: Sequence[str],
              threshold: float, keep: Sequence[str] = (), other: str = "other_unknown",
              out_col: str | None = None, out_value: str | None = None,
              offset: float = 0.1) -> DataFrame:
    """Lump categories whose share of ``value`` is below ``threshold``.

    Categories in ``keep`` are never lumped.  The rows are summed once to
    ``group_keys`` plus category; shares and the lumped result both come from
    that table, so the input is read once.  ``value`` is summed strictly (a
    NULL makes its sums NULL), and an offset copy (``value + offset``) is
    added for log-scale models.
    """
    out_col = out_col or f"{category}_grouped"
    out_value = out_value or value
    fine = df.groupBy(*group_keys, category).agg(strict_sum(value).alias(value))
    shares = share_of_total(fine, [category], value)
    cat_map = shares.select(
        F.col(category).alias("__cat"),
        F.when((F.col("proportion") >= F.lit(threshold)) | F.col(category).isin(list(keep)),
               F.col(category)).otherwise(F.lit(other)).alias(out_col))
    joined = fine.join(cat_map, F.col(category).eqNullSafe(F.col("__cat")), "left")
    return (joined.groupBy(*group_keys, out_col)
            .agg(strict_sum(value).alias(out_value))
            .withColumn(f"{out_value}01", F.col(out_value) + F.lit(offset)))


# ---- group statistics attached to rows (W2, W3, W7, A13) ------------------

def attach_group_stat(df: DataFrame, by: Sequence[str], value: str, out: str,
                      fn: str = "avg") -> DataFrame:
    """Attach a per-group statistic of ``value`` to every row of ``df``.

    Meant for tables already aggregated to one row per sub-group, where a
    group is small; a window partitioned by ``by`` then needs no extra
    shuffle when ``df`` is already partitioned by those keys.
    """
    f = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[fn]
    w = Window.partitionBy(*by)
    stat = f(F.col(value)).over(w)
    if fn in ("avg", "sum"):  # NULL when any value of the group is
        stat = F.when(F.count(F.lit(1)).over(w) == F.count(F.col(value)).over(w), stat)
    return df.withColumn(out, stat)


def proportion_within(df: DataFrame, group: Sequence[str], sub: Sequence[str], value: str,
                      group_total: str = "total_gdm", sub_total: str = "total_gdm_taxa",
                      proportion: str = "proportion") -> DataFrame:
    """Share of each sub-group in its group (e.g. a prey taxon in a diet).

    One group-by to the (group, sub) grain, then the group total over that
    small table; no window over raw rows.
    """
    per_sub = df.groupBy(*group, *sub).agg(strict_sum(value).alias(sub_total))
    per_sub = attach_group_stat(per_sub, group, sub_total, group_total, "sum")
    return (per_sub.select(*group, *sub, group_total, sub_total)
            .withColumn(proportion, safe_divide(F.col(sub_total), F.col(group_total))))


def impute_zero_by_group_mean(df: DataFrame, by: Sequence[str], raw: str, average: str = "average",
                              out: str = "total_abund") -> DataFrame:
    """Replace zeros of ``raw`` by the group mean of ``raw`` (zeros included)."""
    with_avg = attach_group_stat(df, by, raw, average, "avg")
    return with_avg.withColumn(out, F.when(F.col(raw) == 0, F.col(average))
                               .otherwise(F.col(raw).cast("double")))


# ---- ordering by a measure (A18) -------------------------------------------

def rank_by_mean(df: DataFrame, category: str, value: str, descending: bool = True,
                 mean_col: str = "mean_value", rank_col: str = "level") -> DataFrame:
    """Order categories by the mean of ``value`` (``reorder(x, -v)``).

    The table of means is cut into ranges of the mean that are sorted apart,
    so any number of categories may be ranked.
    """
    means = df.groupBy(category).agg(F.avg(value).alias(mean_col))
    place = value_range(means, mean_col)
    chunk = F.coalesce(-place if descending else place, F.lit(2**30))  # NULLs last
    order = F.desc_nulls_last(mean_col) if descending else F.asc_nulls_last(mean_col)
    return number_rows(means, chunk, [order, F.asc_nulls_last(category)], rank_col)


# ---- quantiles and distributions (A7-A10, A19, X10) ------------------------

def quantile_agg(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                 names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolation quantiles (R type 7) per group, NULLs skipped."""
    stats = group_statistics(df, by, value, probs)
    return stats.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def distribution_bins(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float,
                      n_bins: int, log10: bool = True) -> DataFrame:
    """Histogram (optionally of log10 values) plus exact quartiles, per group.

    Bin ``i`` covers ``[lo + i*w, lo + (i+1)*w)``; values outside
    ``[lo, hi)`` go to the first or last bin.  Non-positive values are
    dropped on the log scale.  Counts are a group aggregate; the quartile
    side has one row per group.
    """
    x = log10_pos(value) if log10 else F.col(value)
    w = (hi - lo) / n_bins
    base = df.select(*by, F.col(value).alias("__v"), x.alias("__x")).where(F.col("__x").isNotNull())
    b = F.least(F.greatest(F.floor((F.col("__x") - F.lit(lo)) / F.lit(w)), F.lit(0)),
                F.lit(n_bins - 1)).cast("int")
    counts = base.withColumn("bin", b).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(w))
    quart = quantile_agg(base, by, "__v", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    from fieldspark.operators.joins import natural_left_join

    return natural_left_join(counts, quart, list(by)) if by else counts.join(F.broadcast(quart))


def density(df: DataFrame, by: Sequence[str], value: str, points: int = 128, adjust: float = 1.0,
            cut: float = 3.0, reach: float = 6.0) -> DataFrame:
    """Gaussian kernel density per group on ``points`` equal steps.

    Bandwidth ``0.9 * min(sd, IQR / 1.34) * n^(-1/5)`` (``bw.nrd0``) from exact
    quartiles; the grid runs ``cut`` bandwidths beyond the smallest and largest
    value.  Values are shared out linearly between their two grid points by a
    partial aggregate, so a group is at most ``points`` weights whatever its
    size; each weight then adds to the grid points within ``reach`` bandwidths.

    Returns ``by, i, x, density, bandwidth, n``.  NULLs are skipped; a group of
    fewer than two values has no density; equal values use ``|value|`` or 1 in
    place of the spread; a NULL group is a group of its own.
    """
    from fieldspark.operators.ranking import group_statistics

    key = F.struct(*[F.col(c).alias(c) for c in by], F.lit(0).alias("__one"))
    rows = df.select(key.alias("__g"), F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull())
    q = F.col("q")
    spread = F.least(F.col("sd"), (q[2] - q[1]) / F.lit(1.34))
    usable = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).when(
        q[0] != 0, F.abs(q[0])).otherwise(F.lit(1.0))
    bw = F.lit(0.9 * adjust) * usable * F.pow(F.col("n_obs"), F.lit(-0.2))
    stats = (group_statistics(rows, ["__g"], "__v", [0.0, 0.25, 0.75, 1.0])
             .where(F.col("n_obs") >= 2).withColumn("__bw", bw)
             .select(F.col("__g").alias("__h"), "__bw", F.col("n_obs").cast("double").alias("__n"),
                     (q[0] - F.lit(cut) * F.col("__bw")).alias("__from"),
                     ((q[3] - q[0] + F.lit(2.0 * cut) * F.col("__bw")) / F.lit(points - 1.0))
                     .alias("__step")))
    place = (F.col("__v") - F.col("__from")) / F.col("__step")
    low = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    shared = rows.join(stats, F.col("__g") == F.col("__h")).withColumn("__p", place).withColumn(
        "__i", low)
    right = F.col("__p") - F.col("__i")
    bins = shared.select("__g", F.explode(F.array(
        F.struct(F.col("__i").alias("i"), (F.lit(1.0) - right).alias("w")),
        F.struct((F.col("__i") + 1).alias("i"), right.alias("w")))).alias("__w")).groupBy(
        "__g", F.col("__w.i").alias("__i")).agg(F.sum("__w.w").alias("__w"))
    radius = F.ceil(F.lit(reach) * F.col("__bw") / F.col("__step")).cast("int")
    near = F.sequence(F.greatest(F.col("__i") - radius, F.lit(0)),
                      F.least(F.col("__i") + radius, F.lit(points - 1)))
    spreads = bins.join(stats, F.col("__g") == F.col("__h")).select(
        "__h", "__bw", "__n", "__from", "__step", "__i", "__w", F.explode(near).alias("__j"))
    z = (F.col("__j") - F.col("__i")) * F.col("__step") / F.col("__bw")
    kernel = F.exp(F.lit(-0.5) * z * z) / (F.lit(2.5066282746310002) * F.col("__bw"))
    grid = stats.select("__h", "__bw", "__n", "__from", "__step",
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__j"),
                        F.lit(0.0).alias("__d"))
    parts = spreads.select("__h", "__bw", "__n", "__from", "__step", "__j",
                           (F.col("__w") / F.col("__n") * kernel).alias("__d")).unionByName(grid)
    out = parts.groupBy("__h", "__j").agg(
        F.sum("__d").alias("density"), F.first("__from").alias("__from"),
        F.first("__step").alias("__step"), F.first("__bw").alias("bandwidth"),
        F.first("__n").cast("long").alias("n"))
    return out.select(*[F.col("__h")[c].alias(c) for c in by], F.col("__j").alias("i"),
                      (F.col("__from") + F.col("__j") * F.col("__step")).alias("x"), "density",
                      "bandwidth", "n")
