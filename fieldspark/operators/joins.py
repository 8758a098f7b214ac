"""Joins and grids.

Grids (``expand_grid``, ``data_grid``) are products of small level sets.
They are built without a join operator: the level set of each column is
collected by one aggregate into an array that Spark evaluates once as a
scalar subquery, and ``explode`` multiplies rows map-side.  Every level set
carries a runtime size guard that fails the query instead of silently
shipping an unbounded array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_LEVELS = 100_000


def shared_columns(x: DataFrame, y: DataFrame) -> list[str]:
    ys = set(y.columns)
    return [c for c in x.columns if c in ys]


def _join_keys_null_safe(x: DataFrame, y: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL matches NULL; keys appear once.

    Whether a side is broadcast is left to Spark, which goes by its bytes.
    """
    yy = y.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in y.columns])
    cond = None
    for k in keys:
        c = x[k].eqNullSafe(yy[f"__k_{k}"])
        cond = c if cond is None else cond & c
    out = x.join(yy, cond, how)
    return out.drop(*[f"__k_{k}" for k in keys])


def natural_left_join(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Left join on all shared columns (or ``by``), NULL keys matching."""
    keys = list(by) if by else shared_columns(x, y)
    if not keys:
        raise ValueError("no shared columns to join on")
    return _join_keys_null_safe(x, y, keys, "left")


def left_join_suffixed(x: DataFrame, y: DataFrame, by: Sequence[str],
                       suffixes: tuple[str, str] = ("_x", "_y"),
                       max_multiplicity: int | None = None,
                       split: int | None = None) -> DataFrame:
    """Left join on ``by``; other colliding names get suffixes.

    With ``split`` hot keys are dealt out by ``split_join`` in parts of so many
    rows, whatever their multiplicity.

    NULL keys match NULL keys.  Many-to-many keys multiply rows.  With ``max_multiplicity`` the right
    side is checked per key at run time (no extra job) and the query fails
    if a key repeats more often, so a join can never emit an unbounded number
    of pairs per key.
    """
    by = list(by)
    clash = (set(x.columns) & set(y.columns)) - set(by)
    xs = x.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in x.columns])
    ys = y.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in y.columns])
    if split is not None:
        return split_join(xs, ys, by, "left", split)
    if max_multiplicity is not None:
        # Counted per key where the join needs the rows anyway.  The check is
        # folded into the first join key so the optimizer cannot prune it.
        counts = F.count(F.lit(1)).over(Window.partitionBy(*by))
        k0 = by[0]
        guarded = F.when(F.col("__mult") > max_multiplicity, F.raise_error(
            F.lit(f"join key repeats more than {max_multiplicity} times on the right side"))) \
            .otherwise(F.col(k0))
        ys = ys.withColumn("__mult", counts).withColumn(
            k0, guarded.cast(ys.schema[k0].dataType)).drop("__mult")
    # NULL keys match NULL keys, as in dplyr joins; keys appear once.
    return _join_keys_null_safe(xs, ys, by, "left")


def split_join(x: DataFrame, y: DataFrame, by: Sequence[str], how: str = "inner",
               block: int = 4096) -> DataFrame:
    """Many-to-many join that gives no task a whole hot key (NULL keys match).

    A key with ``n`` rows on the left and ``m`` on the right makes ``n * m``
    pairs.  Its rows are dealt into ``ceil(n / block)`` and ``ceil(m / block)``
    parts by a hash of the row, each part of one side is sent to every part of
    the other, and the join is on the key and both part numbers, so a part has
    about ``block * block`` pairs.  A key without hot rows has one part on each
    side.  Equal rows are counted first and multiplied out at the end, so
    copies of one row are one row.  The columns of ``y`` other than ``by`` must
    have other names than those of ``x``.
    """
    by = list(by)
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if set(x.columns) & set(y.columns) - set(by):
        raise ValueError("columns clash: rename them first")

    def counted(df: DataFrame, copies: str) -> DataFrame:
        return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))

    def parts(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(out))

    def place(df: DataFrame, own: str, other: str) -> DataFrame:
        """The row's own part and one copy for each part of the other side."""
        sized = _join_keys_null_safe(df, hot, by, "left")
        one = lambda c: F.coalesce(c, F.lit(1))
        row = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), one(own)).cast("int")
        return sized.withColumn(f"{own}_at", row).withColumn(
            f"{other}_at", F.explode(F.sequence(F.lit(0), one(other) - 1))).drop(own, other)

    xs, ys = counted(x, "__cx"), counted(y, "__cy")
    hot = parts(xs, "__px").join(parts(ys, "__py").select(
        *[F.col(k).alias(f"__k_{k}") for k in by], "__py"), _null_safe(by), "inner").drop(
        *[f"__k_{k}" for k in by]).where((F.col("__px") > 1) | (F.col("__py") > 1))
    pairs = _join_keys_null_safe(place(xs, "__px", "__py"), place(ys, "__py", "__px"),
                                 [*by, "__px_at", "__py_at"], "inner")
    rest = [c for c in y.columns if c not in by]
    times = F.sequence(F.lit(1).cast("long"), F.col("__cx") * F.col("__cy"))
    out = pairs.withColumn("__i", F.explode(times)).select(*x.columns, *rest)
    if how == "left":
        known = y.select(*[F.col(k).alias(f"__k_{k}") for k in by]).distinct()
        alone = x.join(known, _null_safe(by), "left_anti").select(
            *x.columns, *[F.lit(None).cast(y.schema[c].dataType).alias(c) for c in rest])
        out = out.unionByName(alone)
    return out


def _null_safe(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same


def inner_join_sorted(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Inner join on shared columns (``merge``); keys first, NULL keys matching.

    Sorting by key is left to the sink (``orderBy`` when written), since a
    global sort is a full range shuffle.
    """
    keys = list(by) if by else shared_columns(x, y)
    out = _join_keys_null_safe(x, y, keys, "inner")
    rest = [c for c in out.columns if c not in keys]
    return out.select(*keys, *rest)


def level_array(df: DataFrame, cols: Sequence[str],
                max_levels: int = DEFAULT_MAX_LEVELS, assume_distinct: bool = False) -> Column:
    """Distinct value combinations of ``cols`` as one array-of-struct scalar.

    Evaluated once as a scalar subquery (a distributed distinct, cut at
    ``max_levels + 1`` rows, then one small ``collect_list``).  NULL is kept as a level.  Fails at run
    time if there are more than ``max_levels`` combinations.
    ``assume_distinct`` skips the distinct for inputs that are unique by
    construction (e.g. the output of a group-by on ``cols``).
    """
    s = F.struct(*[F.col(c) for c in cols])
    # collect_list over an explicit distinct: with collect_set the optimizer
    # drops the distinct as redundant and evaluates the projection that
    # defines the columns on every input row instead of once per level.
    arr = F.array_sort(F.collect_list(s))
    guarded = F.when(F.size(arr) > max_levels, F.raise_error(
        F.lit(f"more than {max_levels} level combinations of {list(cols)}"))).otherwise(arr)
    # limit before collecting: the final task never holds more than
    # max_levels + 1 rows, so the guard fires before memory runs out.
    rows = df.select(*cols) if assume_distinct else df.select(*cols).distinct()
    distinct = rows.limit(max_levels + 1)
    return distinct.agg(guarded.alias("levels")).scalar()


def expand_with_levels(df: DataFrame, levels: Column, cols: Sequence[str]) -> DataFrame:
    """Pair every row of ``df`` with every element of a level array (map-only)."""
    e = df.select("*", F.explode(levels).alias("__lv"))
    return e.select(*[c for c in df.columns], *[F.col("__lv")[c].alias(c) for c in cols])


def expand_grid(df: DataFrame, other: DataFrame, cols: Sequence[str] | None = None,
                max_levels: int = DEFAULT_MAX_LEVELS) -> DataFrame:
    """Every row of ``df`` with every distinct combination of ``other``'s ``cols``."""
    cols = list(cols) if cols else other.columns
    return expand_with_levels(df, level_array(other, cols, max_levels), cols)


def complete_grid(df: DataFrame, cols: Sequence[str],
                  max_levels: int = DEFAULT_MAX_LEVELS) -> DataFrame:
    """All combinations of the distinct values of each column, seen or not.

    The level sets of all columns (NULL kept as a level) come from one pass:
    each row gives one tagged value per column, and the distinct ones are
    collected per column in a scalar subquery with a guard on their number.
    The first column's levels are spread over the tasks, which multiply the
    others out.
    """
    spark = df.sparkSession
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[
        (F.col(c) if c == d else F.lit(None).cast(df.schema[d].dataType)).alias(f"v{j}")
        for j, d in enumerate(cols)]) for i, c in enumerate(cols)]))
    values = df.select(tagged.alias("t")).select("t.*").distinct().limit(
        max_levels * len(cols) + 1)
    lists = []
    for i in range(len(cols)):
        one = F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct(F.col(f"v{i}").alias("v")))))
        lists.append(F.when(F.size(one) > max_levels, F.raise_error(F.lit(
            f"more than {max_levels} levels of {cols[i]}"))).otherwise(one).alias(f"l{i}"))
    levels = values.agg(F.struct(*lists).alias("levels")).scalar()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spark.range(1).select(F.explode(levels["l0"]).alias("__x0")).repartition(n, "__x0")
    for i in range(1, len(cols)):
        out = out.select("*", F.explode(levels[f"l{i}"]).alias(f"__x{i}"))
    return out.select(*[F.col(f"__x{i}.v").alias(c) for i, c in enumerate(cols)])
