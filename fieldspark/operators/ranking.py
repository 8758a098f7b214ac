"""Exact ranks and order statistics without one-task sorts or group buffers.

A global sort key is cut into chunks by a function that never decreases along
the order.  Chunks are sorted apart, and the number of rows in earlier chunks
is added.  The cut points come from a bounded sketch; they only decide how
even the chunks are, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 64


def number_rows(df: DataFrame, chunk: Column, order: Sequence[Column], out: str,
                total: str | None = None) -> DataFrame:
    """1-based row numbers over the whole table in ``order``, and with
    ``total`` the number of rows.

    ``chunk`` must not decrease along ``order``.  Tasks sort one chunk each;
    only one row per chunk goes through a window without partitions.
    """
    rows = df.withColumn("__chunk", chunk)
    counts = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.asc_nulls_first("__chunk")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__chunk").alias("__c"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                            F.sum("__n").over(Window.partitionBy()).alias("__total"))
    within = Window.partitionBy("__chunk").orderBy(*order)
    joined = rows.withColumn("__rn", F.row_number().over(within)).join(
        offsets, F.col("__chunk").eqNullSafe(F.col("__c")))
    extra = [F.col("__total").alias(total)] if total else []
    return joined.withColumn(out, (F.col("__before") + F.col("__rn")).cast("bigint")).select(
        *df.columns, out, *extra)


def value_range(df: DataFrame, col: str, ranges: int = 16) -> Column:
    """Number of the range of ``col`` a row falls into, 0 to ``ranges``; the cut
    points are a 1-row aggregate.  NULL stays NULL."""
    points = [k / ranges for k in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(col, points, 1000)).scalar()
    place = F.lit(0)
    for k in range(ranges - 1):
        place = place + F.coalesce((cuts[k] < F.col(col)).cast("int"), F.lit(0))
    return F.when(F.col(col).isNotNull(), place)


def dense_names(df: DataFrame, col: str, out: str, first: Sequence[str] = (),
                total: str = "levels") -> DataFrame:
    """``col, out, levels``: 1-based codes of the distinct non-NULL names and
    their number.  Names in ``first`` that occur come first, in that order, the
    others in binary order, in chunks by the first three characters after the
    prefix that all names share."""
    names = df.select(col).where(F.col(col).isNotNull()).distinct()
    # What the smallest and the largest name share, all names in between share too.
    lo, hi = F.col("lo"), F.col("hi")
    shared = F.filter(F.sequence(F.lit(1), F.greatest(F.length("lo"), F.lit(1))), lambda i: F.substring(
        lo, F.lit(1), i) == F.substring(hi, F.lit(1), i))
    common = names.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).select(F.size(shared)).scalar()
    place = F.lit(len(first))
    if first:
        named = F.array_position(F.array(*map(F.lit, first)), F.col(col))
        place = F.when(named > 0, named - 1).otherwise(F.lit(len(first))).cast("int")
    chunk = F.concat(F.lpad(place.cast("string"), 9, "0"),
                     F.when(place == len(first), F.substring(F.col(col), F.lit(1), common + 3))
                     .otherwise(F.lit("")))
    return number_rows(names, chunk, [place, F.col(col)], out, total)


def group_statistics(df: DataFrame, by: Sequence[str], value: str,
                     probs: Sequence[float]) -> DataFrame:
    """Exact statistics per group: ``by, n, n_obs, mean, sd, q``.

    ``q`` holds the linearly interpolated quantiles (R type 7) of the
    non-NULL values.  Equal values are counted before anything is sorted, so
    neither a hot value nor a hot group ends in one task: the values of a
    group are cut into up to ``CHUNKS`` ranges, each range is sorted by
    itself, and only the values at the wanted ranks are kept.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("__one"))
    counts = (df.select(key.alias("__g"), F.col(value).cast("double").alias("__v"))
              .groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n")))
    points = [k / CHUNKS for k in range(1, CHUNKS)]
    cuts = counts.groupBy(F.col("__g").alias("__cg")).agg(
        F.percentile_approx("__v", points, 2000).alias("__cuts"))
    ranged = counts.join(cuts, F.col("__g") == F.col("__cg")).select(
        "__g", "__v", "__n", "__cuts",
        F.when(F.col("__v").isNull(), -1).otherwise(
            F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).alias("__r"))
    # Sums are taken around the lower end of a value's range, so nothing cancels.
    end = F.coalesce(F.get("__cuts", F.greatest(F.col("__r") - 1, F.lit(0))), F.lit(0.0))
    ranged = ranged.withColumn("__e", end).drop("__cuts")
    seen = F.col("__v").isNotNull()
    off = F.col("__v") - F.col("__e")
    parts = ranged.groupBy("__g", "__r").agg(
        F.sum(F.when(seen, F.col("__n")).otherwise(0)).alias("__o"), F.sum("__n").alias("__a"),
        F.first("__e").alias("__e"), F.sum(F.col("__n") * off).alias("__s"),
        F.sum(F.col("__n") * off * off).alias("__q"))
    mean = F.col("__e") + F.col("__s") / F.nullif("__o", F.lit(0))
    parts = parts.withColumns({"__m": mean, "__q": F.col("__q") - F.col("__s") * F.col("__s")
                               / F.nullif("__o", F.lit(0))})
    group = Window.partitionBy("__g")
    earlier = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "__before": F.coalesce(F.sum("__o").over(earlier), F.lit(0)),
        "__obs": F.sum("__o").over(group), "__all": F.sum("__a").over(group)})
    parts = parts.withColumn("__mean", F.sum(F.col("__o") * F.col("__m")).over(group)
                             / F.nullif("__obs", F.lit(0)))
    moved = F.col("__m") - F.col("__mean")
    moments = parts.groupBy("__g").agg(
        F.max("__all").alias("n"), F.max("__obs").alias("n_obs"), F.max("__mean").alias("mean"),
        F.sum(F.col("__q") + F.col("__o") * moved * moved).alias("__ss"))

    def ranks(obs: Column) -> list[Column]:
        h = [(obs - 1) * F.lit(float(p)) for p in probs]
        return [f(x) for x in h for f in (F.floor, F.ceil)]

    # Only the ranges that hold a wanted rank are sorted.
    wanted = F.array(*ranks(F.col("__obs")))
    last = F.col("__before") + F.col("__o") - 1
    needed = parts.where(F.exists(wanted, lambda r: (r >= F.col("__before")) & (r <= last))).select(
        F.col("__g").alias("__pg"), F.col("__r").alias("__pr"), "__before", "__obs")
    running = Window.partitionBy("__g", "__r").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.where(seen).join(
        needed, (F.col("__g") == F.col("__pg")) & (F.col("__r") == F.col("__pr")))
        .withColumn("__run", F.sum("__n").over(running))
        .withColumn("__last", F.col("__before") + F.col("__run") - 1))
    first = F.col("__last") - F.col("__n") + 1

    def at(rank: Column) -> Column:  # value whose rows cover a 0-based rank
        return F.max(F.when((first <= rank) & (rank <= F.col("__last")), F.col("__v")))

    aggs = []
    for i, rank in enumerate(ranks(F.col("__obs"))):
        aggs.append(at(rank).alias(f"__{'lu'[i % 2]}{i // 2}"))
    found = placed.groupBy(F.col("__g").alias("__fg")).agg(*aggs)
    stats = moments.join(found, F.col("__g") == F.col("__fg"), "left")
    qs = []
    for i, p in enumerate(probs):
        h = (F.col("n_obs") - 1) * F.lit(float(p))
        low, up = F.col(f"__l{i}"), F.col(f"__u{i}")
        qs.append(low + (up - low) * (h - F.floor(h)))
    sd = F.when(F.col("n_obs") > 1, F.sqrt(F.try_divide(F.col("__ss"), F.col("n_obs") - 1)))
    return stats.select(*[F.col("__g")[c].alias(c) for c in by], "n", "n_obs", "mean",
                        sd.alias("sd"), F.array(*qs).alias("q"))
