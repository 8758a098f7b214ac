"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a share of copies per document; its fractional part is an
inclusion probability.  The flight phase moves the probabilities of three
documents at a time along the null space of the balancing constraints (number
of documents, number of tokens) until one of them is 0 or 1, so both totals
keep their expected values exactly.  Groups of a bounded number of documents
of one source fly independently; what a group leaves undecided (at most two
documents) flies again with the leftovers of other groups, until each source
has one group.  Its last documents, at most 12 and the smallest ones, are the
landing problem: of their 0/1 choices the one nearest to the token total is
taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

GROUP = 4096
LANDING = 12
ROWS = ("_source string, _id long, _size long, _nth long, source_size long, target double, whole int, "
        "p double, draw double")


def _uniform(x: float, k: int) -> float:
    return (x * 0.7548776662466927 + k * 0.5698402909980532) % 1.0


def flight(p: list[float], size: list[float], draw: list[float], held: int = 0) -> list[float]:
    """Move probabilities until at most two documents are undecided, the last
    ``held`` ones left aside."""
    eps = 1e-9
    active: list[int] = []
    waiting = iter(range(max(0, len(p) - held)))
    turn = 0
    while True:
        active = [k for k in active if eps < p[k] < 1 - eps]
        while len(active) < 3:
            k = next(waiting, None)
            if k is None:
                break
            if eps < p[k] < 1 - eps:
                active.append(k)
        if len(active) < 3:
            break
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        turn += 1
        step = up if _uniform(draw[a], turn) * (up + down) < down else -down
        for k, d in zip(active, u):
            q = p[k] + step * d
            p[k] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0/1 choice of the undecided documents nearest to their token total
    (then to their number)."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    choices = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = choices - p[open_]
    tokens, number = np.abs(off @ size[open_]), np.abs(off.sum(axis=1))
    p[open_] = choices[np.lexsort((number, np.round(tokens, 6)))[0]]
    return np.round(p)


def _fly(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_size", "draw", "_id", "_nth"],
                                  ascending=[False, True, True, True])
        size = group["_size"].to_numpy(dtype=float)
        p = np.array(flight(group["p"].tolist(), size.tolist(), group["draw"].tolist(),
                            LANDING - 2 if last else 0))
        return group.assign(p=land(p, size) if last else p).drop(columns="salt", errors="ignore")

    return run


def targets(sizes: DataFrame) -> DataFrame:
    """``_source, source_size, target``: sources by code point (NULL last)
    weigh 1, 2, 3, repeating; no target exceeds 3 times its source's size and
    the excess is shared again by weight.  Works on one row per source."""
    by_source = cut(sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"),
                                             F.count("*").alias("n")))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weighed = by_source.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    cap = 3 * F.col("source_size")
    tight = Window.orderBy(cap / F.col("w"), F.col("_source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    # The first source, tightest first, that its share does not fill sets the level.
    level = weighed.withColumn("level", left / weight).withColumn(
        "free", F.col("level") <= cap / F.col("w")).withColumn(
        "level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True)
        .over(everything))
    return level.select("_source", "source_size", "n", F.least(
        cap.cast("double"), F.col("level") * F.col("w")).alias("target"))


def numbered_repeats(sizes: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``_nth``, 0 and up among equal rows, without bringing them together:
    they are counted and written out again, a block of the count at a time."""
    counted = sizes.groupBy(*names).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1,
                                                              F.lit(GROUP).cast("long"))))
    return blocks.select(*names, F.explode(F.sequence(F.col("_from"), F.least(
        F.col("_from") + GROUP, F.col("_n")) - 1)).alias("_nth"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", seed: int = 5) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row.

    Size is the number of ``[^\\x20\\x09-\\x0D]+`` words.  Defined cases: a NULL
    or empty text has size 0; a NULL source is a source of its own, the last;
    a source without words has target 0; repeated rows are separate
    documents, numbered among their like; an empty table gives an empty result.
    Reruns agree: draws are hashes of doc_id, size, that number and seed.
    """
    sizes = docs.select(
        F.col(source_col).cast("string").alias("_source"), F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
        .cast("long").alias("_size"))
    sizes = cut(numbered_repeats(sizes, sizes.columns))
    goal = targets(sizes)
    goal = cut(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (sizes.join(goal.withColumnRenamed("_source", "_s"),
                       F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("whole", F.floor(rate).cast("int"))
            .withColumn("p", rate - F.floor(rate))
            .withColumn("draw", F.pmod(F.xxhash64("_id", "_size", "_nth", F.lit(seed)), F.lit(1 << 30))
                        / F.lit(float(1 << 30))))
    names = [x.split()[0] for x in ROWS.split(", ")]
    groups = F.ceil(F.col("n") / GROUP)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("_id", "_size", "_nth"), groups))
    most = goal.agg(F.max("n")).first()[0] or 0
    parts, decided = salted.drop("n"), []
    while True:
        most = -(-most // GROUP)  # groups of the largest source
        flown = cut(parts.select(*names, "salt").groupBy("_source", "salt")
                    .applyInPandas(_fly(most <= 1), ROWS))
        if most <= 1:
            decided.append(flown)
            break
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~undecided))
        rest = cut(flown.where(undecided))
        count = rest.groupBy("_source").agg(F.count("*").alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        parts = (rest.join(count.withColumnRenamed("_source", "_s"),
                           F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
                 .withColumn("salt", F.pmod(F.xxhash64("_id", "_size", "_nth"), groups)).drop("n"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"),
                      F.col("_size").alias("size"), "source_size", "target",
                      copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def op9_cube_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
