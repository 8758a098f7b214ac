"""Hard-negative mining by slots of the score axis.

Every (anchor, positive) pair asks for the best negatives whose score lies
between a share of the positive's score and that score.  The windows of one
anchor overlap, so they are not searched one by one:

1. The positives' scores, the upper limits of the windows, cut the score axis
   of an anchor into disjoint slots; a negative falls into exactly one.
2. Each block of rows keeps its best ``k`` per slot, a combiner that leaves at
   most ``k`` rows per anchor, slot and block to shuffle; the blocks' lists are
   merged per slot.
3. From the lowest slot upwards the list of a slot and the merged list of the
   slots below it are joined and cut to ``k``.  The list that starts at a
   positive's slot answers its window; what lies under its lower limit goes.

Anchors are a stated query set: each block of anchors meets each block of rows
once, in the task that holds both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

EXACT = float(2**53)
POSITIVES = "anchor_id long, positive_id long, score long"
NEGATIVES = "anchor_id long, slot int, negative_id long, score long"


def _matrix(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``x`` and ``y``."""
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if peak < EXACT:  # every partial sum is an integer that a double holds
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(score) > k:
        place = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        place = np.arange(len(score))
    return place[np.lexsort((ids[place], -score[place]))[:k]]


def _blocks(table: pa.Table):
    asked = table["is_anchor"].to_numpy(zero_copy_only=False)
    anchors, rows = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
    return anchors, rows, rows["id"].to_numpy(), rows["label"].to_numpy()


def block_positives(k: int, step: int = 64):
    """Best ``k`` same-label rows of each anchor in a block."""

    def run(table: pa.Table) -> pa.Table:
        anchors, rows, ids, labels = _blocks(table)
        out = [(np.zeros(0, np.int64),) * 3]
        if len(anchors) and len(rows):
            a, x = _matrix(anchors), _matrix(rows)
            for at in range(0, len(a), step):
                block = scores(a[at:at + step], x)
                for i, s in enumerate(block):
                    me, label = anchors["id"][at + i].as_py(), anchors["label"][at + i].as_py()
                    place = np.flatnonzero((labels == label) & (ids != me))
                    place = place[best(s[place], ids[place], k)]
                    out.append((np.full(len(place), me), ids[place], s[place]))
        return pa.table([np.concatenate(c) for c in zip(*out)],
                        names=["anchor_id", "positive_id", "score"])

    return run


def block_slots(k: int, step: int = 64):
    """Best ``k`` other-label rows of each anchor and slot in a block.

    ``limits`` are an anchor's distinct positive scores, descending: slot ``s``
    holds the scores at most ``limits[s]`` and above ``limits[s + 1]``.
    """

    def run(table: pa.Table) -> pa.Table:
        anchors, rows, ids, labels = _blocks(table)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64),
                np.zeros(0, np.int64))]
        if len(anchors) and len(rows):
            a, x = _matrix(anchors), _matrix(rows)
            for at in range(0, len(a), step):
                block = scores(a[at:at + step], x)
                for i, s in enumerate(block):
                    me, label = anchors["id"][at + i].as_py(), anchors["label"][at + i].as_py()
                    limits = np.array(anchors["limits"][at + i].as_py(), dtype=np.int64)
                    place = np.flatnonzero((labels != label) & (ids != me) & (s <= limits[0]))
                    slot = len(limits) - 1 - np.searchsorted(limits[::-1], s[place], side="left")
                    for j in range(len(limits)):
                        here = place[slot == j]
                        here = here[best(s[here], ids[here], k)]
                        out.append((np.full(len(here), me), np.full(len(here), j, np.int32),
                                    ids[here], s[here]))
        return pa.table([np.concatenate(c) for c in zip(*out)],
                        names=["anchor_id", "slot", "negative_id", "score"])

    return run


def suffix_merges(slots: Column, k: int) -> Column:
    """Lists per slot, highest slot first -> per slot the best ``k`` of it and
    all lower slots.  Slots are disjoint, so a list in front of another is
    already in order."""
    empty = F.array().cast("array<array<struct<score:bigint,negative_id:bigint>>>")

    def step(done, own):
        lower = F.coalesce(F.get(done, F.lit(0)),
                           F.array().cast("array<struct<score:bigint,negative_id:bigint>>"))
        return F.concat(F.array(F.slice(F.concat(own, lower), 1, k)), done)

    return F.aggregate(F.reverse(slots), empty, step)


def hard_negatives(vectors: DataFrame, anchors: Column, k_positives: int = 5, k: int = 5,
                   low: int = 80, high: int = 100, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
                   block: int = 8192, seed: int = 5) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is the integer inner
    product with the anchor.  Positives are the anchor's first ``k_positives``
    other rows of its label, negatives rows of another label with ``low *
    positive_score <= 100 * negative_score <= 100 * positive_score`` (``high``
    is 100), best first, ties to the smaller id.  ``anchors`` is a condition on
    ``id_col``.

    Defined cases: rows with a NULL id, label or vector, an empty vector or a
    NULL or non-finite component take no part; vectors of different lengths are
    not compared; rows that repeat an anchor's id are not its candidates, and
    an anchor that repeats is asked once, by its smallest (label, vector);
    other repeated rows count once per row; components must fit a long after
    scaling and sums of products too; an anchor without a positive, or a
    positive without a negative, gives no row.
    """
    if high != 100:
        raise ValueError("slots end at the positives' own scores: high must be 100")
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
                          & (F.size(v) > 0) & fine)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
                    anchors.alias("chosen")))
    rows = cut(rows)
    asked = cut(rows.where("chosen").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
                .select("id", "r.label", "r.v"))
    n, m = rows.count(), asked.count()
    row_blocks, anchor_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    salt = lambda c: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    none = F.array().cast("array<bigint>")

    def met(asked: DataFrame) -> DataFrame:
        """Each block of anchors with each block of rows."""
        left = rows.drop("chosen").withColumns({
            "rb": salt(row_blocks), "limits": none, "is_anchor": F.lit(False)}).withColumn(
            "ab", every(anchor_blocks))
        right = asked.withColumns({"ab": salt(anchor_blocks), "is_anchor": F.lit(True)}).withColumn(
            "rb", every(row_blocks))
        return left.unionByName(right).groupBy("rb", "ab", F.size("v"))

    ranked = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    positives = cut(met(asked.withColumn("limits", none))
                    .applyInArrow(block_positives(k_positives), POSITIVES)
                    .withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k_positives)
                    .drop("_r"))
    limits = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    kept = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "negative_id")
    tops = (met(asked.join(limits, "id")).applyInArrow(block_slots(k), NEGATIVES)
            .withColumn("_r", F.row_number().over(kept)).where(F.col("_r") <= k)
            .groupBy("anchor_id", "slot").agg(F.collect_list(
                F.struct("_r", "score", "negative_id")).alias("top")))
    tops = tops.select("anchor_id", "slot", F.transform(
        F.array_sort("top"), lambda t: F.struct(t["score"].alias("score"),
                                                t["negative_id"].alias("negative_id"))).alias("top"))
    slots = (limits.select(F.col("id").alias("anchor_id"), F.posexplode("limits").alias("slot", "limit"))
             .join(tops, ["anchor_id", "slot"], "left")
             .withColumn("top", F.coalesce("top", F.array().cast(
                 "array<struct<score:bigint,negative_id:bigint>>")))
             .groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "limit", "top")))
                                       .alias("s")))
    merged = suffix_merges(F.transform("s", lambda x: x["top"]), k)
    answers = slots.select("anchor_id", F.explode(F.arrays_zip(
        F.transform("s", lambda x: x["limit"]).alias("score"), merged.alias("top"))).alias("a"))
    answers = answers.select("anchor_id", F.col("a.score").alias("score"), F.col("a.top").alias("top"))
    found = positives.join(answers, ["anchor_id", "score"]).select(
        "anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode(
            F.filter("top", lambda t: 100 * t["score"] >= low * F.col("score"))).alias("i", "t"))
    return found.select("anchor_id", "positive_id", (F.col("i") + 1).alias("rank"),
                        F.col("t.negative_id").alias("negative_id"), "positive_score",
                        F.col("t.score").alias("negative_score"))


def op11_slot_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
