"""Nearest neighbours by collision counting over single-projection hash arrays.

Each block of vectors keeps one sorted array per random projection.  A query
opens a window around its own projection in every array and widens all of
them step by step (virtual rehashing: the same arrays serve every radius).  A
vector that falls into the windows of at least ``share`` of the projections
has collided often enough; windows widen until at least ``candidates`` of the
block have, and all of those are verified with the exact inner product.

Largest inner products become smallest distances by one more coordinate that
brings every vector to the same norm.  Every row is indexed.  Queries are a
stated set: each block of queries meets each block of vectors once, and the
best of all blocks are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

RESULT = "query_id long, vec_id long, score double"


class Projections:
    """Sorted arrays of one block of vectors, one per projection."""

    def __init__(self, vectors: np.ndarray, norm: float, lines: int, seed: int):
        n, d = vectors.shape
        self.lines = np.random.default_rng(seed).standard_normal((d + 1, lines))
        lift = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0.0))
        values = np.concatenate([vectors, lift[:, None]], axis=1) @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        self.values = np.take_along_axis(values.T, self.order, axis=1)
        self.n = n

    def windows(self, centres: np.ndarray, half: np.ndarray):
        """First and last array position of each query's window, per projection."""
        low, high = (np.empty(centres.shape, dtype=np.int64) for _ in range(2))
        for j, v in enumerate(self.values):
            low[:, j] = np.searchsorted(v, centres[:, j] - half, side="left")
            high[:, j] = np.searchsorted(v, centres[:, j] + half, side="right")
        return low, high

    def collide(self, queries: np.ndarray, needed: int, wanted: int, step: float, growth: float):
        """Yields (query, vectors with ``needed`` collisions) as soon as a
        query has at least ``wanted`` of them."""
        centres = queries @ self.lines[:-1]
        open_ = np.arange(len(queries))
        half = np.full(len(queries), step)
        counts: dict[int, np.ndarray] = {}
        before = None
        while len(open_):
            low, high = self.windows(centres[open_], half[open_])
            still = []
            for r, q in enumerate(open_):
                if before is None:
                    new = [o[i:j] for o, i, j in zip(self.order, low[r], high[r])]
                    count = 0
                else:
                    i0, j0 = before[0][r], before[1][r]
                    new = [o[i:j] for o, i, j in zip(self.order, low[r], i0)]
                    new += [o[i:j] for o, i, j in zip(self.order, j0, high[r])]
                    count = counts.pop(int(q))
                count = count + np.bincount(np.concatenate(new), minlength=self.n)
                found = np.flatnonzero(count >= needed)
                if len(found) >= wanted or len(found) == self.n:
                    yield int(q), found
                else:
                    counts[int(q)] = count.astype(np.int16)
                    still.append(r)
            before = low[still], high[still]
            open_ = open_[still]
            half[open_] *= growth


def _search(k: int, norm: float, lines: int, share: float, candidates: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = table["kind"].to_numpy() == 1
        data, queries = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(data) and len(queries):
            x, q = (t["embedding"].combine_chunks().flatten().to_numpy().astype(float)
                    .reshape(len(t), -1) for t in (data, queries))
            ids = data["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            arrays = Projections(x, norm, lines, seed)
            needed = max(1, math.ceil(share * lines))
            wanted = min(len(x), max(4 * k, math.ceil(candidates * len(x))) + k)
            asked = queries["vec_id"].to_numpy()
            for at in range(0, len(q), 256):
                for i, some in arrays.collide(q[at:at + 256], needed, wanted, 0.7 * norm, 1.15):
                    v, query_id = q[at + i], asked[at + i]
                    some = some[ids[some] != query_id]
                    score = x[some] @ v
                    if len(some) > k:  # rounding aside, the best are among these
                        near = score >= np.partition(score, -k)[-k] - 1e-9 * norm * norm
                        some = some[near]
                    score = (x[some] * v).sum(axis=1)  # one order of summation: ties stay ties
                    best = np.lexsort((ids[some], -score))[:k]
                    out.append((np.full(len(best), query_id), ids[some][best], score[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)],
                        names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", block: int = 8192, lines: int = 64,
            share: float = 0.6, candidates: float = 0.25, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query.

    Candidates are all rows but those with the query's own id; score is the
    inner product in double precision, ties go to the smaller id.  Defined
    cases: vectors that are NULL, empty, zero or hold NULL or non-finite
    components, and rows with a NULL id, take no part; vectors of different
    lengths are not compared; a repeated candidate row is returned once per
    row; a repeated query row is answered once; empty tables give an empty
    result.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine
                         & F.exists(v, lambda x: x != 0))
                .select(F.col(id_col).cast("long").alias("vec_id"),
                        v.cast("array<double>").alias("embedding")))

    data, asked = cut(usable(vectors)), cut(usable(queries).dropDuplicates(["vec_id"]))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    n, norm = data.agg(F.count("*"), F.sqrt(F.max(square))).first()
    blocks = max(1, -(-n // block))
    query_blocks = max(1, -(-asked.count() // block))

    def every(column: str, count: int, df: DataFrame) -> DataFrame:
        return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    salt = lambda m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    meets = every("qb", query_blocks, data.withColumn("db", salt(blocks))).withColumn(
        "kind", F.lit(0)).unionByName(every("db", blocks, asked.withColumn(
            "qb", salt(query_blocks))).withColumn("kind", F.lit(1)))
    meets = meets.withColumn("d", F.size("embedding"))
    found = meets.groupBy("db", "qb", "d").applyInArrow(
        _search(k, float(norm or 1.0), lines, share, candidates, seed), RESULT)
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op4_collision_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
