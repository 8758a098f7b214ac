"""Hashed text features and bounded training samples of the text classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Block, Rolling, Words, byte_values, mix
from .repeats import _chunks

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def letter_runs(block: Block, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of every maximal run of letters (A-Z folded) and its document.

    With ``prefix``: hash, hash of the first bytes of each longer run, which
    runs are longer, document.
    """
    data = block.data
    inside = _LETTER[data]
    begin = block.offsets[:-1][block.offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[begin[begin > 0] - 1] = inside[begin[begin > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    roll = Rolling(byte_values(_FOLD[data]))
    values = roll.spans(start, end)
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    if not prefix:
        return values, doc
    longer = end - start > prefix
    return values, roll.windows(start[longer], prefix), longer, doc


def shapes(block: Block, words: Words) -> np.ndarray:
    """Hash of the shape of each word: first and last byte class, whether it has
    lower-case letters, digits, symbols, punctuation, and its length."""
    data = block.data
    kind = np.full(256, 5, dtype=np.int64)  # other ASCII
    kind[97:123] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[128:] = 1
    kind[[ord(c) for c in ".,;:!?'\"-()"]] = 4
    of = kind[data]
    flags = np.zeros(len(words.start), dtype=np.int64)
    for k in range(1, 6):
        total = np.concatenate([[0], np.cumsum(of == k)])
        count = total[words.end] - total[words.start]
        flags = flags * 4 + np.minimum(count, 3 if k in (2, 5) else 1)
    ends = of[words.start] * 8 + of[words.end - 1] if len(words.start) else flags
    size = np.minimum(words.end - words.start, 40) // 8
    return mix((flags * 4096 + ends * 64 + size).astype(U64) + U64(1 << 40))


def document_features(block: Block, buckets: int, style: bool) -> tuple[np.ndarray, ...]:
    """Feature bucket, document and count, one entry per distinct pair.

    Letter runs are hashed to ``buckets``.  With ``style``, so are the shape
    of each word, whether a word or line repeats one shortly before, and the
    words of each document are counted.
    """
    values, doc = letter_runs(block)
    n_docs = len(block.lengths)
    if style:
        words = Words(block)
        owner = np.repeat(np.arange(n_docs), words.counts)
        tokens = [values, shapes(block, words)]
        owners = [doc, owner]
        for back in (1, 2, 3, 5, 8):
            same = np.zeros(len(owner), dtype=bool)
            same[back:] = (words.hash[back:] == words.hash[:-back]) & (owner[back:] == owner[:-back])
            tokens.append(np.full(int(same.sum()), back, dtype=U64) * U64(0x9E3779B97F4A7C15))
            owners.append(owner[same])
        values, doc = np.concatenate(tokens), np.concatenate(owners)
    pair = doc.astype(np.int64) * buckets + (values % U64(buckets)).astype(np.int64)
    pair, count = np.unique(pair, return_counts=True)
    return pair % buckets, pair // buckets, count


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """Texts of at most ``limit`` labelled documents, chosen by a hash of doc_id.

    The sample bounds what is broadcast; a document with several labels takes
    the smallest one that is not NULL.
    """
    chosen = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min(target).cast("int").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
            .join(F.broadcast(chosen), "doc_id"))


def sample_features(buckets: int, style: bool):
    def run(batches):
        for table in _chunks(batches):
            feature, doc, count = document_features(Block(table["_text"]), buckets, style)
            ends = np.searchsorted(doc, np.arange(len(table) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), table["_y"].combine_chunks(),
                 pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
                names=["doc_id", "y", "features", "counts"])

    return run


class Sparse:
    """Rows of a sparse matrix with the products a linear model needs."""

    def __init__(self, index, indptr, value, width: int):
        self.index, self.value, self.width = index, value, width
        self.row = np.repeat(np.arange(len(indptr) - 1, dtype=np.int64), np.diff(indptr))
        self.n = len(indptr) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=self.n)

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row] * self.value, minlength=self.width)


def collect_sample(texts: DataFrame, buckets: int, style: bool, least: int):
    """Labels, kept features and (row, feature, count) of a bounded sample.

    Features of fewer than ``least`` documents are dropped.
    """
    rows = texts.mapInArrow(sample_features(buckets, style),
                            "doc_id long, y int, features array<int>, counts array<int>")
    table = rows.toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    y = table["y"].to_numpy().astype(int)
    lists = table["features"].combine_chunks()
    feature = lists.flatten().to_numpy()
    count = table["counts"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    seen = np.bincount(feature, minlength=buckets)
    kept = np.flatnonzero(seen >= least)
    place = np.full(buckets, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    ok = place[feature] >= 0
    return y, kept, row[ok], place[feature[ok]], count[ok]


def adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (
            np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
