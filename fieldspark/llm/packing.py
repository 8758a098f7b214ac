"""Packing documents into token sequences by bin completion.

Pieces of documents have whole lengths from 1 to the capacity, so the packing
problem depends only on how many pieces have each length: a histogram of at
most ``capacity`` rows, however large the corpus.  Spark tokenizes, counts and
numbers the pieces; ``bin_completion`` packs the histogram; Spark then looks
up the place of each piece from its length and its number within that length.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import tidy
from .session import cut

# Characters on which all byte-level BPE libraries agree about letters and spaces.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧]")


@functools.lru_cache(maxsize=2)
def _rank_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@functools.lru_cache(maxsize=2)
def _file_encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_ids(text: str, vocabulary: str) -> list[int]:
    """Ids of ``<vocabulary>.json``.  Plain text takes the faster encoder over
    the same vocabulary as ranks; both give the same ids (tested)."""
    from public_tokenizers import path

    if PLAIN.search(text):
        return _file_encoder(path(f"{vocabulary}.json")).encode(
            text, add_special_tokens=False).ids
    return _rank_encoder(path(f"{vocabulary}.tiktoken")).encode_ordinary(text)


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces of a document: all of ``capacity`` but for a shorter first one."""
    first = length % capacity or min(length, capacity)
    cuts = [0, *range(first, length + 1, capacity)]
    return list(zip(cuts[:-1], cuts[1:]))


def pieces(vocabulary: str, end_id: int, capacity: int):
    """Rows of each piece, numbered within its task and length."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = []
                some = batch.slice(at, 512)
                for doc, text in zip(some["_id"].to_pylist(), some["_text"].to_pylist()):
                    ids = np.array([*token_ids(text, vocabulary), end_id], dtype="<u4")
                    for n, (i, j) in enumerate(piece_bounds(len(ids), capacity)):
                        rows.append((doc, n, i, j - i, zlib.crc32(ids[i:j].tobytes()), part,
                                     seen[j - i]))
                        seen[j - i] += 1
                types = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return tidy(run)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: [(lengths in a bin, bins)]."""
    room: dict[int, list] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for r in sorted(r for r in room if r >= length):
            while left and room.get(r):
                fill, bins = room[r].pop()
                each = r // length
                use = min(bins, left // each)
                if use < bins:
                    room[r].append((fill, bins - use))
                if use:
                    room.setdefault(r - each * length, []).append((fill | {length: each}, use))
                    left -= use * each
                else:  # fewer pieces left than one bin takes
                    fill, bins = room[r].pop()
                    if bins > 1:
                        room[r].append((fill, bins - 1))
                    room.setdefault(r - left * length, []).append((fill | {length: left}, 1))
                    left = 0
        each = capacity // length
        if left // each:
            room.setdefault(capacity - each * length, []).append(({length: each}, left // each))
        if left % each:
            room.setdefault(capacity - left % each * length, []).append(({length: left % each}, 1))
    return [x for bins in room.values() for x in bins if x[1]]


class Budget:
    """Fillings that the search may still look at."""

    def __init__(self, fillings: int):
        self.left = fillings


def reachable(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Sums up to ``room`` of the pieces of ``sizes[k:]``, a bit each, for every k."""
    every = (1 << room + 1) - 1
    bits, out = 1, [1]
    for size in reversed(sizes):
        n, step = min(counts[size], room // size), 1
        while n:  # 1, 2, 4 ... pieces and the remainder give every number of them
            step = min(step, n)
            bits |= (bits << size * step) & every
            n -= step
            step *= 2
        out.append(bits)
    return out[::-1]


def dominated(fill: dict[int, int], free: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether a piece that is left out could take the place of some in the
    filling (of none, if it fits into the free room): s <= piece <= s + free."""
    sums = 1  # of the pieces in the filling that are smaller than this size
    for size in reversed(sizes):
        n = fill.get(size, 0)
        if counts[size] > n and sums >> max(0, size - free) & ((1 << min(size, free) + 1) - 1):
            return True
        for _ in range(n):
            sums |= sums << size
    return False


def completions(sizes: list[int], counts: dict[int, int], room: int, waste: int, budget: Budget):
    """All undominated fillings of ``room`` that leave at most ``waste`` free,
    as (free, filling): fullest first, of equal ones larger pieces first.
    Ends early when the budget does."""
    sizes = [s for s in sizes if s <= room]
    reach = reachable(sizes, counts, room)
    for free in range(min(waste, room) + 1):
        if not reach[0] >> (room - free) & 1:
            continue
        stack = [(0, room - free, ())]
        while stack:
            k, need, chosen = stack.pop()
            if not need:
                if budget.left <= 0:
                    return
                budget.left -= 1
                fill = dict(chosen)
                if not dominated(fill, free, sizes, counts):
                    yield free, fill
                continue
            while sizes[k] > need:
                k += 1
            size = sizes[k]
            for n in range(min(counts[size], need // size) + 1):  # the largest comes first
                if reach[k + 1] >> (need - n * size) & 1:
                    stack.append((k + 1, need - n * size, chosen + ((size, n),) if n else chosen))


def _probe(counts: dict[int, int], capacity: int, limit: int, allowed: int, budget: Budget):
    """Depth-first over bins around the largest piece left, at most ``allowed``
    discrepancies from the first choices: (bins or None, whether any branch
    was left out for its discrepancies)."""
    left = dict(counts)
    slack = limit * capacity - sum(k * n for k, n in left.items())  # waste still allowed
    path: list[tuple[dict[int, int], int, int, int]] = []
    skipped = False

    def branches(last):
        nonlocal skipped
        largest = max(left)
        have = left | {largest: left[largest] - 1}
        sizes = sorted((s for s, n in have.items() if n), reverse=True)
        nth, may, rest = 0, allowed, slack
        for free, fill in completions(sizes, have, capacity - largest, rest, budget):
            fill[largest] = fill.get(largest, 0) + 1
            if fill == last:  # more bins of it are a branch of the node before
                continue
            if nth > may:
                skipped = True
                return
            times = min((have[s] + (s == largest)) // n for s, n in fill.items())
            times = min(times, rest // free) if free else times
            for fewer in range(times):
                if nth + fewer > may:
                    skipped = True
                    break
                yield fill, times - fewer, free, nth + fewer
            nth += 1

    stack = [branches(None)]
    while stack:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if path:
                fill, times, free, cost = path.pop()
                slack += free * times
                allowed += cost
                for s, n in fill.items():
                    left[s] = left.get(s, 0) + n * times
            continue
        fill, times, free, cost = branch
        path.append(branch)
        slack -= free * times
        allowed -= cost
        for s, n in fill.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        if not left:
            return [x[:2] for x in path], skipped
        stack.append(branches(fill))
    return None, skipped


def bin_completion(counts: dict[int, int], capacity: int,
                   effort: int = 60_000) -> list[tuple[dict[int, int], int]]:
    """Bins of a histogram of lengths: [({length: pieces in a bin}, bins)].

    Best-fit decreasing is the incumbent.  Branch and bound looks for a packing
    with one bin less: bins are completed around the largest piece with
    undominated fillings, a kind of bin as often as it can be and then less
    often, and a branch is cut as soon as its waste exceeds what the improvement
    allows.  Branches come in the order of their discrepancies.  Ends at the
    bound given by the total length, when no branch is left (the packing is
    then optimal), or after ``effort`` fillings.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    bound = max(-(-sum(k * n for k, n in counts.items()) // capacity),
                sum(n for k, n in counts.items() if 2 * k > capacity))
    budget, allowed = Budget(effort), 0
    while (bins := sum(n for _, n in best)) > bound and budget.left > 0:
        found, skipped = _probe(counts, capacity, bins - 1, allowed, budget)
        if found:
            best, allowed = found, 0
        elif not skipped:
            break
        else:
            allowed += 1
    return best


def _slots(bins: list[tuple[dict[int, int], int]]):
    """Per length: first number, first sequence, pieces a bin, first offset."""
    used: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for fill, times in bins:
        at = 0
        for length, each in sorted(fill.items(), reverse=True):
            first = used.get(length, 0)
            table.setdefault(length, []).append((first, sequence, each, at))
            used[length] = first + each * times
            at += each * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in table.items()}


def place(slots):
    def run(batches):
        for batch in batches:
            length, nth = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                here = length == size
                table = slots[int(size)]
                row = table[np.searchsorted(table[:, 0], nth[here], side="right") - 1]
                k = nth[here] - row[:, 0]
                sequence[here] = row[:, 1] + k // row[:, 2]
                offset[here] = row[:, 3] + k % row[:, 2] * size
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 1024, end_id: int = 2,
                   vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Defined cases: a NULL or empty text is the end id alone; a NULL id is
    returned as NULL; repeated rows are packed each; an empty table gives an
    empty result.  The tables sent to the tasks have at most ``capacity``
    lengths and, as each bin kind uses up a length or its remainder, a number
    of rows that does not depend on the corpus.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.coalesce(text_col, F.lit("")).alias("_text"))
    cutup = cut(base.mapInArrow(pieces(vocabulary, end_id, capacity), (
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")))
    by_task = cutup.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base_of = cut(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in base_of.groupBy("length").agg(F.sum("n")).collect()}
    slots = _slots(bin_completion(counts, capacity))
    numbered = cutup.join(base_of.drop("n"), ["length", "part"]).withColumn(
        "number", F.col("base") + F.col("nth"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(
        place(slots), ("doc_id long, piece int, start long, length long, ids_crc32 long, "
                       "sequence_id long, offset long"))


def op5_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")
                          .select("doc_id", "text"))
