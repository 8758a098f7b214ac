"""Exact removal of repeated windows over a whole corpus (shared by the byte
and the word operator).

A *window* is ``scheme.window`` consecutive units (bytes or words) of one
document; every unit covered by a window that also starts earlier (smaller
doc_id, or same document and earlier start) goes.  Both operators run the
same three Spark phases and differ in the units and in how seeds are chosen:

1. *Names of sampled positions.*  Every document yields the seeds its scheme
   samples.  Blocks of documents send packed, sorted names to hash ranges;
   a range sorts the names it gets and reports the positions whose name is
   not unique.  Unique names are discarded: no repeated window touches them.
2. *Remaining windows.*  The windows around surviving seeds are named over
   their whole length, sorted by name, and each window is compared with the
   adjacent one.  All but the first of equal windows are reported.  This is
   done in a few turns over ranges of the names, to bound the disk in use.
3. *Removal.*  Reported windows are merged into maximal runs per document
   and cut out of the texts.

A block keeps one entry for equal names, so a passage that a third of the
corpus shares adds one entry per block to a range.  Texts never pass through
one task or the driver; only packed names travel.  Copies of a whole text
are settled by their digest: the copy with the smallest doc_id stays.

Names in phase 2 have 96 bits (64 of one fingerprint, 32 of another with its
own base): n windows give n * n / 2**97 wrong removals on average, 6e-10 for
10**10 windows (30 GB) and 0.003 for 2 * 10**13 (100 TB).

The number of name ranges follows from the number of names, not from the
number of partitions.  A block sends at most ``FANOUT`` packets; with more
ranges than that, packets of several blocks are gathered and split again, a
digit of the range at a time, so the packets grow with the names and not with
blocks times ranges.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import (Block, Rolling, Words, byte_values, merge_spans, mix, pack, pack_sorted,
                      tidy, unpack, unpack_sorted)
from .session import cut, partitions

SEED_BYTES = 6
NAME_BYTES = 8
SECOND_BYTES = 4  # of a second fingerprint of windows
SECOND_SHIFT = np.uint64(64 - 8 * SECOND_BYTES)
RANGE_NAMES = 500_000
FANOUT = 1024
CHUNK_BYTES = 1 << 20
SMALLEST = -(2**63)
SECOND_BASE = 0xA0761D6478BD642F

PACKETS = "block long, kind int, bucket long, payload binary"
SPANS = "_k long, _h long, _m binary, n_units long, starts array<long>, ends array<long>"


@dataclass(frozen=True)
class Scheme:
    """Units, window length and seed sampling of one operator."""

    window: int
    seed: int

    def units(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Value of every unit of the block, unit offsets of its documents."""
        raise NotImplementedError

    def seeds(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled unit positions and their 64-bit names."""
        raise NotImplementedError

    def seeds_per_byte(self) -> float:
        """About how many seeds a byte of text yields."""
        return 1.0

    def keep(self, block: Block, starts, ends, doc) -> tuple[np.ndarray, np.ndarray]:
        """Bytes left of each document (offsets, data) without the unit spans."""
        raise NotImplementedError


@dataclass(frozen=True)
class Bytes(Scheme):
    cover: tuple[int, ...] = ()
    period: int = 1

    def units(self, block):
        return byte_values(block.data), block.offsets

    def seeds_per_byte(self):
        return len(self.cover) / self.period

    def seeds(self, values, offsets):
        room = np.maximum(np.diff(offsets) - self.seed + 1, 0)
        room[np.diff(offsets) < self.window] = 0
        cover = np.array(sorted(self.cover))
        fits = np.searchsorted(cover, np.arange(self.period))
        count = room // self.period * len(cover) + fits[room % self.period]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pos = np.repeat(offsets[:-1], count) + at // len(cover) * self.period \
            + cover[at % len(cover)]
        return pos, Rolling(values).windows(pos, self.seed)

    def keep(self, block, starts, ends, doc):
        edge = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        mask = np.cumsum(edge[:-1]) == 0
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[block.offsets], block.data[mask]


@dataclass(frozen=True)
class WordRuns(Scheme):
    def units(self, block):
        words = Words(block)
        return words.hash, words.offsets

    def seeds_per_byte(self):
        return 2 / (self.window - self.seed + 2) / 6

    def seeds(self, values, offsets):
        """Winnowing: the smallest of the seed hashes in each window (the
        last one on ties), so equal windows choose the same anchor."""
        n = len(values) - self.seed + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = Rolling(values).windows(np.arange(n), self.seed)
        span = self.window - self.seed + 1
        begin = window_starts(offsets, self.window)
        if not len(begin):
            return begin, np.zeros(0, np.uint64)
        best, where = grams[begin].copy(), begin.copy()
        for k in range(1, span):
            other = grams[begin + k]
            less = other <= best
            best[less] = other[less]
            where[less] = begin[less] + k
        where = np.unique(where)
        return where, grams[where]

    def keep(self, block, starts, ends, doc):
        words = Words(block)
        edge = np.zeros(len(words.start) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        kept = np.cumsum(edge[:-1]) == 0
        s, e = words.start[kept], words.end[kept]
        owner = np.searchsorted(words.offsets, np.flatnonzero(kept), side="right") - 1
        size = e - s
        gap = np.zeros(len(s), dtype=np.int64)
        gap[:-1] = owner[1:] == owner[:-1]
        out_end = np.cumsum(size + gap)
        before = np.cumsum(size) - size
        out = np.full(int(out_end[-1]) if len(s) else 0, 32, dtype=np.uint8)
        step = np.arange(int(size.sum()))
        out[step + np.repeat(out_end - size - gap - before, size)] = \
            block.data[step + np.repeat(s - before, size)]
        bounds = np.concatenate([[0], out_end])[np.searchsorted(owner, np.arange(
            len(block.offsets)))]
        return bounds, out


def window_starts(offsets: np.ndarray, window: int) -> np.ndarray:
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    return np.arange(count.sum()) + np.repeat(offsets[:-1] - np.cumsum(count) + count, count)


def _chunks(batches, text: str = "_text"):
    """Slices of the batches with about CHUNK_BYTES of text each."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        size = np.cumsum(Block(table[text]).lengths)
        at = 0
        while at < len(size):
            limit = (size[at - 1] if at else 0) + CHUNK_BYTES
            to = max(at + 1, int(np.searchsorted(size, limit, side="right")))
            yield table.slice(at, to - at)
            at = to


class Ranges:
    """Equal ranges of names of ``width`` bytes, reached in ``levels`` digits."""

    def __init__(self, names: float, width: int, per_range: int = 0, fanout: int = 0):
        self.width, self.fanout, self.levels = width, fanout or FANOUT, 1
        wanted = max(1, math.ceil(names / (per_range or RANGE_NAMES)))
        while self.fanout**self.levels < wanted:
            self.levels += 1
        self.digit = math.ceil(wanted ** (1 / self.levels))  # ranges split in one step

    def of(self, names: np.ndarray, level: int) -> np.ndarray:
        """Range of each name when ``level`` digits are known (ascending with the name)."""
        scale = self.digit**level / 2.0 ** (8 * self.width)
        return np.minimum((names * scale).astype(np.int64), self.digit**level - 1)


def _packet_rows(ranges: Ranges, level: int, names, second, block, pos):
    """(bucket, payload) per range of names sorted ascending.

    A payload has the blocks it draws from and, per name, the name, its second
    half, the place of its block among them and the position in the block.
    """
    bucket = ranges.of(names, level)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(names)]):
        owners, owner = np.unique(block[i:j], return_inverse=True)
        place = 3 if pos[i:j].max() < 1 << 24 else 4
        parts = [(names[i:j], ranges.width), (pos[i:j].astype(np.uint64), place)]
        if second is not None:
            parts.append((second[i:j], SECOND_BYTES))
        if len(owners) > 1:
            parts.append((owner.astype(np.uint64), 4))
        head = bytes([place]) + len(owners).to_bytes(4, "little") + owners.astype("<i8").tobytes()
        yield int(bucket[i]), head + pack(*parts)


def _open_packet(payload: bytes, width: int, wide: bool):
    """Names, second halves (or None), blocks and positions of a payload."""
    n = int.from_bytes(payload[1:5], "little")
    owners = np.frombuffer(payload, "<i8", n, 5)
    widths = [width, payload[0]] + [SECOND_BYTES] * wide + [4] * (n > 1)
    names, pos, *rest = unpack(payload[5 + 8 * n:], *widths)
    second = rest.pop(0) if wide else None
    block = owners[rest[0].astype(np.int64)] if n > 1 else np.repeat(owners, len(names))
    return names, second, block, pos.astype(np.int64)


def _batch(rows):
    """Rows of (block, kind, bucket, payload) as Arrow batches."""
    for k in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows[k:k + 256]), (
                pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
            names=["block", "kind", "bucket", "payload"])


class Packer:
    """Gathers names of a block of documents and writes its packets."""

    def __init__(self, scheme: Scheme, ranges: Ranges, whole_groups: bool, limit: int):
        self.ranges, self.whole_groups, self.limit = ranges, whole_groups, limit
        self.reset()

    def reset(self):
        self.names, self.second, self.pos, self.docs = [], [], [], []
        self.base = self.held = 0

    def add(self, names, pos, docs, n_units: int, second=None):
        self.names.append(names >> np.uint64(64 - 8 * self.ranges.width))
        if second is not None:
            self.second.append(second)
        self.pos.append(pos + self.base)
        self.docs.append(docs)
        self.base += n_units
        self.held += len(pos) + len(docs[0])

    def full(self) -> bool:
        return self.held >= self.limit or self.base >= 2**31

    def flush(self, block: int):
        names, pos = np.concatenate(self.names), np.concatenate(self.pos)
        second = np.concatenate(self.second) if self.second else None
        order, first = _sorted_groups(names, second)
        names, pos = names[order], pos[order]
        here = ~first  # repeated within the block: known without a shuffle
        if self.whole_groups:
            here[:-1] |= ~first[1:]
        docs = [np.concatenate(x) for x in zip(*self.docs)]
        known = pack_sorted(np.sort(pos[here]))
        rows = [(block, 0, -1 - block, pickle.dumps((docs, known)))]
        second = second[order][first] if second is not None else None
        names, pos = names[first], pos[first]
        of = np.full(len(names), block, dtype=np.int64)
        rows += [(block, 1, b, p) for b, p in _packet_rows(self.ranges, 1, names, second, of, pos)]
        self.reset()
        yield from _batch(rows)


def _sorted_groups(names, second):
    """Stable order of the names, and where in it a name differs from the one before."""
    order = np.argsort(names, kind="stable")
    first = np.ones(len(names), dtype=bool)
    first[1:] = names[order[1:]] != names[order[:-1]]
    if second is not None and len(names):
        other = second[order[1:]] != second[order[:-1]]
        if (other & ~first[1:]).any():  # equal first halves only: sort by both
            order = np.lexsort((second, names))
            first[1:] = (names[order[1:]] != names[order[:-1]]) | (
                second[order[1:]] != second[order[:-1]])
    return order, first


def refine(ranges: Ranges, level: int, wide: bool, limit: int):
    """Packets of one coarser range at a time -> packets of its finer ranges."""

    def run(batches):
        held: list[tuple] = []
        count, bucket = 0, None

        def split():
            names, second, block, pos = (
                None if x[0] is None else np.concatenate(x) for x in zip(*held))
            order = np.argsort(names, kind="stable")
            second = second[order] if second is not None else None
            yield from _batch([(-1, 1, b, p) for b, p in _packet_rows(
                ranges, level, names[order], second, block[order], pos[order])])

        for batch in batches:
            done = []
            for block, kind, b, payload in zip(*(batch[c].to_pylist() for c in (
                    "block", "kind", "bucket", "payload"))):
                if kind == 0:
                    done.append((block, 0, b, payload))
                    continue
                if held and (b != bucket or count >= limit):
                    yield from split()
                    held, count = [], 0
                bucket = b
                held.append(_open_packet(payload, ranges.width, wide))
                count += len(held[-1][0])
            if done:
                yield from _batch(done)
        if held:
            yield from split()

    return tidy(run)


def _doc_arrays(table: pa.Table, n_units: np.ndarray):
    md5 = table["_m"].combine_chunks() if "_m" in table.column_names else None
    digest = np.frombuffer(b"".join(md5.to_pylist()), dtype="S16") if md5 is not None \
        else np.zeros(len(table), dtype="S16")
    return (table["_k"].to_numpy(), table["_h"].to_numpy(), digest, n_units)


def seed_packets(scheme: Scheme, ranges: Ranges, limit: int):
    def run(batches):
        packer = Packer(scheme, ranges, True, limit)
        part, serial = TaskContext.get().partitionId() << 24, 0
        for table in _chunks(batches):
            values, offsets = scheme.units(Block(table["_text"]))
            pos, names = scheme.seeds(values, offsets)
            packer.add(names, pos, _doc_arrays(table, np.diff(offsets)), len(values))
            if packer.full():
                yield from packer.flush(part + serial)
                serial += 1
        if packer.docs:
            yield from packer.flush(part + serial)

    return tidy(run)


def window_packets(scheme: Scheme, ranges: Ranges, limit: int, turn: int, turns: int):
    """Names of the windows around surviving seeds whose name belongs to this
    turn.  Rows come sorted by document; a row with spans precedes its text."""

    def run(batches):
        packer = Packer(scheme, ranges, False, limit)
        part, serial = TaskContext.get().partitionId() << 24, 0
        wanted = None
        for table in _chunks(batches):
            rows, spans = [], []
            for r, (k, h, kind, s, e) in enumerate(zip(*(table[c].to_pylist() for c in (
                    "_k", "_h", "kind", "starts", "ends")))):
                if kind == 0:
                    wanted = (k, h, s, e)
                elif wanted and wanted[:2] == (k, h):
                    rows.append(r)
                    spans.append((np.array(wanted[2]), np.array(wanted[3])))
                    wanted = None  # a repeated row counts once
            if not rows:
                continue
            piece = table.take(rows)
            values, offsets = scheme.units(Block(piece["_text"]))
            s = np.concatenate([x[0] + o for x, o in zip(spans, offsets)])
            size = np.concatenate([x[1] - x[0] for x in spans])
            pos = np.arange(size.sum()) + np.repeat(s - np.cumsum(size) + size, size)
            names = Rolling(values).windows(pos, scheme.window)
            if turns > 1:
                now = mix(names) % np.uint64(turns) == turn
                names, pos = names[now], pos[now]
            second = Rolling(values, SECOND_BASE).windows(pos, scheme.window) >> SECOND_SHIFT
            packer.add(names, pos, _doc_arrays(piece, np.diff(offsets)), len(values), second)
            if packer.full():
                yield from packer.flush(part + serial)
                serial += 1
        if packer.docs:
            yield from packer.flush(part + serial)

    return tidy(run)


def compare_adjacent(width: int, keep_first: bool, wide: bool = False):
    """Sorts the names of one range at a time and reports repeated ones."""

    def report(rows):
        parts = [_open_packet(p, width, wide) for _, p in rows]
        parts.sort(key=lambda p: p[2][0])
        names, second, block, pos = (
            None if x[0] is None else np.concatenate(x) for x in zip(*parts))
        del parts
        if (block[1:] < block[:-1]).any():  # refined packets mix blocks
            at = np.argsort(block, kind="stable")
            names, block, pos = names[at], block[at], pos[at]
            second = second[at] if second is not None else None
        # A block has a name once and blocks are in document order: so are equal names.
        order, first = _sorted_groups(names, second)
        same = np.append(~first, False)
        hit = order[same[:-1] if keep_first else same[:-1] | same[1:]]
        hit.sort()
        block, pos = block[hit], pos[hit]
        cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
        out = [(int(block[i]), 1, pack_sorted(np.sort(pos[i:j])))
               for i, j in zip(cuts, [*cuts[1:], len(block)])]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[c] for x in out], t)
             for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
            names=["block", "kind", "payload"])

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            done = []
            for block, kind, b, payload in zip(*(batch[c].to_pylist() for c in (
                    "block", "kind", "bucket", "payload"))):
                if kind == 0:
                    done.append((block, 0, payload))
                    continue
                if b != bucket and rows:
                    yield report(rows)
                    rows = []
                bucket = b
                rows.append((block, payload))
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in done], t)
                     for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                    names=["block", "kind", "payload"])
        if rows:
            yield report(rows)

    return tidy(run)


def block_spans(before: int, after: int, shorter: int):
    """Positions of a block -> merged spans per document."""

    def finish(docs, found):
        keys, hashes, digests, n_units = docs
        offsets = np.concatenate([[0], np.cumsum(n_units)])
        pos = np.unique(np.concatenate(found))
        limit = np.maximum(offsets[1:] - shorter, offsets[:-1])
        start, end, doc = merge_spans(pos, before, after, offsets, limit)
        lists = np.searchsorted(doc, np.arange(len(keys) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(hashes), pa.array([bytes(x).ljust(16, b"\0") for x in digests],
                                                       pa.binary()), pa.array(n_units),
             pa.ListArray.from_arrays(lists, pa.array(start - offsets[doc])),
             pa.ListArray.from_arrays(lists, pa.array(end - offsets[doc]))],
            names=["_k", "_h", "_m", "n_units", "starts", "ends"])

    def run(batches):
        for docs, found in blocks(batches):
            yield finish(docs, found)

    return tidy(run)


def blocks(batches):
    """(documents, lists of reported positions) of each block; rows are sorted
    by block, the row with its documents first."""
    block, docs, found = None, None, []
    for b, kind, payload in chain.from_iterable(
            zip(*(x[c].to_pylist() for c in ("block", "kind", "payload"))) for x in batches):
        if b != block:
            if docs:
                yield docs, found
            block, docs, found = b, None, []
        if kind == 0:
            docs, known = pickle.loads(payload)
            found.append(unpack_sorted(known))
        else:
            found.append(unpack_sorted(payload))
    if docs:
        yield docs, found


def gathered(packets: DataFrame, ranges: Ranges, wide: bool, limit: int) -> DataFrame:
    """Packets sorted by the finest ranges, in as many steps as it has digits."""
    n = partitions(packets.sparkSession)
    sort = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    packets = sort(packets)
    for level in range(2, ranges.levels + 1):
        packets = sort(packets.mapInArrow(refine(ranges, level, wide, limit), PACKETS))
    return packets


def _spans(packets: DataFrame, ranges: Ranges, limit: int, keep_first: bool, before: int, after: int,
           shorter: int) -> DataFrame:
    n = partitions(packets.sparkSession)
    return (gathered(packets, ranges, keep_first, limit)
            .mapInArrow(compare_adjacent(ranges.width, keep_first, keep_first),
                        "block long, kind int, payload binary")
            .repartition(n, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(block_spans(before, after, shorter), SPANS))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0


def repeated_spans(docs: DataFrame, scheme: Scheme, block_names: int, turns: int) -> DataFrame:
    """Unit spans to remove: ``_k, _h, starts, ends``, lists of span lists.

    ``docs`` has ``_k`` (doc_id, NULL as the smallest), ``_h`` and ``_m``
    (hashes of the text) and ``_text``.  Documents with nothing to remove
    are left out.  The windows are compared in ``turns`` ranges of their
    names, one after the other, so only a part of them is on disk at a time.
    """
    n = partitions(docs.sparkSession)
    reach = scheme.window - scheme.seed
    ranges = Ranges(text_bytes(docs) * scheme.seeds_per_byte(), SEED_BYTES)
    seeded = cut(_spans(docs.mapInArrow(seed_packets(scheme, ranges, block_names), PACKETS),
                        ranges, block_names, False, reach, 1, scheme.window - 1))
    # A copy of a whole text loses every unit to the copy with the smallest doc_id.
    first = seeded.groupBy("_m").agg(F.min("_k").alias("_first"))
    marked = cut(seeded.join(first, "_m").select(
        "_k", "_h", "n_units", "starts", "ends", (F.col("_k") > F.col("_first")).alias("copy"))
        .where(F.col("copy") | (F.size("starts") > 0)).dropDuplicates(["_k", "_h"]))
    text, spans = F.lit(None).cast("string"), F.lit(None).cast("array<long>")
    around = marked.where(~F.col("copy")).select(
        "_k", "_h", F.lit(0).alias("kind"), text.alias("_text"), "starts", "ends")
    both = around.unionByName(docs.select(
        "_k", "_h", F.lit(1).alias("kind"), "_text", spans.alias("starts"), spans.alias("ends")))
    found = marked.where(F.col("copy") & (F.col("n_units") >= scheme.window)).select(
        "_k", "_h", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_units").alias("ends"))
    size = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"),
                       lambda a, x: a + x)
    windows = marked.where(~F.col("copy")).agg(F.sum(size)).first()[0] or 0
    ranges = Ranges(windows / turns, NAME_BYTES)
    for turn in range(turns):
        windows = (both.repartitionByRange(n, "_k", "_h").sortWithinPartitions("_k", "_h", "kind")
                   .mapInArrow(window_packets(scheme, ranges, block_names, turn, turns), PACKETS))
        later = cut(_spans(windows, ranges, block_names, True, 0, scheme.window, 0)
                    .where(F.size("starts") > 0).select("_k", "_h", "starts", "ends"))
        found = found.unionByName(later)
    return cut(found.groupBy("_k", "_h").agg(F.collect_list("starts").alias("starts"),
                                             F.collect_list("ends").alias("ends"))
               .select("_k", "_h", F.flatten("starts").alias("starts"),
                       F.flatten("ends").alias("ends")))


def union_of_spans(start, end, doc):
    """Sorted, disjoint spans of each document from spans in any order."""
    order = np.lexsort((start, doc))
    start, end, doc = start[order], end[order], doc[order]
    if not len(start):
        return start, end, doc
    shift = doc * (np.int64(end.max()) + 1)  # documents apart, so one running maximum will do
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] + shift[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(start) - 1]])
    return start[at], (reach - shift)[last], doc[at]


def keep_rest(scheme: Scheme, columns: list[str]):
    def run(batches):
        for table in _chunks(batches):
            block = Block(table["_text"])
            _, offsets = scheme.units(block)
            starts, ends = (table[c].combine_chunks() for c in ("starts", "ends"))
            n = np.diff(starts.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), n)
            s, e, doc = union_of_spans(starts.flatten().to_numpy(), ends.flatten().to_numpy(), doc)
            lists = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            removed = np.bincount(doc, weights=e - s, minlength=len(n)).astype(np.int64)
            bounds, data = scheme.keep(block, s + offsets[doc], e + offsets[doc], doc)
            kept = pa.Array.from_buffers(pa.large_binary(), len(n), [
                None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)),
                pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            cols = [table[c].combine_chunks() for c in columns] + [
                pa.array(np.diff(offsets)), pa.array(removed),
                pa.array(np.diff(lists).astype(np.int64)),
                pa.ListArray.from_arrays(lists, pa.array(s)),
                pa.ListArray.from_arrays(lists, pa.array(e)), kept]
            out = pa.Table.from_arrays(cols, names=[
                *columns, "n_units", "n_removed", "n_spans", "starts", "ends", "kept"])
            yield from out.to_batches()

    return tidy(run)


def remove_repeats(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str,
                   block_names: int, turns: int) -> DataFrame:
    """Rows ``_row`` (the input row), ``n_units``, ``n_removed``, ``n_spans``,
    ``starts``, ``ends`` (removed unit spans) and ``kept`` (bytes left)."""
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST)).alias("_k"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_m"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("_row"))
    spans = repeated_spans(base.drop("_row"), scheme, block_names, turns)
    empty = F.array().cast("array<long>")
    rows = (base.drop("_m").join(spans, ["_k", "_h"], "left")
            .select("_row", "_text", F.coalesce("starts", empty).alias("starts"),
                    F.coalesce("ends", empty).alias("ends")))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["_row"], *(T.StructField(c, t) for c, t in (
        ("n_units", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()),
        ("starts", longs), ("ends", longs), ("kept", T.BinaryType())))])
    return rows.mapInArrow(keep_rest(scheme, ["_row"]), schema)
