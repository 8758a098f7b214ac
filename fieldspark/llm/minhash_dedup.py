"""Near-duplicate detection with b-bit MinHash.

1. Every document's set of distinct word shingles gives ``bands * rows``
   minima.  The minima of a band, taken whole, are hashed to a bucket key;
   of each minimum only ``BITS`` bits of its hash are kept, packed into longs.
2. Documents with equal sets form one class; only one of them goes on.
3. Bands are taken a few at a time.  In each bucket one member of each
   component is paired with the bucket's centre.  Packed signatures estimate
   the similarity by bit counts, corrected for chance agreement of ``BITS``
   bits; pairs far below the threshold are dropped, the others are confirmed on
   the full sets, and what is linked is one component in the bands that follow.
4. Members of a bucket that are still in different components are paired
   with each other, so that a link between two non-centres is
   not lost.  Pairs within one component are never made.  For this last step
   the shingles that no other such document has are counted: at most the rest
   can be shared, and pairs that cannot reach the threshold even if all of it
   were are not made either; nor are pairs whose shingle bitmaps differ in so
   many bits that the threshold is out of reach.

A pair at the threshold shares no band with probability
``(1 - threshold**rows)**bands``: 5e-6 at 0.75 with 32 bands of 4 rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, Block, Rolling, Words, mix, tidy
from .repeats import (PACKETS, SEED_BYTES, SMALLEST, Ranges, Scheme, _chunks, blocks,
                      compare_adjacent, gathered, seed_packets, text_bytes)
from .session import cut, partitions

BITS = 2
BLOCK_NAMES = 1_000_000
SIGNATURES = ("_k long, _id long, n_shingles long, set_a long, set_b long, keys array<long>, "
              "packed array<long>")


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, document offsets.

    A text of fewer than ``size`` words has its whole sequence as its only
    shingle, one without words has none.
    """
    words = Words(block, lower=True)
    n = words.counts
    grams = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    start = np.arange(grams.sum()) + np.repeat(words.offsets[:-1] - np.cumsum(grams) + grams, grams)
    length = np.repeat(np.minimum(n, size), grams)
    values = Rolling(words.hash).spans(start, start + length)
    short = length < size
    values[short] = mix(values[short] + length[short].astype(U64))
    edges = np.concatenate([[0], np.cumsum(grams)])
    new = np.ones(len(values), dtype=bool)
    for i, j in zip(edges[:-1], edges[1:]):
        values[i:j].sort()
    new[1:] = values[1:] != values[:-1]
    new[edges[:-1][grams > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return values[new], total[edges]


def signatures(size: int, bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    factors = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)

    def run(batches):
        for table in _chunks(batches):
            values, offsets = shingle_sets(Block(table["_text"]), size)
            count = np.diff(offsets)
            has = count > 0
            at = offsets[:-1][has]
            n = len(at)
            low = values.astype(np.uint32)
            keys = np.zeros((n, bands), dtype=U64)
            packed = np.zeros((n, bands * rows * BITS // 64), dtype=U64)
            a = np.zeros(n, dtype=U64)
            b = np.zeros(n, dtype=U64)
            if n:
                for j in range(bands * rows):
                    least = np.minimum.reduceat((low ^ flips[j]) * factors[j], at)
                    keys[:, j // rows] = mix(keys[:, j // rows] + least + U64(j * 2**32 + 1))
                    bit = j * BITS
                    # the low bits of the minima of a few elements agree for all j or for none
                    low_bits = mix(least + U64(j * 2**32 + 1)) & U64(2**BITS - 1)
                    packed[:, bit // 64] |= low_bits << U64(bit % 64)
                a = np.add.reduceat(values, at)
                b = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), at)
            full = np.zeros((2, len(count)), dtype=U64)
            full[0, has], full[1, has] = a, b

            def lists(m):
                ends = np.concatenate([[0], np.cumsum(has * m.shape[1])]).astype(np.int32)
                return pa.ListArray.from_arrays(ends, pa.array(m.view(np.int64).reshape(-1)))

            yield pa.RecordBatch.from_arrays(
                [table["_k"].combine_chunks(), table["_id"].combine_chunks(), pa.array(count),
                 pa.array(full[0].view(np.int64)), pa.array(full[1].view(np.int64)),
                 lists(keys), lists(packed)],
                names=["_k", "_id", "n_shingles", "set_a", "set_b", "keys", "packed"])

    return tidy(run)


def estimate(x: str, y: str, longs: int):
    """Similarity estimated from packed signatures: the share of equal values,
    corrected for values whose low bits agree by chance."""
    equal = F.lit(0)
    for i in range(longs):
        same = F.bitwise_not(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
        both = same.bitwiseAND(F.shiftrightunsigned(same, 1))
        equal = equal + F.bit_count(both.bitwiseAND(F.lit(0x5555555555555555)))
    share = equal / F.lit(longs * 64 // BITS)
    return (share - F.lit(2.0**-BITS)) / F.lit(1 - 2.0**-BITS)


def lowest_estimate(per_cent: int, values: int) -> float:
    """Six standard errors of ``estimate`` below the threshold."""
    similar, chance = per_cent / 100, 2.0**-BITS
    share = similar + (1 - similar) * chance
    return similar - 6 * (share * (1 - share) / values) ** 0.5 / (1 - chance)


def confirm(size: int, per_cent: int):
    """Pairs of texts -> the pairs whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ok = np.zeros(len(table), dtype=bool)
            step = 256
            for at in range(0, len(table), step):
                part = table.slice(at, step)
                x, xo = shingle_sets(Block(part["ta"]), size)
                y, yo = shingle_sets(Block(part["tb"]), size)
                for i in range(len(part)):
                    p, q = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
                    both = np.concatenate([p, q])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok[at + i] = 100 * common >= per_cent * (len(both) - common)
            yield pa.RecordBatch.from_arrays(
                [table["a"].combine_chunks(), table["b"].combine_chunks(), pa.array(ok)],
                names=["a", "b", "ok"])

    return tidy(run)


@dataclass(frozen=True)
class Shingles(Scheme):
    """Distinct shingles as units, each of them a seed of its own."""

    def units(self, block):
        return shingle_sets(block, self.seed)

    def seeds_per_byte(self):
        return 1 / 6

    def seeds(self, values, offsets):
        return np.arange(len(values)), values


def _count_found(batches):
    """Positions reported for a block -> their number per document."""

    def finish(docs, found):
        pos = np.unique(np.concatenate(found))
        offsets = np.concatenate([[0], np.cumsum(docs[3])])
        seen = np.diff(np.searchsorted(pos, offsets))
        return pa.RecordBatch.from_arrays([pa.array(docs[0]), pa.array(docs[3]), pa.array(seen)],
                                          names=["_k", "n", "common"])

    for docs, found in blocks(batches):
        yield finish(docs, found)


def shared_shingles(docs: DataFrame, size: int) -> DataFrame:
    """``_k, n, common``: shingles of each document, and how many of them
    another of these documents has too."""
    n = partitions(docs.sparkSession)
    scheme = Shingles(window=size, seed=size)
    ranges = Ranges(text_bytes(docs) * scheme.seeds_per_byte(), SEED_BYTES)
    packets = docs.withColumn("_h", F.lit(0).cast("long")).mapInArrow(
        seed_packets(scheme, ranges, BLOCK_NAMES), PACKETS)
    counts = (gathered(packets, ranges, False, BLOCK_NAMES)
              .mapInArrow(compare_adjacent(SEED_BYTES, False), "block long, kind int, payload binary")
              .repartition(n, "block").sortWithinPartitions("block", "kind")
              .mapInArrow(tidy(_count_found), "_k long, n long, common long"))
    return counts.groupBy("_k").agg(F.min("n").alias("n"), F.max("common").alias("common"))


def bitmaps(size: int):
    """Texts -> ``_k, bits``: a bit per shingle hash, at least eight bits a shingle.

    The number of bits is a power of two, so halves can be laid over each other.
    """

    def run(batches):
        for table in _chunks(batches):
            values, offsets = shingle_sets(Block(table["_text"]), size)
            count = np.diff(offsets)
            longs = 1 << np.ceil(np.log2(np.maximum(count * 8 / 64, 1))).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(longs)])
            spot = mix(values) & (np.repeat(longs, count) * 64 - 1).astype(U64)
            out = np.zeros(ends[-1], dtype=U64)
            np.bitwise_or.at(out, np.repeat(ends[:-1], count) + (spot >> U64(6)).astype(np.int64),
                             U64(1) << (spot & U64(63)))
            yield pa.RecordBatch.from_arrays(
                [table["_k"].combine_chunks(),
                 pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(out.view(np.int64)))],
                names=["_k", "bits"])

    return tidy(run)


def shared_at_most(x: str, y: str, n: str, m: str):
    """Upper bound of the intersection of two sets of ``n`` and ``m`` shingles:
    a bit that only one set has stands for a shingle that the other lacks."""
    least = F.least(F.size(x), F.size(y))

    def folded(c):
        halves = F.zip_with(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least),
                            lambda a, b: a.bitwiseOR(b))
        return F.when(F.size(c) == least, F.col(c)).when(F.size(c) == 2 * least, halves)

    def lacking(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(
            p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)

    a, b = folded(x), folded(y)
    return F.least(F.col(n) - F.coalesce(lacking(a, b), F.lit(0)),
                   F.col(m) - F.coalesce(lacking(b, a), F.lit(0)))


def row_key(id_col, text_col):
    """What tells rows apart: a hash of id and text, so that rows with one id,
    or none, and different texts are different documents."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST)),
                      F.coalesce(F.col(text_col), F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, per_cent: int = 75, bands: int = 32, rows: int = 4,
                    seed: int = 11) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_key, group_key`` for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded.  Documents whose sets
    share ``per_cent`` of their union are linked; ``component_id`` is the
    smallest doc_id reachable.  ``bands * rows`` must be a multiple of 32.
    ``row_key`` is that function's value, ``group_key`` the same for the rows of
    a component.

    Defined cases: NULL, empty and blank texts have 0 shingles and are linked
    with nothing; a NULL id counts as the smallest and is returned as NULL;
    rows that share an id (or have none) belong each to the component of its own
    text, so several of them can be ``kept``; repeated rows get equal results;
    an empty table gives an empty result.
    """
    longs = bands * rows * BITS // 64
    ids = docs.select(row_key(id_col, text_col).alias("_k"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST)).alias("_id"),
                      F.coalesce(text_col, F.lit("")).alias("_text"))
    base = ids.select("_k", "_text")
    sig = cut(ids.mapInArrow(signatures(size, bands, rows, seed), SIGNATURES))
    same = ["set_a", "set_b", "n_shingles"]
    classes = sig.where("n_shingles > 0").groupBy(*same).agg(
        F.min("_k").alias("rep"), F.min("_id").alias("low"))
    reps = cut(sig.where("n_shingles > 0").join(classes, same).where("_k = rep")
               .dropDuplicates(["_k", *same]).select("_k", "keys", "packed"))
    buckets = reps.select("_k", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(buckets.join(shared, "key"))
    packed = reps.groupBy("_k").agg(F.first("packed").alias("packed"))
    floor = lowest_estimate(per_cent, bands * rows)

    def links(pairs: DataFrame) -> DataFrame:
        """Estimated, then confirmed on the full sets: ``a, b, ok``."""
        likely = (pairs.join(packed.select(F.col("_k").alias("a"), F.col("packed").alias("pa")), "a")
                  .join(packed.select(F.col("_k").alias("b"), F.col("packed").alias("pb")), "b")
                  .where(estimate("pa", "pb", longs) >= floor).select("a", "b"))
        sides = likely.select(F.col("a").alias("_k"), "a", "b").unionByName(
            likely.select(F.col("b").alias("_k"), "a", "b"))
        texts = (base.join(sides, "_k").groupBy("a", "b").agg(
            F.max(F.when(F.col("_k") == F.col("a"), F.col("_text"))).alias("ta"),
            F.max(F.when(F.col("_k") == F.col("b"), F.col("_text"))).alias("tb")))
        return cut(texts.mapInArrow(confirm(size, per_cent), "a long, b long, ok boolean"))

    def labelled(edges: DataFrame) -> DataFrame:
        comp = connected_components(edges.where("ok").select("a", "b"))
        return cut(comp)

    def mixed(of: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Members of buckets that still hold different components."""
        if labels is None:
            of = of.withColumn("comp", F.col("_k"))
        else:
            of = of.join(labels.withColumnRenamed("node", "_k"), "_k", "left").withColumn(
                "comp", F.coalesce("component", "_k"))
        apart = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return of.join(apart.where("lo < hi").select("key"), "key").select("key", "_k", "comp")

    def ordered(x, y):
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # A few bands at a time: one member of each component in a bucket is held
    # against the bucket's centre, and what is linked is one component from then on.
    edges = tested = labels = None
    edge = [0, max(1, bands // 32), max(1, bands * 6 // 32), bands]
    for i, j in zip(edge, edge[1:]):
        if i == j:
            continue
        here = (F.col("band") >= i) & (F.col("band") < j)
        apart = mixed(members.where(here), labels)
        fronts = apart.groupBy("key", "comp").agg(F.min("_k").alias("_k"))
        centre = fronts.groupBy("key").agg(F.min(F.struct("comp", "_k")).alias("c"))
        pairs = (fronts.join(centre, "key").where("comp <> c.comp").select(*ordered("_k", "c._k"))
                 .distinct())
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty() and labels is not None:
            continue
        tested = pairs if tested is None else cut(tested.unionByName(pairs))
        found = links(pairs)
        edges = found if edges is None else cut(edges.unionByName(found))
        labels = labelled(edges)
    apart = cut(mixed(members, labels))
    # One row per document until the buckets are needed for the pairs.
    alone = cut(apart.groupBy("_k").agg(F.min("comp").alias("comp")))
    alone_texts = cut(base.join(alone.select("_k"), "_k"))
    counts = shared_shingles(alone_texts, size)
    bits = alone_texts.mapInArrow(bitmaps(size), "_k long, bits array<long>").groupBy("_k").agg(
        F.first("bits").alias("bits"))
    possible = 100 * F.col("common") >= per_cent * F.col("n")
    own = reps.groupBy("_k").agg(F.first("packed").alias("packed"),
                                 F.flatten(F.collect_list("keys")).alias("own"))
    alone = cut(alone.join(counts.where(possible), "_k").join(own, "_k").join(bits, "_k"))
    apart = cut(alone.withColumn("key", F.explode(F.array_distinct("own"))).join(
        apart.select("key").distinct(), "key", "left_semi"))
    other = apart.select("key", F.col("_k").alias("_k2"), F.col("comp").alias("comp2"), F.col(
        "packed").alias("packed2"), F.col("n").alias("n2"), F.col("common").alias("common2"),
        F.col("own").alias("own2"), F.col("bits").alias("bits2"))
    most = F.least("common", "common2")  # no intersection is larger
    rest = (apart.join(other, "key").where(
        (F.col("comp") < F.col("comp2"))
        & ((100 + per_cent) * most >= per_cent * (F.col("n") + F.col("n2")))
        & (estimate("packed", "packed2", longs) >= floor)
        # a pair is made in the first bucket that both have, not in each
        & (F.get(F.array_intersect("own", "own2"), F.lit(0)) == F.col("key"))
        & ((100 + per_cent) * shared_at_most("bits", "bits2", "n", "n2")
           >= per_cent * (F.col("n") + F.col("n2"))))
        .select(*ordered("_k", "_k2")).distinct()
        .join(tested, ["a", "b"], "left_anti"))
    edges = edges.unionByName(links(cut(rest)))
    labels = labelled(edges)
    linked = labels.withColumnRenamed("node", "rep")
    lowest = linked.join(classes.select("rep", "low"), "rep").groupBy("component").agg(
        F.min("low").alias("lowest"))
    out = (sig.select("_k", "_id", *same).join(classes, same, "left")
           .join(linked.join(lowest, "component"), "rep", "left")
           .select("_k", "_id", "n_shingles", F.coalesce("lowest", "low", "_id").alias("component"),
                   F.coalesce("component", "rep", "_k").alias("group")))
    real = lambda c: F.when(F.col(c) != SMALLEST, F.col(c))
    return out.select(real("_id").alias("doc_id"), "n_shingles",
                      real("component").alias("component_id"),
                      (F.col("_id") == F.col("component")).alias("kept"),
                      F.col("_k").alias("row_key"), F.col("group").alias("group_key"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")
                           .select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")
