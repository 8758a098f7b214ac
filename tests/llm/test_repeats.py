"""Byte and word repeat removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from fieldspark.llm import repeats
from fieldspark.llm.substring_dedup import op2_substring_dedup, substring_dedup
from fieldspark.llm.suffix_dedup import op1_suffix_array_dedup, suffix_array_dedup

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("_text", T.StringType()),
                       T.StructField("block", T.LongType())])


def brute(units_by_doc, window):
    """{doc: (n_units, removed flags)} for (id, units) in document order."""
    seen, out = set(), {}
    for doc, units in sorted(units_by_doc.items()):
        flags = [False] * len(units)
        for i in range(len(units) - window + 1):
            key = tuple(units[i:i + window]) if isinstance(units, list) else units[i:i + window]
            if key in seen:
                flags[i:i + window] = [True] * window
            seen.add(key)
        out[doc] = flags
    return out


def spans(flags):
    return sum(f and not p for f, p in zip(flags, [False, *flags]))


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["alpha", "bé", "c", "δδ", "e5", "foo,", " x", "日本"]
    passage = " ".join(rng.choice(vocab) + str(rng.randrange(99)) for _ in range(60))
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(vocab) + str(rng.randrange(50)) for _ in range(rng.randrange(90)))
        kind = i % 6
        if kind == 0:  # hot passage shared by many
            text = text[:rng.randrange(40)] + passage[rng.randrange(30):] + text
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if kind == 2:
            text = "ab" * rng.randrange(200)
        if kind == 3 and rows:
            other = rows[rng.randrange(len(rows))][1] or ""
            cut = rng.randrange(len(other) + 1)
            text = text + "\t\n" + other[cut:cut + rng.randrange(300)]
        rows.append((i * 7 % 131, text, "clash", i))
    rows += [(1000, None, None, None), (1001, "", "x", 1), (1002, " \t ", "x", 1)]
    rows += [(1003, "long word " * 9000, "x", 2)]
    return rows


def test_suffix_dedup_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["_row"]["doc_id"]: r for r in suffix_array_dedup(df, block_names=500, turns=3).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    want = brute(texts, 100)
    assert set(got) == set(want)
    for k, flags in want.items():
        kept = bytes(b for b, f in zip(texts[k], flags) if not f)
        assert (got[k].n_units, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (
            len(flags), sum(flags), spans(flags), kept), k
        assert got[k]["_row"]["block"] is None or isinstance(got[k]["_row"]["block"], int)


@pytest.mark.parametrize("block_names", [300, 2_000_000])
def test_substring_dedup_brute_force(spark, block_names):
    rows = corpus(8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["_row"]["doc_id"]: r for r in substring_dedup(df, block_names=block_names).collect()}
    texts = {r[0]: words(r[1]) for r in rows}
    want = brute(texts, 20)
    for k, flags in want.items():
        kept = " ".join(w for w, f in zip(texts[k], flags) if not f).encode()
        assert (got[k].n_units, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (
            len(flags), sum(flags), spans(flags), kept), k


def test_empty_table_repeated_rows_and_null_id(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_array_dedup(empty).count() == 0
    assert substring_dedup(empty).count() == 0
    text = "".join(random.Random(1).choices("abcdefgh ", k=400))
    rows = [(5, text, "", 0), (5, text, "", 0), (9, text, "", 0), (None, text, "", 0)]
    out = suffix_array_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {(r["_row"]["doc_id"], len(r["kept"])) for r in out}
    assert len(out) == 4 and kept == {(None, 400), (5, 0), (9, 0)}


def test_queries_on_driver_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    flags = brute(texts, 100)
    got = {r["doc_id"]: r for r in op1_suffix_array_dedup(spark, SMALL).collect()}
    for k, f in flags.items():
        kept = hashlib.sha256(bytes(b for b, x in zip(texts[k], f) if not x)).hexdigest()
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (
            len(f), sum(f), spans(f), kept)
    texts = {r["doc_id"]: words(r["text"]) for r in docs}
    flags = brute(texts, 20)
    got = {r["doc_id"]: r for r in op2_substring_dedup(spark, SMALL).collect()}
    for k, f in flags.items():
        kept = " ".join(w for w, x in zip(texts[k], f) if not x).encode()
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (
            len(f), sum(f), hashlib.sha256(kept).hexdigest())


def test_many_levels_of_ranges(spark, monkeypatch):
    """Few names per range and a small fan-out: packets are refined three times."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda out: {(r._row.doc_id, r.n_units): (r.n_removed, r.kept) for r in out.collect()}
    wanted = key(suffix_array_dedup(df)), key(substring_dedup(df))
    monkeypatch.setattr(repeats, "RANGE_NAMES", 40)
    monkeypatch.setattr(repeats, "FANOUT", 4)
    assert repeats.Ranges(5000, 6).levels == 4
    assert (key(suffix_array_dedup(df, block_names=100)), key(substring_dedup(df, block_names=50))) == wanted


def test_packets_follow_names_not_partitions(spark):
    docs = spark.createDataFrame([(i, 0, f"{i} some words " * 40) for i in range(400)],
                                 "_k long, _h long, _text string").cache()
    try:
        scheme = repeats.WordRuns(window=20, seed=8)
        for parts in (4, 64):
            ranges = repeats.Ranges(repeats.text_bytes(docs) * scheme.seeds_per_byte(), 6)
            made = docs.repartition(parts).mapInArrow(
                repeats.seed_packets(scheme, ranges, 1_000_000), repeats.PACKETS).count()
            assert made <= 2 * parts  # the documents of a block and one range
    finally:
        docs.unpersist(blocking=True)


def test_equal_first_halves_are_told_apart():
    """Two 64-bit names collide: their second halves decide."""
    names = np.array([5, 5, 5, 5, 1, 9], dtype=np.uint64)
    second = np.array([1, 2, 1, 3, 7, 8], dtype=np.uint64)
    order, first = repeats._sorted_groups(names, second)
    groups = np.cumsum(first)
    of = dict(zip(order.tolist(), groups.tolist()))
    assert of[0] == of[2] and len({of[0], of[1], of[3], of[4], of[5]}) == 5
    order, first = repeats._sorted_groups(names, None)
    assert first.sum() == 3
