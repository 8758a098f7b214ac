"""Near duplicates against exact Jaccard components."""

import random
import re

from pyspark.sql import types as T

from fieldspark.llm.components import connected_components
from fieldspark.llm.minhash_dedup import near_duplicates, op3_minhash_dedup

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("key", T.StringType())])


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def exact(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in ids}


def variants(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_exact_components(spark):
    rng = random.Random(5)
    rows = []
    for group in range(6):
        words = [f"w{group}x{rng.randrange(300)}" for _ in range(120)]
        rows += variants(rng, words, 15, 9)
    chain = [f"c{i}" for i in range(200)]  # links only between neighbours in a chain
    rows += [" ".join(chain[k:k + 60]) for k in range(0, 120, 5)]
    rows += ["one two", "One  TWO", "one two three four five", "", " \n", None, "a b c d e f"] * 2
    rng.shuffle(rows)
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    data = [(i, t, "clash") for i, t in zip(ids, rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(
        spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    want = exact({i: t for i, t, _ in data})
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_small_sets_at_the_threshold_are_linked(spark):
    # 3 of 4 shingles; the low bits of their minima estimate far less than 0.75
    numbers = [405, 1043, 1377, 1685, 2135, 2446, 3877, 4671, 5458, 5610, 6665, 7001]
    rows = []
    for i in numbers:
        text = " ".join(f"k{i}w{j}" for j in range(7))
        rows += [(2 * i, text, ""), (2 * i + 1, f"{text} e{i}x0", "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k, _, _ in rows}


def test_null_id_repeats_and_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    out = near_duplicates(spark.createDataFrame(
        [(4, text, ""), (4, text, ""), (None, text, ""), (7, None, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [
        (-1, -1, True), (4, -1, False), (4, -1, False), (7, 7, True)]


def test_rows_that_share_an_id_or_have_none(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(5, one, ""), (5, two, ""), (6, two + " more", ""), (7, one, ""), (3, three, ""),
            (None, three, ""), (None, "p " + three, ""), (None, one + " q", "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).select(
        "doc_id", "component_id", "kept", "n_shingles").collect()
    assert sorted((r[0] or -1, r[1] or -1, r[2], r[3]) for r in got) == [
        (-1, -1, True, 26), (-1, -1, True, 27), (-1, -1, True, 27), (3, -1, False, 26),
        (5, -1, False, 26), (5, 5, True, 26), (6, 5, False, 27), (7, -1, False, 26)]


def test_bitmap_bound_drops_no_link(spark):
    # hundreds of variants that share most shingles; few pairs reach the threshold
    rng = random.Random(8)
    words = [f"t{i}" for i in range(100)]
    texts = dict(enumerate(variants(rng, words, 150, 14)))
    got = near_duplicates(spark.createDataFrame(
        [(i, t, "") for i, t in texts.items()], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == exact(texts)


def test_query_on_driver_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = exact({r["doc_id"]: r["text"] for r in docs})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_minhash_dedup(spark, SMALL).collect()}
    assert got == want


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges += [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {k: find(k) for k in root}
