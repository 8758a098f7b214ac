"""Hard negatives against a direct computation, and odd rows."""

import math

from pyspark.sql import functions as F

from fieldspark.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string"


def brute(rows, anchor, k_positives=5, k=5):
    usable = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows
              if i is not None and lab is not None and v
              and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({r[0] for r in usable if anchor(r[0])}):
        _, label, vec = min(r for r in usable if r[0] == i)
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), j, lab) for j, lab, v in usable
                        if j != i and len(v) == len(vec))
        positives = [(j, -s) for s, j, lab in scored if lab == label][:k_positives]
        for j, p in positives:
            window = [(n, -s) for s, n, lab in scored if lab != label and 80 * p <= -100 * s <= 100 * p]
            out += [(i, j, r + 1, n, p, s) for r, (n, s) in enumerate(window[:k])]
    return sorted(out)


def result(spark, rows, **args):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0, **args).collect()))


def vectors(n, d=4, levels=5):
    """Few distinct components, so that scores tie often."""
    return [(i, [((i * (j + 3) * 7 + i // 5) % levels - 1) / 4 for j in range(d)], i % 3, "s", "x")
            for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(120)
    wanted = brute(rows, lambda i: i % 10 == 0)
    assert wanted and result(spark, rows) == wanted
    assert result(spark, rows, block=16) == wanted  # several blocks of rows and anchors


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4, 1, "", ""), (200, None, 1, "", ""), (201, [1.0, None, 0.0, 0.0], 1, "", ""),
           (202, [nan, 0.0, 0.0, 0.0], 1, "", ""), (203, [inf, 0.0, 0.0, 0.0], 1, "", ""),
           (204, [], 1, "", ""), (205, [1.0, 1.0], 0, "", ""), (206, [1.0] * 4, None, "", ""),
           (210, [0.0] * 4, 1, "", ""), (207, [0.5] * 4, 2, "", ""), (207, [0.5] * 4, 2, "", ""),
           (220, [0.25] * 4, 0, "", ""), (220, [0.5] * 4, 1, "", ""), (230, [1.0, 1.0], 1, "", "")]
    rows = vectors(40) + odd
    assert result(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0], 1, "", "")]) == []  # no positive


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**20, 1.0], 0, "", ""), (1, [2.0**20, 1.0], 0, "", ""),
            (2, [2.0**20, 0.0], 1, "", ""), (3, [2.0**20 - 1, 1.0], 1, "", "")]
    assert result(spark, rows) == brute(rows, lambda i: i % 10 == 0)
