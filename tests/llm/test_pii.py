"""Personal data: fixed patterns against plain regular expressions, discoveries
by context on constructed texts, and odd rows."""

import re

from fieldspark.llm.pii import KINDS, personal_data

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
         r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id long, text string, kind string, start string, value string"


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "")
            if passes(KINDS[k], m.group())]


def result(spark, texts, **args):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.found])
            for r in personal_data(df, **args).collect()}


def test_fixed_patterns(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
             .select("text").collect()]
    texts += ["a@b.c_d@e.f", "a@b..c x@y.z.", "é x.y+z@q-1.de,1.2.3.4.5.6.7.8 0001.2.3.255", "256.1.1.1",
              "4111 1111-1111 1111  4111111111111111", "+1 (017) 555-7713 +44", "+1" + " " * 500,
              "1" * 3000, "x@" + "a." * 4000 + "b", "no digits", "@", "ü" * 40 + " a@b.cd"]
    out = result(spark, texts)
    assert {i: b for i, (b, _) in out.items()} == {i: plain(t) for i, t in enumerate(texts)}


def test_unseen_identifiers(spark):
    """Written without the plus sign after the same word; run together with a
    neighbour; numbers that fail the check or stand elsewhere stay."""
    texts = [f"please call +1 (2{i:02d}) 555-01{i:02d} today" for i in range(30)]
    texts += [f"order {7000000 + i} arrived" for i in range(30)]
    texts += [f"from +1 (3{i:02d}) 555-77{i:02d} 10.0.0.{i} came" for i in range(3)]
    unseen = "please call +1 (345) 555-0199 4111111111111112 now"
    texts += [unseen, "order 7654321 and 4111111111111112"]
    out = result(spark, texts)
    at = texts.index(unseen)
    assert [unseen[s:e] for _, s, e in out[at][1]] == ["+1 (345) 555-0199"]
    for i in range(60, 63):
        assert [texts[i][s:e] for _, s, e in out[i][1]] == [texts[i].split(" 10.")[0][5:]]
    assert all(not found for i, (_, found) in out.items() if i < 60 or i > at)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a@b.cd " * 3000, "1 " * 3000, "x" * 200_000 + "1"]
    out = result(spark, texts)
    assert {i: b for i, (b, _) in out.items()} == {i: plain(t) for i, t in enumerate(texts)}
    assert result(spark, []) == {}
    twice = spark.createDataFrame([(1, "a@b.cd", "", "", ""), (1, "a@b.cd", "", "", ""),
                                   (None, "a@b.cd", "", "", "")], SCHEMA)
    assert [len(r.base) for r in personal_data(twice).collect()] == [1, 1, 1]
