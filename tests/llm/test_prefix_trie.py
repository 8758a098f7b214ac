"""Prefix trie against a direct computation over all prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

from fieldspark.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, node string"


def rebuilt(rows, share_heads):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [v for _, v in sorted(turns, key=lambda y: y[0])] for c, turns in own.items()}
    if not share_heads:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows, share_heads):
    seqs = rebuilt(rows, share_heads)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
        ends[tuple(seqs[c])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids.get(p, 0), leaves[p],
                   saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
                  for p, m in members.items())


def result(spark, rows, share_heads):
    df = spark.createDataFrame(rows, SCHEMA)
    out = conversation_trie(df, share_heads=share_heads).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in out)


def conversations(n, kinds=3):
    rows = []
    for c in range(n):
        for t in range(c * 7 % 11 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "bot",
                         f"w{(c * 13 + t) % kinds if t > 1 else 0} x\ty", "clash", "clash"))
    return rows


def test_against_brute_force(spark):
    rows = conversations(60)
    assert result(spark, rows, False) == brute(rows, False)
    assert result(spark, rows, True) == brute(rows, True)


def test_long_and_common_conversations(spark):
    rows = [(c, t, "u", f"t{t % 5}", "", "") for c in (1, 2, 25) for t in range(300 + c)]
    rows += [(100 + c, t, "u", "same", "", "") for c in range(200) for t in range(3)]
    assert result(spark, rows, True) == brute(rows, True)


def test_odd_rows(spark):
    more = ("", "")
    rows = [(None, 0, "u", "a", *more), (1, None, None, None, *more), (1, 5, "u", "a b", *more),
            (1, 5, "u", "a b", *more), (2, -3, "", "", *more), (2, 0, "u", "", *more),
            (40, 1, "u", "long " * 50000, *more), (45, 1, "u", "z", *more), (-7, 1, "u", "z", *more),
            (61, 0, "a", "b:c", *more), (62, 0, "a1:b", "c", *more)]
    assert result(spark, rows, False) == brute(rows, False)
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert result(spark, positive, True) == brute(positive, True)
    assert result(spark, [], True) == []
    # turnless: three borrowed turns of a conversation that does not exist
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert result(spark, [(short, 0, "u", "a", *more)], True) == brute([(short, 0, "u", "a", *more)], True)
