"""Personal data: fixed patterns, and contextual patterns bootstrapped from them.

Only DataFrame functions.  The fixed patterns (e-mail, IP, card, phone) find
the seeds.  Everything that looks like an identifier, seed or not, is a
candidate; its patterns say how it is written and between which words it
stands.  Candidates and patterns form a bipartite graph:

* a pattern's confidence in a kind is the share of its distinct instances that
  are known to be of that kind, if enough are known;
* an instance's score is the noisy-or of its confident patterns; with a high
  score, and if its digits can be of the kind at all, it becomes known.

After a few rounds the known instances that the fixed patterns missed (written
differently, or run together with a neighbour) are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns: the same matches, without backtracking.
PATTERNS = (
    "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "[0-9](?:[\\x20-]?+[0-9])++",
    "\\+[0-9][\\x20().0-9-]+[0-9]")
SPACE = "\\x20\\x09-\\x0D"
#: A token with a digit or an at sign, from its start.
TOKEN = f"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(sizes: Column) -> Column:
    """Exclusive prefix sums of an array, in two levels: near linear time."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    total = lambda xs, at, n: F.aggregate(F.slice(xs, at, n), zero, add)

    def sums(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")),
                             lambda b: total(xs, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: let(
            F.transform(bs, lambda _, b: total(bs, F.lit(1), b)),
            lambda before: F.transform(xs, lambda _, i: before[F.floor(i / BLOCK).cast("int")] + total(
                xs, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<bigint>")).otherwise(let(sizes, sums))


def matches(text: Column, pattern: str) -> Column:
    """``start, end, hit, gap, after`` of each match: offsets in code points, the
    match, and the texts between it and its neighbours."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,gap:string,after:string>>")

    def placed(gaps, found):
        sizes = F.transform(found, lambda h, i: (F.length(gaps[i]) + F.length(h)).cast("long"))
        return let(prefix_sums(sizes), lambda at: F.transform(found, lambda h, i: F.struct(
            (at[i] + F.length(gaps[i])).alias("start"),
            (at[i] + F.length(gaps[i]) + F.length(h)).alias("end"), h.alias("hit"),
            gaps[i].alias("gap"), gaps[i + 1].alias("after"))))

    return let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: placed(gaps, found))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda s, x: s + x)
    return total % 10 == 0


def can_be(kind: int, value: Column) -> Column:
    """Whether the digits of a match can be of the kind."""
    if KINDS[kind] == "email":
        return value.contains("@")
    if KINDS[kind] == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return (F.size(parts) == 4) & F.forall(parts, lambda p: (p == "") | (
            p.rlike("^[0-9]{1,3}$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)))
    if KINDS[kind] == "card":
        return let(digits_of(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d))
                   .otherwise(False))
    return F.length(digits_of(value)).between(8, 15)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: ``kind, start, end``, in this order."""

    def of(kind):
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: can_be(kind, m["hit"]))
        return F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*map(of, range(len(KINDS))))


def context(gap: Column, side: str) -> Column:
    """The word next to a candidate in lower case, without punctuation."""
    near = F.lower(F.right(gap, F.lit(64)) if side == "left" else F.left(gap, F.lit(64)))
    words = F.filter(F.split(near, f"[{SPACE}]+", -1), lambda w: w != "")
    word = F.get(words, F.size(words) - 1 if side == "left" else F.lit(0))
    return F.coalesce(F.regexp_replace(word, "[^\\p{L}\\p{N}]+", ""), F.lit(""))


def candidates(text: Column, tokens: int, longest: int) -> Column:
    """Runs of one to ``tokens`` neighbouring tokens with a digit or an at sign:
    ``start, end, value, left, right``, punctuation around them left out."""
    opening, closing = F.lit("\"'([{<|,;:!?*#$%&="), F.lit("\"')]}>|.,;:!?*#$%&=")

    def gram(ms, i, n):
        last = ms[i + n - 1]
        value = F.concat_ws(" ", F.transform(F.slice(ms, i + 1, F.lit(n)), lambda m: m["hit"]))
        # an opening bracket that is closed inside belongs to the value
        front = F.when(value.rlike("^\\([0-9]+\\)"), value).otherwise(F.ltrim(value, opening))
        return let(F.struct(value.alias("v"), front.alias("f"), F.rtrim(front, closing).alias("b")),
                   lambda s: F.struct(
            (ms[i]["start"] + F.length(s["v"]) - F.length(s["f"])).alias("start"),
            (last["end"] - F.length(s["f"]) + F.length(s["b"])).alias("end"), s["b"].alias("value"),
            context(ms[i]["gap"], "left").alias("left"), context(last["after"], "right").alias("right")))

    def beside(ms, n):
        """Runs of ``n`` tokens with single spaces between them."""
        runs = F.transform(ms, lambda _, i: F.when(
            (i + n <= F.size(ms)) & F.forall(F.slice(ms, i + 2, F.lit(n - 1)),
                                             lambda m: m["gap"] == " "), gram(ms, i, n)))
        return F.filter(runs, lambda g: g.isNotNull() & (F.length(g["value"]) <= longest) & (
            (F.length(digits_of(g["value"])) >= 7) | g["value"].contains("@")
            | g["value"].rlike("^[0-9]+(\\.[0-9]+){3}$")))

    return let(matches(text, TOKEN),
               lambda ms: F.concat(*[beside(ms, n) for n in range(1, tokens + 1)]))


def patterns(value: Column, left: Column, right: Column) -> Column:
    """Patterns of a candidate: its shape (the first digit kept), its coarse
    shape after or in front of a word, and the words on both sides."""
    shape = F.regexp_replace(F.regexp_replace(value, "\\p{L}+", "a"), "(?<=[0-9].{0,99})[0-9]", "9")
    coarse = F.regexp_replace(F.regexp_replace(value, "\\p{L}+", "a"), "[0-9]+", "9")
    empty = F.lit("")
    return F.array(F.struct(F.lit("shape").alias("p"), shape.alias("l"), empty.alias("r")),
                   F.struct(F.lit("left").alias("p"), left.alias("l"), coarse.alias("r")),
                   F.struct(F.lit("right").alias("p"), coarse.alias("l"), right.alias("r")),
                   F.struct(F.lit("both").alias("p"), left.alias("l"), right.alias("r")))


def bootstrap(occurrences: DataFrame, rounds: int, support: int, confidence: float,
              score: float) -> DataFrame:
    """``value, kind`` of the instances that become known beyond the seeds.

    ``occurrences`` has ``value, left, right, seed`` (a kind or NULL).
    """
    edges = cut(occurrences.select("value", "seed", F.explode(patterns(*map(F.col, (
        "value", "left", "right")))).alias("pattern")).groupBy("pattern", "value").agg(
            F.max("seed").alias("seed")))
    known = cut(edges.groupBy("value").agg(F.max("seed").alias("kind")).where("kind is not null"))
    seeds = known
    for _ in range(rounds):
        marked = edges.select("pattern", "value").join(known, "value", "left")
        counts = marked.groupBy("pattern").agg(F.count("*").alias("n"), *[
            F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in range(len(KINDS))])
        trusted = cut(counts.select("pattern", "n", F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("hits")) for k in range(len(KINDS))]))
            .alias("s")).select("pattern", "s.kind", "s.hits", (F.col("s.hits") / F.col("n")).alias("c"))
            .where((F.col("hits") >= support) & (F.col("c") >= confidence)))
        # A perfect pattern leaves one chance in its number of hits.
        doubt = F.log(F.greatest(1 - F.col("c"), 1 / (F.col("hits") + 1)))
        scored = edges.select("pattern", "value").join(trusted, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(doubt))).alias("score"))
        allowed = F.lit(False)
        for k in range(len(KINDS)):
            allowed = F.when(F.col("kind") == k, can_be(k, F.col("value"))).otherwise(allowed)
        found = (scored.where((F.col("score") >= score) & allowed)
                 .groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
                 .join(seeds, "value", "left_anti"))
        known = cut(seeds.unionByName(found))
    return known.join(seeds, "value", "left_anti")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 3,
                  longest: int = 64, rounds: int = 3, support: int = 3, confidence: float = 0.8,
                  score: float = 0.9) -> DataFrame:
    """``doc_id, base, found``: spans ``kind, start, end`` (code points, kinds
    numbered as ``KINDS``) of the fixed patterns and those added by context.

    Added spans overlap neither a fixed one nor each other; the earliest
    counts, then the longest.  A candidate that overlaps a fixed span without
    being it is no evidence.  ``longest`` bounds the length of an identifier, ``tokens`` its parts.

    Defined cases: a NULL or empty text has no span; rows are judged one by one,
    so repeated rows have equal results, and an instance counts once however
    often it occurs; an empty table gives an empty result.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])

    def marked(base, found):
        """Candidates with the kind of the fixed span they are; others that overlap one go."""
        kept = F.filter(found, lambda c: F.exists(base, lambda b: same(b, c))
                        | ~F.exists(base, lambda b: overlap(b, c)))
        return F.transform(kept, lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
            c["left"].alias("left"), c["right"].alias("right"),
            F.array_min(F.transform(F.filter(base, lambda b: same(b, c)), lambda b: b["kind"]))
            .alias("seed")))

    spotted = cut(texts.select("doc_id", F.when(F.col("t").rlike("[0-9@]"), F.struct(
        base_spans(F.col("t")).alias("base"), candidates(F.col("t"), tokens, longest).alias("found")))
        .alias("s")).select("doc_id", "s.base", let(F.col("s"), lambda s: marked(
            s["base"], s["found"])).alias("found")))
    # The checkpoint fixes rows and their order: the numbers are the same in each use.
    rows = spotted.withColumn("row", F.monotonically_increasing_id())
    seen = rows.select("row", F.explode("found").alias("c")).select("row", "c.*")
    fresh = bootstrap(seen, rounds, support, confidence, score)
    extra = seen.where("seed is null").join(fresh, "value").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "kind"))).alias("x"))
    spans = "array<struct<kind:int,start:bigint,end:bigint>>"
    none = F.array().cast(spans)

    def place(done, c):
        free = (F.size(done) == 0) | (F.element_at(done, -1)["end"] <= c["start"])
        return F.when(free, F.concat(done, F.array(F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), (-c["e"]).alias("end"))))).otherwise(done)

    apart = F.when(F.size(F.coalesce("x", F.array())) == 0, none).otherwise(
        F.aggregate("x", none, place))
    return rows.join(extra, "row", "left").select(
        "doc_id", F.coalesce(F.col("base").cast(spans), none).alias("base"), apart.alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, by kind and start."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat("base", "found")).alias("spans"))
