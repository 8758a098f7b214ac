"""Quality rules: divergence of a document from its language's reference.

Only DataFrame functions.  Base counts (words, symbols, repeated lines and
word windows) are computed inside each row.  The reference of a language
holds the shares of character classes and of its most common words over the
whole corpus; a document is rejected when the Jensen-Shannon distance of its
own histogram from the reference is too large.  Short texts are not judged by
a histogram they are too short to fill.  The limit of the word distance comes
from the distances that the corpus has in the language and at the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, written

SPACE = "[\\x20\\x09-\\x0D]+"
#: Character classes; what is in none of them is the last class.
CLASSES = ("[\\p{Ll}\\p{Lo}]+", SPACE, "\\p{Lu}+", "[.,;:!?'\"()\\-]+", "\\p{Nd}+")
BLANKS = 1  # the class of white space; none of the classes holds a symbol


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE, -1))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and
    ``_chars``, ``_classes`` from ``_text`` and ``_words``.

    Character classes are removed one after the other, most frequent first, so
    only the first pattern runs over the whole text.
    """
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # Words after the first are read by position: a slice would copy them.
    grams = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 4, F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, 5)]))
    left, sizes = text, [F.length(text)]
    for i, pattern in enumerate(CLASSES):
        docs = docs.withColumn(f"_left{i}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"_left{i}")
        sizes.append(F.length(left))
    docs = docs.withColumn("_sizes", F.array(*sizes))
    size = lambda i: F.col("_sizes")[i]
    spaces = size(BLANKS) - size(BLANKS + 1)
    counted = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "_chars": size(0),
        "_classes": F.array(*[size(i) - size(i + 1) for i in range(len(CLASSES))],
                            size(len(CLASSES))).cast("array<double>"),
        "word_chars": (size(0) - spaces).cast("long"),
        "n_symbols": F.length(F.regexp_replace(left, "[^#*$%&|<>]+", "")).cast("long"),
        "_lines": lines, "_grams": grams}).drop("_sizes", *[f"_left{i}" for i in range(len(CLASSES))])
    # Positions of windows that occur twice: neighbours after sorting by hash.
    pairs = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size("_grams") > F.size(F.array_distinct("_grams"))
    counted = counted.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_pairs": F.when(repeats, pairs)})
    same = lambda p, at: p["h"].eqNullSafe(F.get("_pairs", at)["h"])
    again = F.filter("_pairs", lambda p, at: same(p, at + 1) | same(p, at - 1))
    found = counted.withColumn("_at", F.sort_array(again.getField("i")))
    after = F.concat(F.slice("_at", F.lit(2), F.size("_at") - 1),
                     F.array(F.lit(2**31 - 1)))
    covered = F.aggregate(
        F.zip_with("_at", after, lambda a, b: F.least(F.lit(5), b - a)), F.lit(0), lambda s, x: s + x)
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_lines", "_grams", "_pairs", "_at")


def common_words(docs: DataFrame, top: int) -> DataFrame:
    """``_g, _common``: the ``top`` most frequent words of each ``_group``, ties
    by word.

    Words are counted once per group before anything is ranked, and each task
    keeps its own best ``top`` per group before the ranking, so no task sorts
    the vocabulary of a language.
    """
    words = docs.select("_group", F.explode("_words").alias("_w")).groupBy("_group", "_w").agg(
        F.count("*").alias("_n"))
    best = Window.partitionBy("_group").orderBy(F.col("_n").desc(), "_w")
    return (words.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top)
            .groupBy(F.col("_group").alias("_g")).agg(F.sort_array(F.collect_list("_w"))
                                                      .alias("_common")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of shares."""

    def term(a, b):
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.try_divide(x, total))


def word_limits(judged: DataFrame, spreads: float, prior: float, min_words: int, lowest: float,
                highest: float) -> DataFrame:
    """Limit of the word distance per ``_group`` and doubling of the length.

    The median plus ``spreads`` times its distance from the 16 % quantile (one
    standard error below it): the lower half holds no junk that would widen the
    limit.  Both come from exact counts in narrow bins.  The limit of a class is
    a mean of its own, weighted by its documents, and that of its language with
    the weight of ``prior`` documents; a language's in turn of its own and
    ``highest``.  What languages have in common over all lengths is the distance
    times the root of the length.  Limits are not above those of a shorter
    length, as distances fall with the length.
    """
    far = F.col("word_distance")
    bins = F.explode(F.array(
        F.struct(F.col("_size").alias("_s"), F.floor(far * 10_000).alias("_b")),
        F.struct(F.lit(None).cast("int").alias("_s"),
                 F.floor(far * F.sqrt("n_words") * 1000).alias("_b"))))
    counted = (judged.where(far.isNotNull()).select("_group", bins.alias("_at"))
               .groupBy("_group", "_at._s", "_at._b").agg(F.count("*").alias("_n")))
    each = Window.partitionBy("_group", "_s")
    counted = counted.withColumns({
        "_below": F.sum("_n").over(each.orderBy("_b")), "_m": F.sum("_n").over(each)})
    middle = F.min(F.when(2 * F.col("_below") >= F.col("_m"), F.col("_b")))
    low = F.min(F.when(100 * F.col("_below") >= 16 * F.col("_m"), F.col("_b")))
    found = counted.groupBy("_group", "_s").agg(
        F.max("_m").alias("_m"), (middle + spreads * (middle - low)).alias("_raw"))
    language = Window.partitionBy("_group")
    within = lambda x: F.least(F.lit(highest), F.greatest(F.lit(lowest), x))
    overall = lambda c: F.max(F.when(F.col("_s").isNull(), F.col(c))).over(language)
    found = found.withColumns({"_all": overall("_m"), "_z": overall("_raw")}).where("_s is not null")
    general = within(F.col("_z") / 1000 / F.sqrt(min_words * F.pow(F.lit(2.0), F.col("_s"))))
    mean = lambda n, own, rest: (n * own + prior * rest) / (n + prior)
    limit = mean(F.col("_m"), within(F.col("_raw") / 10_000),
                 mean(F.col("_all"), general, F.lit(highest)))
    shorter = language.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.select(F.col("_group").alias("_g"), "_s", F.min(limit).over(shorter).alias("_limit"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", top: int = 16, min_chars: int = 200, min_words: int = 50,
                  max_class_distance: float = 0.25, max_word_distance: float = 0.45,
                  min_word_limit: float = 0.25, spreads: float = 4.0, prior: float = 30.0,
                  chance: float = 1e-9) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept`` for every row.

    ``kept`` is false if the base rules fail (fewer than 10 words, or over
    20 % of the words in repeated five-word windows) or if a distance exceeds
    its limit on a text of at least ``min_chars`` characters or ``min_words``
    words.  The limit of the word distance is that of ``word_limits``.  A text
    that has none of the common words fails too, if it is so long that this
    happens by chance to fewer than ``chance`` of the texts.  Every language has a
    reference of its own, NULL counting as one.  Common words, references and
    limits are written tables of a few rows per language and are joined, so Spark
    broadcasts them if their files are small and shuffles otherwise.

    Defined cases: a NULL or empty text has no words and fails; repeated rows
    count each and are judged alike; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"),
                       F.coalesce(text_col, F.lit("")).alias("_text"))
    grouped = base.withColumns({"_words": words_of(F.col("_text")), "_group": F.col("_lang")})
    listed = written(common_words(grouped, top))
    empty = F.array().cast("array<string>")
    grouped = grouped.join(listed, F.col("_group").eqNullSafe(F.col("_g")), "left").withColumn(
        "_common", F.coalesce("_common", empty)).drop("_g")
    counted = base_counts(grouped).select(
        "doc_id", "_group", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "_chars", "_classes",
        F.transform("_common", lambda w: (F.size("_words") - F.size(F.array_remove(
            F.col("_words"), w))).cast("double")).alias("_of"))
    counted = cut(counted.withColumn("_of", F.concat("_of", F.array(
        F.col("n_words") - F.aggregate("_of", F.lit(0.0), lambda s, x: s + x)))))
    classes = len(CLASSES) + 1
    totals = (counted.groupBy("_group").agg(
        F.sum("n_words").alias("_n"), F.sum("_chars").alias("_c"),
        F.array(*(F.sum(F.col("_classes")[i]) for i in range(classes))).alias("_rc"),
        F.array(*(F.sum(F.get("_of", F.lit(i))) for i in range(top + 1))).alias("_rw")))
    reference = totals.select(F.col("_group").alias("_g"), shares("_rc", F.col("_c")).alias("_rc"),
                              shares(F.filter("_rw", lambda x: x.isNotNull()), F.col("_n"))
                              .alias("_rw"))
    judged = counted.join(written(reference), F.col("_group").eqNullSafe(F.col("_g")))
    judged = judged.withColumns({
        "class_distance": F.when((F.col("_chars") >= min_chars),
                                 distance(shares("_classes", F.col("_chars")), F.col("_rc"))),
        "word_distance": F.when(F.col("n_words") >= min_words,
                                distance(shares("_of", F.col("n_words")), F.col("_rw"))),
        "_size": F.when(F.col("n_words") >= min_words,
                        F.length(F.bin(F.floor(F.col("n_words") / min_words))) - 1),
        "_none": (F.element_at("_of", -1) == F.col("n_words"))
        & (F.pow(F.element_at("_rw", -1), F.col("n_words")) < chance),
        "base_failed": (F.col("n_words") < 10)
        | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})
    limits = written(word_limits(judged, spreads, prior, min_words, min_word_limit,
                                 max_word_distance))
    judged = judged.drop("_g").join(
        limits, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_size") == F.col("_s")),
        "left")
    far = (F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False))
           | F.coalesce((F.col("word_distance") > F.col("_limit"))
                        | (F.col("word_distance").isNotNull() & F.col("_none")), F.lit(False)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "class_distance", "word_distance",
                         (~F.col("base_failed") & ~far).alias("kept"))


def op6_divergence_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
