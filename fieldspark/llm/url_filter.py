"""URL filter: rules first, gradient-boosted trees on lexical features else.

Only DataFrame functions and Spark ML.  URLs that a rule decides are the
labelled ones; trees trained on them judge all others from the look of the
URL: length, depth, digit share, entropy, number of parameters and how often
labelled URLs with the same host suffix, or the same first part of the path, are
blocked.  For a labelled URL that
share comes from the hosts of the other folds only, so no URL sees its own
label or that of its host.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

#: (host, path, verdict): the longest rule that fits decides.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SPLIT = "(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_share", "entropy",
            "parameters", "hyphens", "has_query", "has_fragment", "secure", "longest_label",
            "suffix_share", "suffix_blocked", "segment_share", "segment_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, SPLIT, 1), upper, lower), F.regexp_extract(url, SPLIT, 2)


def apply_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict (both NULL if none fits)."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def lexical_features(df: DataFrame) -> DataFrame:
    """Feature columns from ``_url, host, path``."""
    url = F.col("_url")
    size = F.length(url)
    without = lambda pattern: size - F.length(F.regexp_replace(url, pattern, ""))
    share = F.transform(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), lambda c: (
        size - F.length(F.replace(url, c, F.lit("")))) / size)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    number = lambda c: c.cast("double")
    labels = F.split("host", "\\.")
    return df.withColumns({
        "url_length": number(size), "host_length": number(F.length("host")),
        "path_length": number(F.length("path")),
        "depth": number(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))),
        "labels": number(F.size(labels)),
        "digit_share": F.when(size > 0, without("[0-9]+") / size).otherwise(0.0),
        "entropy": F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
                              F.lit(0.0)),
        "parameters": number(F.size(F.filter(F.split(query, "&"), lambda x: x != ""))),
        "hyphens": number(without("-+")),
        "has_query": number(url.contains("?")), "has_fragment": number(url.contains("#")),
        "secure": number(url.startswith("https:")),
        "longest_label": number(F.array_max(F.transform(labels, F.length))),
        "suffix": F.element_at(labels, -1),
        "segment": F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))})


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               limit: int = 20_000, trees: int = 12, depth: int = 4,
               threshold: float = 0.5, seed: int = 1, folds: int = 5,
               learn_from: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row.

    Trees are trained on at most ``limit`` URLs that a rule decides, chosen by
    a hash of the URL; suffix statistics cover all rows.  ``learn_from`` (a
    condition on ``host`` and ``path``) keeps the labels of other URLs from the
    model, to test it on them.  Defined cases: a
    NULL url or one without ``://`` has empty host and path, fits no rule and
    is judged by the trees; if the rules leave no row, or only one verdict,
    to learn from, that verdict (``allow`` without any) is given to the rest;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("_url"))
    rows = (pages.select(F.col(id_col).alias("page_id"),
                         F.coalesce(url_col, F.lit("")).alias("_url"))
            .withColumns({"host": host, "path": path}))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = lexical_features(rows.withColumns({"rule": rule, "_verdict": verdict}))
    rows = cut(rows)
    blocked = F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0)
    if learn_from is not None:
        blocked = F.when(learn_from, blocked)
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("host"), F.lit(folds)).cast("int"))
    total, labelled, share = rows.agg(F.count("*"), F.count(blocked), F.avg(blocked)).first()
    prior = share or 0.0
    for part in ("suffix", "segment"):
        whole = Window.partitionBy(part)
        sums = rows.groupBy(part, "_fold").agg(
            F.count("*").alias("_n"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("_b"),
            F.count(blocked).alias("_k")).select(
            part, "_fold", "_b", "_k", F.sum("_b").over(whole).alias("_all_b"),
            F.sum("_k").over(whole).alias("_all_k"),
            (F.sum("_n").over(whole) / F.lit(float(max(total, 1)))).alias(f"{part}_share"))
        own = lambda c: F.when(blocked.isNotNull(), F.col(c)).otherwise(0)
        rows = rows.join(sums, [part, "_fold"]).withColumn(
            f"{part}_blocked", (F.col("_all_b") - own("_b") + F.lit(10.0 * prior))
            / (F.col("_all_k") - own("_k") + 10.0)).drop("_b", "_k", "_all_b", "_all_k")
    only = "block" if share == 1.0 else "allow"
    if share in (None, 0.0, 1.0):
        scored = rows.withColumn("block_score", F.lit(1.0 if only == "block" else 0.0))
    else:
        sample = (rows.withColumn("label", blocked).where("label is not null")
                  .orderBy(F.xxhash64("_url", F.lit(seed)), "_url", "page_id").limit(limit)
                  .select("label", *FEATURES))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        train = cut(assembler.transform(cut(sample)).select("label", "_features"))
        model = GBTClassifier(labelCol="label", featuresCol="_features", maxIter=trees,
                              maxDepth=depth, seed=seed, stepSize=0.2).fit(train)
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(assembler.transform(rows)).withColumn(
            "block_score", vector_to_array("probability")[1])
    judged = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("_verdict", judged).alias("verdict"), "block_score")


def op10_boosted_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
