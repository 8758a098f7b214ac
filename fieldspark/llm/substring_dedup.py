"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``window - seed_words + 1`` word k-grams
in each window the smallest hash is kept (the last on ties), so equal windows
of different documents choose the same anchor.  Documents are joined on the
anchors; an anchor seen once is dropped.  Surviving anchors are extended both
ways: every window that reaches left or right over the anchor is compared
over its full length, and windows that also start earlier are joined into
maximal repeats of at least ``window`` words.  See ``repeats.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import WordRuns, remove_repeats


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = 20, seed_words: int = 8,
                    block_names: int = 1_000_000, turns: int = 1) -> DataFrame:
    """Cut every word covered by a run of ``min_words`` words that starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Returns one row per input
    row: ``_row`` (the other input columns), ``n_units`` (words),
    ``n_removed``, ``n_spans``, ``starts``, ``ends`` (removed word spans, each
    a maximal repeat) and ``kept`` (kept words joined by one space, UTF-8).

    Defined cases: a NULL or empty text has no words; shorter texts lose
    nothing; a NULL id counts as the smallest; rows with equal id and text are
    one document; rows with equal id and different texts are ordered by the
    hash of their text; an empty table gives an empty result.
    """
    if not 1 <= seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    scheme = WordRuns(window=min_words, seed=seed_words)
    return remove_repeats(docs, scheme, id_col, text_col, block_names, turns)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("n_units").alias("n_words"),
                      "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
