"""Suffix-array deduplication with a difference cover.

A sparse form of difference-cover suffix sorting.  The three-position cover of
the classic algorithm is replaced by a perfect difference set modulo 57: for
any two suffixes some shift below 57 brings both onto sampled positions,
although only 8 of 57 positions are sampled.

* *Sort the sampled tuples.*  The tuple at a sampled position is its next
  ``min_bytes - 56`` bytes.  Tuples get names (64-bit fingerprints cut to
  48 bits) which are sorted over the cluster in ranges.
* *Recurse on names with discarding.*  A sampled suffix whose name occurs once
  cannot belong to a repeat and is discarded.  The names that are left already
  order suffixes to ``min_bytes - 56`` bytes, so with the depth asked for the
  recursion stops after this level.
* *Merge the remaining suffixes.*  The suffixes within 56 bytes before a
  surviving position are named to the full ``min_bytes`` depth (96 bits) and
  sorted together, sampled and unsampled alike.
* *Compare adjacent prefixes.*  Suffixes next to each other with the same
  prefix repeat; all but the first in document order are cut out.

Names are fingerprints, not ranks, because ranks would need the whole sorted
order of each level before the next; equality of prefixes is all that
deduplication needs.  See ``repeats.py`` for the Spark phases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Bytes, remove_repeats

# Perfect difference sets (modulus: residues); every nonzero
# residue is a difference of exactly one ordered pair.
DIFFERENCE_COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 6, 15, 22, 26, 45, 55),
}


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       min_bytes: int = 100, period: int = 57,
                       block_names: int = 1_000_000, turns: int = 2) -> DataFrame:
    """Cut every byte covered by a ``min_bytes`` string that starts earlier.

    Returns one row per input row: ``_row`` (the other input columns),
    ``n_units`` (bytes), ``n_removed``, ``n_spans``, ``starts``, ``ends``
    (removed byte spans) and ``kept`` (remaining bytes).

    Defined cases: a NULL or empty text has 0 bytes and keeps 0 bytes; texts
    shorter than ``min_bytes`` lose nothing; a NULL id counts as the smallest;
    rows with equal id and text are one document and get equal results; rows
    with equal id and different texts are compared as separate documents in
    the order of the hash of their text; an empty table gives an empty result.
    """
    if period not in DIFFERENCE_COVERS or min_bytes - period < 7:
        raise ValueError("period must be a known cover and leave at least 8 bytes to a name")
    scheme = Bytes(window=min_bytes, seed=min_bytes - period + 1,
                   cover=DIFFERENCE_COVERS[period], period=period)
    return remove_repeats(docs, scheme, id_col, text_col, block_names, turns)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_array_dedup(docs)
    return out.select(F.col("_row.doc_id").alias("doc_id"), F.col("n_units").alias("n_bytes"),
                      "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
