"""Consumer-resource (food web) tables.

Input: a diet table with ``species``, ``prey_taxon``, ``mg_diet_dm``.
Layout coordinates are level codes rescaled over the table, computed on the
distinct names of either side and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.conditionals import case_when, grepl, r_ifelse
from fieldspark.functions.random import hashed_normal
from fieldspark.functions.strings import replace_first, separate_parts
from fieldspark.operators.aggregate import proportion_within
from fieldspark.operators.project import drop_na
from fieldspark.operators.ranking import dense_names
from fieldspark.operators.reshape import stack_roles
from fieldspark.operators.window import first_per_key


def diet_proportions(d: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Share of each prey taxon in each consumer's diet, as (consumer, resource, diet_post)."""
    prop = proportion_within(d, ["species"], ["prey_taxon"], "mg_diet_dm")
    out = prop.select(F.col("species").alias("consumer"), F.col("prey_taxon").alias("resource"),
                      F.col("proportion").alias("diet_post"))
    if exclude:
        out = out.where(~F.col("resource").isin(list(exclude)))
    return out


def positions(props: DataFrame, col: str, out: str, lo: float, hi: float,
              first: Sequence[str] = ()) -> DataFrame:
    """``col, out``: level codes of the distinct names rescaled to [lo, hi].

    Levels named in ``first`` come first, in that order (``fct_relevel``
    before the codes); the others follow in binary order.  A single level
    gets the middle.
    """
    coded = dense_names(props, col, "__code", first, "__levels")
    code, k = F.col("__code"), F.col("__levels")
    value = F.when(k == 1, F.lit((lo + hi) / 2.0)).otherwise(
        F.try_divide(code.cast("double") - 1.0, k.cast("double") - 1.0) * F.lit(hi - lo) + F.lit(lo))
    return coded.select(F.col(col).alias("__at"), value.alias(out))


def layout(props: DataFrame, consumer_range: tuple[float, float] = (0.25, 0.75),
           resource_range: tuple[float, float] = (0.0, 1.0), jitter_sd: float = 0.0,
           seed: int = 2020, consumer_first: Sequence[str] = (),
           resource_first: Sequence[str] = ()) -> DataFrame:
    """Attach x positions: level codes of consumers and resources, rescaled.

    Positions come from the distinct names of either side, joined back.
    ``jitter_sd`` adds a normal offset per resource drawn from a hash of
    the resource name (reproducible on any partitioning).
    """
    out = drop_na(props, ["consumer"])
    for col, name, span, first in (("consumer", "xend", consumer_range, consumer_first),
                                   ("resource", "x", resource_range, resource_first)):
        at = positions(out, col, name, *span, first)
        out = out.join(at, F.col(col) == F.col("__at"), "left").drop("__at")
    off = hashed_normal(["resource"], seed, 0.0, jitter_sd) if jitter_sd else F.lit(0.0)
    return out.withColumn("offset", off).withColumn("x1", F.col("x") + F.col("offset"))


def edge_table(props: DataFrame, special_y: Mapping[str, float], colour_pattern: str,
               colour_names: tuple[str, str], **layout_kw) -> DataFrame:
    """Edges resource -> consumer with positions, sizes and colours."""
    e = layout(props.where(F.col("resource").isNotNull()), **layout_kw)
    y = case_when([(F.col("resource") == F.lit(k), F.lit(float(v))) for k, v in special_y.items()],
                  F.lit(1.0))
    return (e.withColumn("size", F.col("diet_post"))
            .withColumn("xend1", F.col("xend") + F.col("offset"))
            .withColumn("color", r_ifelse(grepl(colour_pattern, "resource"), *colour_names))
            .withColumn("diet_post_corrected", F.col("diet_post"))
            .withColumn("repeats", F.col("diet_post") * F.lit(100.0))
            .withColumn("y", y)
            .withColumn("yend", F.lit(2.0)))


def node_table(edges: DataFrame, colour_pattern: str, colour_names: tuple[str, str],
               with_stage: bool = True) -> DataFrame:
    """Both ends of every edge stacked as nodes with their coordinates.

    Resource names have their first ``_`` turned into ``-``; with
    ``with_stage`` they are split into taxon and stage.
    """
    roles = edges.select(
        F.struct(replace_first("resource", "_", "-").alias("taxon"), "x", "y").alias("resource"),
        F.struct(F.col("consumer").alias("taxon"), F.col("xend").alias("x"),
                 F.col("yend").alias("y")).alias("consumer"))
    nodes = stack_roles(roles, ["resource", "consumer"], "trophic", "node").select(
        "node.taxon", "trophic", "node.x", "node.y")
    nodes = nodes.withColumn("color", r_ifelse(grepl(colour_pattern, "taxon"), *colour_names))
    if with_stage:
        tu, stage = separate_parts("taxon", 2)
        nodes = nodes.withColumn("taxon_ungrouped", tu) \
            .withColumn("stage", F.coalesce(stage, F.lit("unknown")))
    return nodes


def node_labels(nodes: DataFrame, label_pattern: str, labels: Mapping[str, str]) -> DataFrame:
    """One row per taxon with labels: its resource row, as resources are
    stacked first, then the first by position."""
    role = F.when(F.col("trophic") == "resource", 0).otherwise(1)
    first = first_per_key(nodes, ["taxon"], [role, "x", "y"])
    lab = case_when([(F.col("taxon") == F.lit(k), F.lit(v)) for k, v in labels.items()])
    return (first.withColumn("prey_label", r_ifelse(grepl(label_pattern, "taxon"), F.col("taxon"),
                                                    F.lit(None).cast("string")))
            .withColumn("label", lab))
