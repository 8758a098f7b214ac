"""Sinks and stage hand-off.

Stage outputs are Parquet, optionally partitioned by a low-cardinality
column (``data_level``, ``date``) so later stages prune partitions.  CSV is
for final, small report tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, quote_strings: bool = False, mode: str = "overwrite",
              order_by: Sequence[str] = ()) -> None:
    """CSV with a header; NULL is written as ``NA``.

    ``quote_strings`` quotes names and text fields (quotes inside doubled),
    never numbers or ``NA``, as R's ``write.csv`` does; line breaks within a
    field become a space.  ``order_by`` sorts
    the report (``-col`` descending, NULLs last).
    """
    if order_by:
        from fieldspark.operators.project import arrange

        df = arrange(df, *order_by)
    writer = df.write.mode(mode).option("header", True).option("nullValue", "NA").option("escape", '"')
    if quote_strings:
        def field(f):
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StringType):
                text = F.replace(F.regexp_replace(c, "[\\r\\n]+", " "), F.lit('"'), F.lit('""'))
                c = F.concat(F.lit('"'), text, F.lit('"'))
            return F.coalesce(c.cast("string"), F.lit("NA"))

        # Spark quotes every field or only those that need it; so each line is
        # put together here and written as one field.
        header = ",".join(f'"{c}"' for c in df.columns)
        lines = df.select(F.concat_ws(",", *map(field, df.schema.fields)).alias(header))
        writer = lines.write.mode(mode).option("header", True).options(
            sep="\u0001", quote="\u0000", escapeQuotes=False)
    writer.csv(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Persist an intermediate table for the next stage as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
