"""Typed readers and literal tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.strings import snake_case, unique_names


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet table ``{base}/{name}.parquet`` (the default storage format)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | None,
                   blank_strings_to_null: bool = True, metadata: bool = False) -> DataFrame:
    """CSV with header and an explicit schema; ``NA`` and empty fields are NULL.

    The file's header must name the columns of ``schema`` in order, letter
    case aside; only an unnamed row-number column (``...1`` or blank) may be
    read under another name, e.g. ``row_id``.  Anything else is an error, as
    columns would be read under wrong names.
    Quoted empty strings survive the CSV reader as ``''``; with
    ``blank_strings_to_null`` every string column maps blank to NULL too.
    ``schema=None`` infers types (an extra pass over the file; a helper for
    exploring new files, not for production reads).  With ``metadata`` the
    file's ``_metadata`` column is kept.
    """
    if schema is not None:
        header = spark.read.option("header", True).csv(path).columns
        named = [h.strip().lower() for h in header]
        wrong = [(h, f) for h, f in zip(named, schema.names)
                 if h != f.lower() and not re.fullmatch(r"(\.\.\.\d+|_c\d+|)", h)]
        if wrong or len(header) != len(schema.names):
            raise ValueError(f"header {header} does not match the schema {schema.names}")
    reader = spark.read.schema(schema) if schema is not None else \
        spark.read.option("inferSchema", True)
    df = (reader
          .option("header", True)
          .option("nullValue", "NA")
          .option("emptyValue", None)
          .option("escape", '"')  # a quote inside a field is doubled
          .option("mode", "PERMISSIVE")
          .csv(path))
    if blank_strings_to_null:
        df = df.select(*[
            F.when(F.length(F.trim(F.col(f"`{f.name}`"))) > 0, F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ], *(["_metadata"] if metadata else []))
    elif metadata:
        df = df.select("*", "_metadata")
    return df


def read_csv_numbered(spark: SparkSession, path: str, schema: T.StructType,
                      out: str = "row_id", blank_strings_to_null: bool = True) -> DataFrame:
    """``read_csv_typed`` with a 1-based row number in file order.

    The order is file path, place of the split in the file, line in the split.
    Rows are numbered within their splits and the rows of earlier splits are
    added, so no task sees more than a split; the numbers do not depend on how
    the files are split or read.  Files may not hold fields with line breaks.
    """
    from fieldspark.operators.ranking import number_rows

    lines = read_csv_typed(spark, path, schema, blank_strings_to_null, metadata=True)
    placed = lines.withColumns({
        "__split": F.struct(F.col("_metadata.file_path").alias("path"),
                            F.col("_metadata.file_block_start").alias("start")),
        # Increases along the lines of a split; only compared within one.
        "__line": F.monotonically_increasing_id()}).select(*schema.names, "__split", "__line")
    return number_rows(placed, F.col("__split"), [F.col("__line")], out).select(out, *schema.names)


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to unique snake_case (a projection, no data pass)."""
    return df.toDF(*unique_names([snake_case(c) for c in df.columns]))


def literal_table(spark: SparkSession, rows: Sequence[Sequence[object]] | Sequence[Mapping],
                  schema: T.StructType | str) -> DataFrame:
    """A small inline table (a fixed parameter list, not data)."""
    return spark.createDataFrame(list(rows), schema=schema)


def add_row(df: DataFrame, **values: object) -> DataFrame:
    """Append one literal row by name; unnamed columns are NULL.

    Values are cast to the column types of ``df``; the one-row side is a
    local relation, so the union adds no scan.
    """
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    row = df.sparkSession.range(1).select(*[
        (F.lit(values[f.name]) if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in df.schema.fields
    ])
    return df.unionByName(row)
