"""Readers, column-name normalisation, literal tables and sinks."""

from fieldspark.sources.readers import (
    add_row,
    clean_names,
    literal_table,
    read_csv_typed,
    read_table,
)
from fieldspark.sources.sinks import read_stage, write_csv, write_stage

__all__ = [
    "add_row", "clean_names", "literal_table", "read_csv_typed", "read_stage", "read_table",
    "write_csv", "write_stage",
]
