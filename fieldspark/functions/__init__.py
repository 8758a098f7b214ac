"""Column-level helpers: every function returns a ``pyspark.sql.Column`` built
from built-in expressions, so it stays inside whole-stage codegen."""

from fieldspark.functions.conditionals import case_when, grepl, in_set, r_ifelse
from fieldspark.functions.dates import add_fractional_days, parse_date_any, parse_dmy_mon, parse_mdy
from fieldspark.functions.mathx import inv_logit, log10_pos, power_law, safe_divide
from fieldspark.functions.random import (
    hashed_exponential,
    hashed_gamma,
    hashed_normal,
    hashed_uniform,
    row_digest,
)
from fieldspark.functions.strings import (
    blank_to_null,
    remove_first,
    replace_all_ordered,
    replace_first,
    separate_parts,
    unite_cols,
)

__all__ = [
    "add_fractional_days", "blank_to_null", "case_when", "grepl", "hashed_exponential",
    "hashed_gamma", "hashed_normal", "hashed_uniform", "in_set", "inv_logit", "log10_pos", "parse_date_any",
    "parse_dmy_mon", "parse_mdy", "power_law", "r_ifelse", "remove_first", "replace_all_ordered",
    "replace_first", "row_digest", "safe_divide", "separate_parts", "unite_cols",
]
