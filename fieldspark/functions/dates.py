"""Date parsing and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def pivot_two_digit_year(d: Column) -> Column:
    """Two-digit years 69-99 belong to the 1900s (POSIX ``%y``).

    Spark's ``yy`` maps every two-digit year into 2000-2099.
    """
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_mdy(c: str | Column) -> Column:
    """Month/day/year with 4- or 2-digit years; unparseable -> NULL.

    ``M/d/yyyy`` rejects two-digit years and ``M/d/yy`` rejects four-digit
    years, so the two patterns never both match.  Two-digit years 00-68
    are 2000-2068, 69-99 are 1969-1999.
    """
    col = _col(c)
    # Cheap shape checks first: a failed parse costs an exception inside
    # the JVM, a regex test does not.
    four = F.when(col.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(col, "M/d/yyyy"))
    two = F.when(col.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"),
                 pivot_two_digit_year(F.try_to_date(col, "M/d/yy")))
    return F.coalesce(four, two)


def parse_dmy_mon(c: str | Column) -> Column:
    """``d-MMM-yy`` dates such as ``7-Jun-17``; unparseable -> NULL."""
    col = _col(c)
    return F.when(col.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"),
                  pivot_two_digit_year(F.try_to_date(col, "d-MMM-yy")))


def parse_date_any(c: str | Column) -> Column:
    """ISO, month/day/year or day-month-name-year, first that parses."""
    col = _col(c)
    iso = F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(col, "yyyy-MM-dd"))
    return F.coalesce(iso, parse_mdy(col), parse_dmy_mon(col))


def add_fractional_days(date_col: str | Column, days: str | Column | float) -> Column:
    """Date plus a (fractional) number of days as TIMESTAMP_NTZ.

    The offset is applied in whole seconds, so 0.25 days is 6 hours.
    """
    d = days if isinstance(days, Column) else (F.col(days) if isinstance(days, str) else F.lit(days))
    seconds = F.round(d * F.lit(86400.0)).cast("bigint")
    return F.timestamp_add("SECOND", seconds, _col(date_col).cast("date").cast("timestamp_ntz"))
