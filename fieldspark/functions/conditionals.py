"""Conditional helpers with R's NULL rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def case_when(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First true predicate wins; no match gives ``default`` (NULL if None).

    A NULL predicate counts as not matched, as in ``case_when``.
    """
    out = None
    for pred, value in branches:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(pred, v) if out is None else out.when(pred, v)
    if out is None:
        return F.lit(default)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def r_ifelse(pred: Column, yes: object, no: object) -> Column:
    """Two-branch conditional where a NULL test gives NULL (``ifelse``).

    ``when(p, a).otherwise(b)`` would take ``b`` for a NULL test.
    """
    y = yes if isinstance(yes, Column) else F.lit(yes)
    n = no if isinstance(no, Column) else F.lit(no)
    return F.when(pred, y).when(~pred, n)


def in_set(c: str | Column, values: Iterable[object]) -> Column:
    """Set membership that is FALSE (not NULL) for a NULL left-hand side."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def grepl(pattern: str, c: str | Column, fixed: bool = False) -> Column:
    """Regex (or literal) match; NULL input gives FALSE."""
    col = _col(c)
    test = col.contains(pattern) if fixed else col.rlike(pattern)
    return F.coalesce(test, F.lit(False))
