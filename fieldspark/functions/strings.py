"""String helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ALNUM = "[^A-Za-z0-9]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_first(c: str | Column, pattern: str, replacement: str) -> Column:
    """Replace only the first regex match (``regexp_replace`` replaces all).

    A lazy prefix anchored at the start captures everything before the first
    match; ``(?s)`` lets the prefix span newlines.  ``$`` and ``\\`` in the
    replacement are escaped so it is taken literally.
    """
    rep = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", f"$1{rep}")


def remove_first(c: str | Column, pattern: str) -> Column:
    return replace_first(c, pattern, "")


def replace_all_ordered(c: str | Column, rules: Mapping[str, str] | Sequence[tuple[str, str]]) -> Column:
    """Apply regex replace-all rules one after another, in the given order.

    Later rules see the output of earlier ones, so a rule may re-match text
    produced by a previous one (the same as applying them in sequence).
    """
    items = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    out = _col(c)
    for pattern, rep in items:
        out = F.regexp_replace(out, pattern, rep.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def separate_parts(c: str | Column, n: int, sep: str = NON_ALNUM) -> list[Column]:
    """Split on a regex and return the first ``n`` pieces.

    Extra pieces are dropped; missing pieces are NULL; a NULL input gives
    NULL pieces.  The default separator is any run of non-alphanumerics.
    """
    parts = F.split(_col(c), sep)
    return [F.try_element_at(parts, F.lit(i + 1)) for i in range(n)]


def unite_cols(cols: Iterable[str | Column], sep: str = "_") -> Column:
    """Concatenate columns with a separator; NULL becomes the text ``NA``.

    ``concat_ws`` alone would skip NULLs, which changes the number of
    pieces, so NULLs are replaced first.
    """
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def blank_to_null(c: str | Column) -> Column:
    """Empty (or all-blank) string -> NULL; other values unchanged."""
    col = _col(c)
    return F.when(F.length(F.trim(col)) > 0, col)


def snake_case(name: str) -> str:
    """Normalise a column name to snake_case.

    camelCase boundaries become underscores, every run of characters other
    than letters and digits becomes one underscore, leading and trailing
    underscores are dropped, and the result is lower case.  A name that
    starts with a digit is prefixed with ``x``; an empty result becomes
    ``x``.
    """
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        return "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def unique_names(names: Sequence[str]) -> list[str]:
    """Make names unique by appending ``_2``, ``_3``... to repeats."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}_{seen[n]}")
        else:
            seen[n] = 1
            out.append(n)
    return out
