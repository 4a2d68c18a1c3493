"""Numeric and ordering Column helpers.

All arithmetic is done in double only at the last step: whole-number vote
counts are summed as bigint and divided as ``double(n) * 100.0 / double(d)``.
Every division is guarded by ``d > 0`` so ANSI mode never raises on a zero
or null denominator; the guarded value is null instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col_or(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnOrName, den: ColumnOrName, scale: float = 1.0) -> Column:
    """``num * scale / den`` in double, null unless ``den > 0``."""
    n, d = col_or(num), col_or(den)
    return F.when(d > 0, n.cast("double") * F.lit(float(scale)) / d.cast("double"))


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Percentage ``num * 100 / den`` in double, null unless ``den > 0``."""
    return ratio(num, den, 100.0)


def nan_to_null(c: ColumnOrName) -> Column:
    """Turn NaN into null (for double columns leaving through JSON)."""
    x = col_or(c)
    return F.when(~F.isnan(x), x)


def rank_order(votes: str = "total_votes", tie_breakers: Sequence[str] = ("sn", "candidate")) -> list[Column]:
    """Finish order inside a contest: most votes first (null last), then ballot order.

    The tie-breakers make ``row_number`` reproducible when two entries have
    the same votes: the lower serial number, then the candidate name, ranks first.
    """
    return [F.col(votes).desc_nulls_last()] + [F.col(t).asc_nulls_last() for t in tie_breakers]


def rank_window(keys: Sequence[str], votes: str = "total_votes", tie_breakers: Sequence[str] = ("sn", "candidate")) -> WindowSpec:
    """Window over one contest in finish order."""
    return Window.partitionBy(*keys).orderBy(*rank_order(votes, tie_breakers))

