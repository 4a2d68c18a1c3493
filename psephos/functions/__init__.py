"""Column-level helpers: guarded ratios, ranking order, text predicates."""

from psephos.functions.columns import (
    col_or,
    pct,
    ratio,
    nan_to_null,
    rank_order,
    rank_window,
)
from psephos.functions.text import (
    contains_pattern,
    python_strip,
    sql_is_read_only,
    strip_code_fences,
)

__all__ = [
    "col_or",
    "pct",
    "ratio",
    "nan_to_null",
    "rank_order",
    "rank_window",
    "contains_pattern",
    "python_strip",
    "sql_is_read_only",
    "strip_code_fences",
]
