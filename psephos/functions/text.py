"""Text predicates and cleaners as Column expressions (JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.functions.columns import ColumnOrName, col_or

# The characters Python's str.strip() removes by default
# (str.isspace() is true for exactly these code points).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The words that make a statement unsafe, and the statement
# starts that make it a query (the reference's read-only check).
UNSAFE_SQL_WORDS = ("insert", "update", "delete", "drop", "alter", "create", "truncate")
SAFE_SQL_STARTS = ("select", "with")


def python_strip(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace the way Python's ``str.strip()`` does.

    ``btrim`` with a character set only looks at the two ends of the text.
    """
    return F.btrim(col_or(c), F.lit(PY_WHITESPACE))


# The read-only rule as one pattern over a stripped, lower-cased statement; the
# column form and the check of a single statement both use it.
READ_ONLY_PATTERN = rf"(?s)\A(?:{'|'.join(SAFE_SQL_STARTS)})(?!.*(?:{'|'.join(UNSAFE_SQL_WORDS)}))"


def sql_is_read_only(c: ColumnOrName) -> Column:
    """True when the text is a single read-only query by the reference's word rule.

    Lower-cased and stripped, it must start with ``select`` or ``with`` and
    contain none of the unsafe words anywhere (as substrings, so ``created``
    is refused too).  Null text gives null.
    """
    return F.lower(python_strip(c)).rlike(READ_ONLY_PATTERN)


def strip_code_fences(c: ColumnOrName) -> Column:
    """Strip a markdown code fence around generated SQL, then surrounding whitespace.

    In order: strip whitespace; cut a leading fence written with the ``sql``
    tag, and then one more bare fence if the rest starts with one, or else a
    bare leading fence; cut one trailing fence from what is left; strip again.
    The cut lengths are decided from the two ends only, so the text is not
    scanned.
    """
    s = python_strip(c)
    n = F.length(s)
    lead = (
        F.when(s.startswith("```sql```"), F.lit(9))
        .when(s.startswith("```sql"), F.lit(6))
        .when(s.startswith("```"), F.lit(3))
        .otherwise(F.lit(0))
    )
    tail = F.when(s.endswith("```") & (n - lead >= 3), F.lit(3)).otherwise(F.lit(0))
    return python_strip(s.substr(lead + 1, n - lead - tail))


def contains_pattern(q: str) -> str:
    """``%q%`` for ILIKE, keeping ``%`` and ``_`` in ``q`` as wildcards (as the reference does).

    Spark's LIKE treats backslash as the escape character; the reference's
    engine has none, so a backslash in ``q`` is doubled to stay literal.
    """
    return "%" + q.replace("\\", "\\\\") + "%"
