"""Winner flag per entry (O-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.operators.grouped import SALT_ROWS, attach_group_aggregates
from psephos.schema import CONTEST_KEY


def winner_flag(votes: Column, contest_max: Column) -> Column:
    """True when the entry has the contest's most votes.

    A tie for first place gives several winners; null votes give null.
    """
    return votes == contest_max


def flag_winners(
    entries: DataFrame,
    keys: Sequence[str] = CONTEST_KEY,
    votes: str = "total_votes",
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Add ``is_winner`` to every entry.

    The contest maximum is a grouped aggregate joined back on the contest
    key (``attach_group_aggregates``): partial aggregation before the
    shuffle, and a contest holding a large share of all entries is split
    over several join tasks.  Entries with a null key find no maximum and
    get a null flag.
    """
    keys = list(keys)
    base = entries.drop("is_winner") if "is_winner" in entries.columns else entries
    with_max = attach_group_aggregates(base, keys, [F.max(votes).alias("_contest_max")], salt_rows=salt_rows)
    return with_max.select(
        *[F.col(f"`{c}`") for c in base.columns],
        winner_flag(F.col(votes), F.col("_contest_max")).alias("is_winner"),
    )
