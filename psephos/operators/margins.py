"""Contest margins: winner and runner-up of every contest (O-6), and close contests (O-16).

Plan.  One window over the contest in finish order does all the work:
``row_number() <= 2`` lets Spark insert a WindowGroupLimit on both sides of
the shuffle, so each map task forwards at most two entries per contest (a
contest holding a third of all entries still moves two rows per task), and
``lead`` over the same ordering puts the runner-up beside the winner with no
second sort and no self join.  The top-two table is one row per contest and
is joined to the contest totals for the margin percentage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.columns import pct, rank_window
from psephos.schema import CONTEST_KEY, RANKED_ENTRY_COLUMNS


def _prefixed(struct_col: str, prefix: str) -> list:
    names = {
        "candidate": "candidate",
        "party_short": "party_short",
        "party_canonical": "party_canonical",
        "alliance": "alliance",
        "total_votes": "votes",
        "vote_percent": "vote_percent",
    }
    return [F.col(f"{struct_col}.{c}").alias(f"{prefix}_{names[c]}") for c in RANKED_ENTRY_COLUMNS]


def _first_two(places: DataFrame, keys: list[str]) -> DataFrame:
    """Winner and runner-up of every contest from a written ``contest_places`` table: two of its rows, joined on the
    contest.  In buckets by the contest the join needs no exchange; four rows a contest at most, so none is hot."""
    entry = F.struct(*[F.col(c) for c in RANKED_ENTRY_COLUMNS])
    first = places.where(F.col("_place") == 1).select(*keys, "ac_name", entry.alias("_winner"))
    second = places.where(F.col("_place") == 2).select(*keys, entry.alias("_runner"))
    return first.join(second, keys, "left")


def _ranked_two(enriched: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the entries, in one window."""
    w = rank_window(keys)
    entry = F.struct(*[F.col(c) for c in RANKED_ENTRY_COLUMNS])
    return (
        enriched.select(*keys, "ac_name", "sn", *RANKED_ENTRY_COLUMNS)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= 2)
        .withColumn("_runner", F.lead(entry, 1).over(w))
        .where(F.col("_rn") == 1)
        .select(*keys, "ac_name", entry.alias("_winner"), "_runner")
    )


def contest_margins(
    enriched: DataFrame, totals: DataFrame, keys: Sequence[str] = CONTEST_KEY, places: DataFrame | None = None
) -> DataFrame:
    """One row per contest: winner_*, runner_* (null when only one entry), margin_votes, margin_percent.

    Finish order is votes descending, then ballot serial and candidate name,
    so a tie for first gives one reproducible winner and margin 0.  Margin
    percent divides by the contest total from ``totals``; contests missing
    there are dropped.  ``places`` may be a written ``contest_places`` table
    of the same entries, which then are not read.
    """
    keys = list(keys)
    top2 = _first_two(places, keys) if places is not None else _ranked_two(enriched, keys)
    contest_votes = totals.select(*keys, F.col("total_votes").alias("_contest_votes"))
    margin = F.col("_winner.total_votes") - F.coalesce(F.col("_runner.total_votes"), F.lit(0))
    return top2.join(contest_votes, keys, "inner").select(
        *keys,
        "ac_name",
        *_prefixed("_winner", "winner"),
        *_prefixed("_runner", "runner"),
        margin.alias("margin_votes"),
        pct(margin, "_contest_votes").alias("margin_percent"),
    )


def close_contests(margins: DataFrame, max_pct: float = 2.0, limit: int = 10, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """Contests whose margin is at most ``max_pct`` percent, closest first, top ``limit``.

    Ties on the margin are broken by the contest key so the cut is reproducible.
    """
    return (
        margins.where(F.col("margin_percent") <= F.lit(float(max_pct)))
        .orderBy(F.col("margin_percent").asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(limit)
    )
