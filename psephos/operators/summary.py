"""Party, alliance and independents summaries; party performance (O-2, O-4, O-5, O-9, O-10, O-11, O-15).

Scope.  Vote shares and seat totals are taken within a scope: a list of
columns that are part of the contest key (default ``["state"]`` for parties,
``[]`` = national for alliances).  Every join between summaries is on scope
plus party, so several states never multiply rows.  Totals over a scope are
windows over the summary's own rows.

Aggregates.  Everything is a grouped aggregate with partial aggregation
before the shuffle.  Party performance first collapses entries to one row
per (contest, party): several entries of one party in a contest (as
independents have) become one row, and totals to one row per contest, so "contests
contested" counts each contest once and the join moves at most one row per
party and contest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.columns import pct, ratio
from psephos.schema import ALLIANCE_SCOPE, CONTEST_KEY, IND_SHORT, NOTA_SHORT, OTHER_ALLIANCE, PARTY_SCOPE


def _scope_total(df: DataFrame, scope: Sequence[str], agg: Column, name: str) -> DataFrame:
    """Attach one per-scope aggregate of ``df``, which is an aggregate already (a row for each
    party or alliance), as column ``name``: a window over these few rows, so the entries are read once."""
    return df.withColumn(name, agg.over(Window.partitionBy(*[F.col(c) for c in scope])))


def _attach(df: DataFrame, other: DataFrame, scope: Sequence[str], name: str) -> DataFrame:
    """Attach the single value column ``name`` of ``other`` (one row per scope) to ``df``."""
    if scope:
        return df.join(other, list(scope), "left").select(*[F.col(f"`{c}`") for c in df.columns], name)
    return df.withColumn(name, other.select(name).scalar())


def seat_totals(totals: DataFrame, scope: Sequence[str], keys: Sequence[str] = CONTEST_KEY, name: str = "_total_seats") -> DataFrame:
    """Number of distinct contests per scope (one row per scope; one row overall for no scope)."""
    return totals.groupBy(*scope).agg(F.count_distinct(*[F.col(k) for k in keys]).alias(name))


def _contest_votes(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Votes and rows of every contest in ``totals``, one row each."""
    return totals.groupBy(*keys).agg(F.sum("total_votes").alias("_contest_votes"), F.count(F.lit(1)).alias("_totals_rows"))


def _seats(contest_votes: DataFrame, scope: Sequence[str], keys: Sequence[str], name: str = "_total_seats") -> DataFrame:
    """``seat_totals`` from ``_contest_votes``: the same exchange serves both."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return contest_votes.groupBy(*scope).agg(F.count_if(whole).alias(name))


def party_summary(candidates: DataFrame, scope: Sequence[str] = PARTY_SCOPE) -> DataFrame:
    """Seats won, votes and vote share per raw party within the scope.

    ``seats_won`` counts winner flags (a tie gives each tied party a seat);
    ``vote_share`` is the party's votes over all votes in its scope, in percent.
    """
    g = candidates.groupBy(*scope, "party").agg(
        F.count_if(F.col("is_winner")).alias("seats_won"),
        F.sum("total_votes").alias("total_votes"),
    )
    g = _scope_total(g, scope, F.sum("total_votes"), "_scope_votes")
    return g.select(*scope, "party", "seats_won", "total_votes", pct("total_votes", "_scope_votes").alias("vote_share"))


def alliance_summary(
    candidates: DataFrame,
    party_map: DataFrame,
    totals: DataFrame,
    scope: Sequence[str] = ALLIANCE_SCOPE,
    split_unmapped: bool = False,
    keys: Sequence[str] = CONTEST_KEY,
) -> DataFrame:
    """Seats, votes, vote share, seat share and seat-vote gap per alliance.

    Parties missing from the map count as OTHER.  By default they are merged
    with the parties the map puts in OTHER (one OTHER row).  With
    ``split_unmapped=True`` the grouping is on the map's own alliance value,
    which gives the reference's two rows both labelled OTHER (one for mapped,
    one for unmapped parties).  Seat share divides by the number of distinct
    contests in ``totals`` within the scope.
    """
    pm = party_map.select(F.col("party_name").alias("_pm_name"), F.col("alliance").alias("_pm_alliance"))
    j = candidates.select(*scope, "party", "is_winner", "total_votes").join(
        pm, F.col("party") == F.col("_pm_name"), "left"
    )
    label = F.coalesce(F.col("_pm_alliance"), F.lit(OTHER_ALLIANCE))
    aggs = [F.count_if(F.col("is_winner")).alias("seats_won"), F.sum("total_votes").alias("total_votes")]
    if split_unmapped:
        g = j.groupBy(*scope, "_pm_alliance").agg(*aggs).select(
            *scope, label.alias("alliance"), "seats_won", "total_votes"
        )
    else:
        g = j.groupBy(*scope, label.alias("alliance")).agg(*aggs)
    g = _scope_total(g, scope, F.sum("total_votes"), "_scope_votes")
    g = _attach(g, seat_totals(totals, scope, keys), scope, "_total_seats")
    vote_share = pct("total_votes", "_scope_votes")
    seat_share = pct("seats_won", "_total_seats")
    return g.select(
        *scope,
        "alliance",
        "seats_won",
        "total_votes",
        vote_share.alias("vote_share"),
        seat_share.alias("seat_share"),
        (seat_share - vote_share).alias("seat_vote_gap"),
    )


def party_contest_stats(
    enriched: DataFrame,
    totals: DataFrame,
    group_cols: Sequence[str],
    scope: Sequence[str] = PARTY_SCOPE,
    keys: Sequence[str] = CONTEST_KEY,
    parties: DataFrame | None = None,
) -> DataFrame:
    """Per party group: contests contested, seats won, votes, and votes cast in those contests.

    NOTA and entries without a party are left out.  Contests with no row in
    ``totals`` are dropped (inner join).  ``total_votes_in_those_acs`` adds
    the contest total once per entry, so a party with three entries in a
    contest counts that contest's total three times (as the reference does).
    A contest with several rows in ``totals`` is one contest contested; its
    votes and wins count once per totals row, as a join on the contest gives.
    ``parties`` may be a written ``contest_parties`` table of the same
    entries; it is used when ``group_cols`` are among its columns.
    """
    keys = list(keys)
    ps = F.col("party_short")
    eligible = ps.isNotNull() & (ps != NOTA_SHORT)
    if parties is not None and set(group_cols) <= set(parties.columns):
        per_contest = (
            parties.where(eligible)
            .groupBy(*keys, *group_cols)
            .agg(F.sum("entries").alias("_n"), F.sum("won").alias("_won"), F.sum("votes").alias("_votes"))
        )
    else:
        per_contest = (
            enriched.where(eligible)
            .groupBy(*keys, *group_cols)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.count_if(F.col("is_winner")).alias("_won"),
                F.sum("total_votes").alias("_votes"),
            )
        )
    return (
        per_contest.join(_contest_votes(totals, keys), keys, "inner")
        .groupBy(*scope, *group_cols)
        .agg(
            F.count(F.lit(1)).alias("seats_contested"),
            F.sum(F.col("_won") * F.col("_totals_rows")).alias("seats_won"),
            F.sum(F.col("_votes") * F.col("_totals_rows")).alias("total_votes_contested"),
            F.sum(F.col("_n") * F.col("_contest_votes")).alias("total_votes_in_those_acs"),
        )
    )


def _with_state_share(stats: DataFrame, party_summary_enriched: DataFrame, scope: Sequence[str]) -> DataFrame:
    share = party_summary_enriched.select(*scope, "party_short", F.col("vote_share").alias("state_vote_share"))
    return stats.join(share, [*scope, "party_short"], "left")


def party_performance(
    enriched: DataFrame,
    totals: DataFrame,
    party_summary_enriched: DataFrame,
    scope: Sequence[str] = PARTY_SCOPE,
    keys: Sequence[str] = CONTEST_KEY,
    parties: DataFrame | None = None,
) -> DataFrame:
    """Strike rate, average votes per contest, share where contested, seat share and seat-vote gap.

    ``parties`` may be a written ``contest_parties`` table of the same entries.
    """
    group_cols = ["party_short", "party_canonical", "alliance"]
    stats = party_contest_stats(enriched, totals, group_cols, scope, keys, parties)
    j = _with_state_share(stats, party_summary_enriched, scope)
    j = _attach(j, _seats(_contest_votes(totals, keys), scope, keys), scope, "_total_seats")
    seat_share = pct("seats_won", "_total_seats")
    gap = F.when(
        F.col("_total_seats") > 0,
        F.col("seats_won").cast("double") * F.lit(100.0) / F.col("_total_seats").cast("double")
        - F.coalesce(F.col("state_vote_share"), F.lit(0.0)),
    )
    return j.select(
        *scope,
        *group_cols,
        "seats_contested",
        "seats_won",
        pct("seats_won", "seats_contested").alias("strike_rate"),
        ratio("total_votes_contested", "seats_contested").alias("avg_votes_per_seat"),
        pct("total_votes_contested", "total_votes_in_those_acs").alias("vote_pct_contested"),
        "state_vote_share",
        seat_share.alias("seat_share"),
        gap.alias("seat_vote_gap"),
    )


def party_performance_filtered(
    enriched: DataFrame,
    totals: DataFrame,
    party_summary_enriched: DataFrame,
    min_seats_won: int = 0,
    min_vote_share: float = 0.0,
    scope: Sequence[str] = PARTY_SCOPE,
    keys: Sequence[str] = CONTEST_KEY,
    parties: DataFrame | None = None,
) -> DataFrame:
    """Performance per (party_short, alliance), kept when seats_won >= m OR vote share >= v; biggest share first.

    With the defaults (0, 0.0) every party is kept.  ``parties`` may be a
    written ``contest_parties`` table of the same entries.
    """
    group_cols = ["party_short", "alliance"]
    stats = party_contest_stats(enriched, totals, group_cols, scope, keys, parties)
    j = _with_state_share(stats, party_summary_enriched, scope)
    keep = (F.col("seats_won") >= F.lit(min_seats_won)) | (F.col("state_vote_share") >= F.lit(float(min_vote_share)))
    return (
        j.where(keep)
        .select(
            *scope,
            *group_cols,
            "seats_contested",
            "seats_won",
            pct("seats_won", "seats_contested").alias("strike_rate"),
            ratio("total_votes_contested", "seats_contested").alias("avg_votes_per_seat"),
            pct("total_votes_contested", "total_votes_in_those_acs").alias("vote_pct_contested"),
            "state_vote_share",
        )
        .orderBy(F.col("state_vote_share").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in (*scope, *group_cols)])
    )


def independents_summary(enriched: DataFrame, ind_short: str = IND_SHORT) -> DataFrame:
    """Independents' votes, their share of all votes and the seats they won (one row)."""
    is_ind = F.col("party_short") == ind_short
    g = enriched.agg(
        F.sum(F.when(is_ind, F.col("total_votes")).otherwise(F.lit(0))).alias("total_ind_votes"),
        F.sum("total_votes").alias("total_votes"),
        F.sum(F.when(is_ind & F.col("is_winner"), F.lit(1)).otherwise(F.lit(0))).alias("seats_won_by_ind"),
    )
    return g.select(
        "total_ind_votes",
        "total_votes",
        pct("total_ind_votes", "total_votes").alias("ind_vote_share"),
        "seats_won_by_ind",
    )


def overview_parties(party_summary_enriched: DataFrame, scope: Sequence[str] = PARTY_SCOPE) -> DataFrame:
    """Parties by seats won, then vote share (the overview table)."""
    return party_summary_enriched.select(
        *scope, "party_short", "party_canonical", "alliance", "seats_won", "total_votes", "vote_share"
    ).orderBy(
        F.col("seats_won").desc_nulls_last(),
        F.col("vote_share").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in (*scope, "party_short")],
    )


def overview_alliances(alliance_summary_df: DataFrame, scope: Sequence[str] = ALLIANCE_SCOPE) -> DataFrame:
    """Alliances by seats won (the overview table)."""
    return alliance_summary_df.select(
        *scope, "alliance", "seats_won", "total_votes", "vote_share", "seat_share", "seat_vote_gap"
    ).orderBy(F.col("seats_won").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in (*scope, "alliance")])
