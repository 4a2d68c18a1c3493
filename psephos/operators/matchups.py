"""Relevant parties, opponents and head-to-head comparisons (O-12, O-13, O-14).

No operator here joins entries with entries.  Both matchup operators start
from ``contest_parties``: one row per (contest, party).  Opponent counts are
the number of (subject entry, opponent entry) pairs sharing a contest; they
are the sum over contests of n_subject * n_opponent over that table, so the
pairs are never made.
Head to head is one conditional hash aggregate over the two parties' rows,
joined to the winner of each contest (both sides one row per contest).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.columns import rank_window
from psephos.operators.grouped import SALT_ROWS
from psephos.operators.positions import in_vote_bands, vote_band_counts
from psephos.schema import CONTEST_KEY, IND_SHORT, PARTY_SCOPE


def finishers(margins: DataFrame, scope: Sequence[str] = PARTY_SCOPE) -> DataFrame:
    """(scope, party_short) of every party that won or came second somewhere in the scope.

    One read of the margins; the distinct rows are as many as the parties, whatever the number of contests.
    """
    both = F.explode(F.array("winner_party_short", "runner_party_short"))
    return margins.select(*scope, both.alias("party_short")).where(F.col("party_short").isNotNull()).distinct()


def relevant_parties(margins: DataFrame, party_summary_enriched: DataFrame, scope: Sequence[str] = PARTY_SCOPE) -> DataFrame:
    """Parties that won or came second in a contest of their scope, independents excluded.

    NOTA stays in when it finished second somewhere.  Ordered by seats won,
    then votes.
    """
    ps = party_summary_enriched.where(F.col("party_short") != IND_SHORT)
    return (
        ps.join(finishers(margins, scope), [*scope, "party_short"], "left_semi")
        .orderBy(
            F.col("seats_won").desc_nulls_last(),
            F.col("total_votes").desc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in (*scope, "party_short")],
        )
        .select(*scope, "party_short")
    )


def contest_parties(enriched: DataFrame, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """One row per (contest, party): entries, winners, votes, best votes and best vote percent there, entries by vote band.

    The per-contest collapse ``opponents``, ``head_to_head`` and the filtered
    party performance start from (a hash aggregate with partial aggregation).  The dataset build
    writes it once; the operators compute it when it is not given.
    """
    return enriched.groupBy(*keys, "ac_name", "party_short", "party_canonical", "alliance").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("is_winner")).alias("won"),
        F.sum("total_votes").alias("votes"),
        F.max("total_votes").alias("best_votes"),
        F.max("vote_percent").alias("best_pct"),
        *vote_band_counts(),
    )


def contest_parties_dealt(
    enriched: DataFrame, buckets: int, keys: Sequence[str] = CONTEST_KEY, hot_rows: int = SALT_ROWS
) -> DataFrame:
    """``contest_parties``, its rows dealt by the contest to ``buckets`` partitions, with one exchange of the entries.

    Entries go to their contest's partition as they are, without their bands, and are
    collapsed there.  Contests of more than ``hot_rows`` entries (of N entries N / hot_rows
    contests at most, which travel in a broadcast) are collapsed before, so no partition
    takes more than ``hot_rows`` entries of one contest.
    """
    keys = list(keys)
    group = [*keys, "ac_name", "party_short", "party_canonical", "alliance"]
    rows = enriched.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(rows.where(F.col("_n") > F.lit(hot_rows)).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    in_hot = F.lit(True)
    for k in keys:
        in_hot = in_hot & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    bands = in_vote_bands(F.col("best_pct"))
    one, counts = F.lit(1).cast("bigint"), F.array(*[F.col(name) for name, _ in bands])
    cold = enriched.join(hot, in_hot, "left_anti").select(
        *group,
        one.alias("entries"),
        F.when(F.col("is_winner"), one).otherwise(0).alias("won"),
        F.col("total_votes").alias("votes"),
        F.lit(None).cast("bigint").alias("best_votes"),  # an entry's votes
        F.col("vote_percent").alias("best_pct"),
        F.lit(None).cast("array<bigint>").alias("_bands"),  # of its percent
    )
    before = contest_parties(enriched.join(hot, in_hot, "left_semi"), keys)
    before = before.select(*group, "entries", "won", "votes", "best_votes", "best_pct", counts.alias("_bands"))
    return (
        cold.unionByName(before)
        .repartition(buckets, *keys)
        .groupBy(*group)
        .agg(
            F.sum("entries").alias("entries"),
            F.sum("won").alias("won"),
            F.sum("votes").alias("votes"),
            F.max(F.coalesce("best_votes", "votes")).alias("best_votes"),
            F.max("best_pct").alias("best_pct"),
            *[F.sum(F.coalesce(F.get("_bands", F.lit(i)), inside.cast("bigint"))).alias(name) for i, (name, inside) in enumerate(bands)],
        )
    )


def opponents(
    enriched: DataFrame,
    margins: DataFrame,
    party: str,
    keys: Sequence[str] = CONTEST_KEY,
    parties: DataFrame | None = None,
    by_party: DataFrame | None = None,
) -> DataFrame:
    """Relevant, non-independent parties met by ``party`` and how often.

    The counts are national, and so is relevance: a party that won or came
    second in any contest counts wherever it is met.
    ``contests`` counts entry pairs: a contest where the subject has two
    entries and the opponent three adds 6 (the reference's pair count).
    ``parties`` may be a written ``contest_parties`` table of the same entries,
    and ``by_party`` the same rows laid out by party, for the subject's.
    The subject's rows join as they are, not summed by contest first: the sum
    of products is the same, and only they move to the buckets of ``parties``.
    Relevance depends on the party alone, so it is asked of the counts.
    """
    keys = list(keys)
    ps = F.col("party_short")
    relevant = finishers(margins, [])
    met = (ps != party) & (ps != IND_SHORT)
    if parties is None:
        # One read of the entries: counts by contest, party and alliance, and beside them the subject's
        # in the contest (a window over one row for each party of a contest, never over entries).
        per = enriched.groupBy(*keys, "party_short", "alliance").agg(F.count(F.lit(1)).alias("_n"))
        own = F.sum(F.when(ps == party, F.col("_n"))).over(Window.partitionBy(*keys))
        no_key = F.lit(False)
        for k in keys:
            no_key = no_key | F.col(k).isNull()
        pairs = per.where(~no_key).withColumn("_n_subject", own).where(F.col("_n_subject").isNotNull() & met)
    else:
        per = parties.select(*keys, "party_short", "alliance", F.col("entries").alias("_n"))
        own = by_party if by_party is not None else parties
        subject = own.where(ps == party).select(*keys, F.col("entries").alias("_n_subject"))
        pairs = per.where(met).join(subject, keys, "inner")
    return (
        pairs.groupBy("party_short", "alliance")
        .agg(F.sum(F.col("_n") * F.col("_n_subject")).alias("contests"))
        .join(relevant, ["party_short"], "left_semi")
        .orderBy(F.col("contests").desc_nulls_last(), F.col("party_short").asc_nulls_last(), F.col("alliance").asc_nulls_last())
    )


def contest_winner_party(enriched: DataFrame, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """(contest key, actual_winner): the party of the first-placed entry among the winner-flagged ones.

    Only winner-flagged rows take part (about one per contest, a few on ties),
    and a top-1 window picks the first by ballot order, so a tie still gives
    one row per contest.  A contest whose votes are all null has no winner.
    """
    keys = list(keys)
    return (
        enriched.where(F.col("is_winner"))
        .select(*keys, "sn", "candidate", "total_votes", "party_short")
        .withColumn("_rn", F.row_number().over(rank_window(keys)))
        .where(F.col("_rn") == 1)
        .select(*keys, F.col("party_short").alias("actual_winner"))
    )


def head_to_head(
    enriched: DataFrame,
    party1: str,
    party2: str,
    keys: Sequence[str] = CONTEST_KEY,
    parties: DataFrame | None = None,
    winners: DataFrame | None = None,
) -> DataFrame:
    """Every contest where both parties stood: each one's best votes and best vote percent, and the winner.

    Whether a party stood is a matter of the contest, by its key; the figures
    are by key and name, so a contest whose entries spell its name in two
    ways has a row for each, with nulls for a party that is not under it.
    The two parties' rows of ``contest_parties`` (written, in either layout, or computed here
    with the party filter pushed below the aggregate) are collapsed by
    contest and name in one hash aggregate; the sums over a contest's names
    are a window over these few rows (they lie together already).
    ``actual_winner`` comes from ``contest_winner_party`` (or a written
    ``contest_winners`` table of the same entries) by a left join on the
    contest key.  ``party1 == party2`` gives the contests where that party
    stood.
    """
    keys = list(keys)
    ps = F.col("party_short")
    is1, is2 = ps == party1, ps == party2
    contest = Window.partitionBy(*keys)
    g = (
        (parties if parties is not None else contest_parties(enriched, keys))
        .where(ps.isin(party1, party2))
        .groupBy(*keys, "ac_name")
        .agg(
            F.sum(F.when(is1, F.col("entries")).otherwise(F.lit(0))).alias("_n1"),
            F.sum(F.when(is2, F.col("entries")).otherwise(F.lit(0))).alias("_n2"),
            F.max(F.when(is1, F.col("best_votes"))).alias("p1_votes"),
            F.max(F.when(is1, F.col("best_pct"))).alias("p1_pct"),
            F.max(F.when(is2, F.col("best_votes"))).alias("p2_votes"),
            F.max(F.when(is2, F.col("best_pct"))).alias("p2_pct"),
        )
        .withColumns({"_n1": F.sum("_n1").over(contest), "_n2": F.sum("_n2").over(contest)})
        .where((F.col("_n1") > 0) & (F.col("_n2") > 0))
    )
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    g = g.where(~no_key)  # rows without a contest share none
    return (
        g.join(winners if winners is not None else contest_winner_party(enriched, keys), keys, "left")
        .select(*keys, "ac_name", "p1_votes", "p1_pct", "p2_votes", "p2_pct", "actual_winner")
        .orderBy(*[F.col(k).asc_nulls_last() for k in keys], F.col("ac_name").asc_nulls_last())
    )
