"""Finish-position and vote-band profiles of a party, or of every party (O-17, O-17b).

Finish positions are taken over the whole contest before any party filter.
Only places 1-4 need an explicit rank: they come from a top-4 window (a
WindowGroupLimit keeps at most four entries per contest per task before the
shuffle), and "5th or worse" is the party's entries minus its top-4 places.
Both inputs feed one aggregate through a union, so there is no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.columns import rank_window
from psephos.schema import CONTEST_KEY, RANKED_ENTRY_COLUMNS

# Vote-percent bands of the profile (lower bound inclusive, upper exclusive).
VOTE_BANDS = (
    ("vote_gt_50", 50.0, None),
    ("vote_40_50", 40.0, 50.0),
    ("vote_25_40", 25.0, 40.0),
    ("vote_10_25", 10.0, 25.0),
    ("vote_lt_10", None, 10.0),
)
TOP_PLACES = 4

PROFILE_COLUMNS = (
    "pos_1",
    "pos_2",
    "pos_3",
    "pos_4",
    "pos_5_plus",
    *[b[0] for b in VOTE_BANDS],
    "total_seats_contested",
)


def contest_places(enriched: DataFrame, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """Places 1-4 of every contest: the entries' columns and _place, in finish order.

    A top-4 window; Spark keeps at most four rows per contest per task
    before the shuffle (WindowGroupLimit), so a huge contest stays cheap.
    Written, it is what profiles and margins read: four rows a contest at most.
    """
    keys = list(keys)
    return (
        enriched.select(*keys, "ac_name", "sn", *RANKED_ENTRY_COLUMNS)
        .withColumn("_place", F.row_number().over(rank_window(keys)))
        .where(F.col("_place") <= TOP_PLACES)
    )


def in_vote_bands(percent: Column) -> list[tuple[str, Column]]:
    """For each vote band its name, and whether ``percent`` is in it (false if null)."""
    out = []
    for name, lo, hi in VOTE_BANDS:
        at_least = F.lit(True) if lo is None else percent >= F.lit(lo)
        under = F.lit(True) if hi is None else percent < F.lit(hi)
        out.append((name, at_least & under & percent.isNotNull()))
    return out


def vote_band_counts() -> list[Column]:
    """For each vote band the number of entries in it, named like the band."""
    return [F.count_if(inside).alias(name) for name, inside in in_vote_bands(F.col("vote_percent"))]


def _profile_rows(
    enriched: DataFrame, keys: Sequence[str], places: DataFrame | None = None, parties: DataFrame | None = None
) -> DataFrame:
    """Band counts by contest and party (place null), and the top places of every contest (counts 0)."""
    bands = [b[0] for b in VOTE_BANDS]
    if parties is None:
        parties = enriched.groupBy(*keys, "party_short").agg(F.count(F.lit(1)).alias("entries"), *vote_band_counts())
    entries = parties.select("party_short", F.lit(None).cast("int").alias("_place"), "entries", *bands)
    zero = F.lit(0).cast("bigint")
    top = (places if places is not None else contest_places(enriched, keys)).select(
        "party_short", "_place", zero.alias("entries"), *[zero.alias(b) for b in bands]
    )
    return entries.unionByName(top)


def _profile_aggs() -> list:
    place = F.col("_place")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return [
        *[F.count_if(place == i).alias(f"_p{i}") for i in range(1, TOP_PLACES + 1)],
        F.count(place).alias("_top"),
        *[total(b[0]).alias(b[0]) for b in VOTE_BANDS],
        total("entries").alias("total_seats_contested"),
    ]


def _profile_select(group: Sequence[str]) -> list:
    return [
        *group,
        *[F.col(f"_p{i}").alias(f"pos_{i}") for i in range(1, TOP_PLACES + 1)],
        (F.col("total_seats_contested") - F.col("_top")).alias("pos_5_plus"),
        *[b[0] for b in VOTE_BANDS],
        "total_seats_contested",
    ]


def party_profile(
    enriched: DataFrame,
    party: str,
    keys: Sequence[str] = CONTEST_KEY,
    places: DataFrame | None = None,
    parties: DataFrame | None = None,
) -> DataFrame:
    """One row for ``party``: finishes 1, 2, 3, 4, 5+; entries per vote band; entries in all (zeros if absent).

    ``places`` and ``parties`` may be written ``contest_places`` and
    ``contest_parties`` tables of the same entries, which then are not read;
    otherwise places and band counts are made here.
    """
    rows = _profile_rows(enriched, keys, places, parties).where(F.col("party_short") == party)
    return rows.agg(*_profile_aggs()).select(*_profile_select([]))


def party_profiles(
    enriched: DataFrame,
    keys: Sequence[str] = CONTEST_KEY,
    places: DataFrame | None = None,
    parties: DataFrame | None = None,
) -> DataFrame:
    """The profile of every party in one job, one row per party_short."""
    return (
        _profile_rows(enriched, keys, places, parties)
        .groupBy("party_short")
        .agg(*_profile_aggs())
        .select(*_profile_select(["party_short"]))
    )
