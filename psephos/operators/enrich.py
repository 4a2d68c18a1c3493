"""Party-map enrichment of entries and of party summaries (O-3, O-3b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.schema import OTHER_ALLIANCE


def _map_columns(party_map: DataFrame) -> DataFrame:
    return party_map.select(
        F.col("party_name").alias("_pm_name"),
        F.col("canonical_name").alias("_pm_canonical"),
        F.col("short_code").alias("_pm_short"),
        F.col("alliance").alias("_pm_alliance"),
    )


def enrich(df: DataFrame, party_map: DataFrame, party_col: str = "party") -> DataFrame:
    """Append party_canonical, party_short and alliance from the party map.

    Left join on the raw party name.  A party missing from the map keeps its
    raw name as canonical and short name and goes to the OTHER alliance.
    The map is a small dimension: the planner broadcasts it from its size
    estimate (and AQE from its real size), with a sort-merge join beyond that.
    """
    pm = _map_columns(party_map)
    party = F.col(party_col)
    joined = df.join(pm, party == F.col("_pm_name"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.col("_pm_canonical"), party).alias("party_canonical"),
        F.coalesce(F.col("_pm_short"), party).alias("party_short"),
        F.coalesce(F.col("_pm_alliance"), F.lit(OTHER_ALLIANCE)).alias("alliance"),
    )


def enrich_summary(party_summary: DataFrame, party_map: DataFrame, scope=("state",)) -> DataFrame:
    """Party summary with canonical and short names and alliance, in the reference's column order."""
    e = enrich(party_summary, party_map)
    return e.select(
        *scope, "party", "party_canonical", "party_short", "alliance", "seats_won", "total_votes", "vote_share"
    )
