"""Schemas, key columns and fixed labels shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Contest key: one contest is one constituency number within one state.
CONTEST_KEY: tuple[str, ...] = ("state", "ac_no")

# Default scope of party-level summaries (vote shares and seat totals are per state).
PARTY_SCOPE: tuple[str, ...] = ("state",)

# Default scope of the alliance summary (national: no scope columns).
ALLIANCE_SCOPE: tuple[str, ...] = ()

# Fixed values that must equal the reference's for the same results.
NOTA_PARTY = "None of the Above"  # raw party name of the none-of-the-above entry
NOTA_SHORT = "NOTA"  # short code of the none-of-the-above entry
IND_SHORT = "IND"  # short code of independent candidates
OTHER_ALLIANCE = "OTHER"  # alliance label of parties outside the map

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("ac_no", T.LongType()),
        T.StructField("ac_name", T.StringType()),
        T.StructField("sn", T.LongType()),
        T.StructField("candidate", T.StringType()),
        T.StructField("party", T.StringType()),
        T.StructField("evm_votes", T.LongType()),
        T.StructField("postal_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
        T.StructField("vote_percent", T.DoubleType()),
    ]
)

TOTALS_SCHEMA = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("ac_no", T.LongType()),
        T.StructField("ac_name", T.StringType()),
        T.StructField("total_evm_votes", T.LongType()),
        T.StructField("total_postal_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
    ]
)

PARTY_MAP_SCHEMA = T.StructType(
    [
        T.StructField("party_name", T.StringType()),
        T.StructField("canonical_name", T.StringType()),
        T.StructField("short_code", T.StringType()),
        T.StructField("alliance", T.StringType()),
    ]
)

# Columns of one ranked entry, as carried into the winner / runner-up columns.
RANKED_ENTRY_COLUMNS: tuple[str, ...] = (
    "candidate",
    "party_short",
    "party_canonical",
    "alliance",
    "total_votes",
    "vote_percent",
)
