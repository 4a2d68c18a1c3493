"""None-of-the-above tallies per contest and overall (O-7, O-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.functions.columns import pct
from psephos.schema import CONTEST_KEY, NOTA_PARTY


def nota_by_contest(candidates: DataFrame, nota_party: str = NOTA_PARTY, keys: Sequence[str] = CONTEST_KEY) -> DataFrame:
    """Per contest: NOTA votes, all votes cast for entries, and NOTA's percentage of them.

    NOTA is recognised by its raw party name.  Every contest with entries is
    kept, whether or not it has a totals row.
    """
    is_nota = F.col("party") == nota_party
    g = candidates.groupBy(*keys, "ac_name").agg(
        F.sum(F.when(is_nota, F.col("total_votes")).otherwise(F.lit(0))).alias("nota_votes"),
        F.sum("total_votes").alias("ac_total_votes"),
    )
    return g.withColumn("nota_percent", pct("nota_votes", "ac_total_votes"))


def threshold_column(t: float) -> str:
    return f"num_acs_over_{t:g}pct"


def nota_summary(nota_by_contest_df: DataFrame, thresholds: Sequence[float] = (2.0, 5.0)) -> DataFrame:
    """One row: total NOTA votes, all votes, NOTA share, and contests with NOTA above each threshold (strict)."""
    g = nota_by_contest_df.agg(
        F.sum("nota_votes").alias("total_nota_votes"),
        F.sum("ac_total_votes").alias("total_votes"),
        *[F.count_if(F.col("nota_percent") > F.lit(float(t))).alias(threshold_column(t)) for t in thresholds],
    )
    return g.select(
        "total_nota_votes",
        "total_votes",
        pct("total_nota_votes", "total_votes").alias("nota_vote_share"),
        *[threshold_column(t) for t in thresholds],
    )
