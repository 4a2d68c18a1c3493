"""Per-group aggregates attached to every row, safe when one group is huge.

This is what ``agg(...).over(Window.partitionBy(keys))`` computes, but a
window puts a whole group into one task.  Here the aggregates are one grouped
aggregate (partially aggregated before its shuffle, used for the hot groups
and for the others alike), and the rows are read once more to take them:

* a group with more than ``salt_rows`` rows is hot, whatever its share of all
  rows.  Of N rows at most N / salt_rows groups can be hot, so at the default
  a table of 10**12 rows has at most 250,000 of them; they travel to the rows
  in a broadcast, values included, and their rows join nothing else;
* the other groups are joined on their keys and a spread number.  Rows of cold
  groups carry 0 there and cold groups too; rows of hot groups, and rows whose
  key has a null part, carry a number from 1 on, made of the row, and hot groups
  -1: they meet no group, and the exchange deals them to all tasks.  Both
  numbers depend on data (a constant on one side would be taken out of the
  join's keys by the optimiser, and the exchange would be by the key alone).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_ROWS = 4_000_000  # rows beyond which a group is hot


def attach_group_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """``df`` with the aliased aggregates ``aggs`` over its ``keys`` group appended to every row.

    Rows whose key has a null part find no group and get null aggregates.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_grp_rows"))
    names = [c for c in stats.columns if c not in keys and c != "_grp_rows"]
    is_hot = F.col("_grp_rows") > F.lit(salt_rows)
    # at most (rows of df) / salt_rows groups: see the module's text
    hot = F.broadcast(stats.where(is_hot).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in names], F.lit(True).alias("_hot")))
    no_group = F.lit(False)
    for k in keys:
        no_group = no_group | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30)).cast("int") + F.lit(1)
    rows = df.join(hot, keys, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull() | no_group, spread).otherwise(F.lit(0))
    )
    cold = stats.withColumn("_spread", F.when(is_hot, F.lit(-1)).otherwise(F.lit(0))).drop("_grp_rows")
    return rows.join(cold, [*keys, "_spread"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in names],
    )
