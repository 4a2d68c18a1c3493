"""Small builders for inline test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from psephos.operators import flag_winners
from psephos.schema import ENTRY_SCHEMA, PARTY_MAP_SCHEMA, TOTALS_SCHEMA

# Fixed party map of the unit tests (a few rows shaped like the reference's map).
PARTY_ROWS = [
    ("Party Alpha", "Alpha Party", "ALP", "NDA"),
    ("Party Beta", "Beta Party", "BET", "MGB"),
    ("Party Gamma", "Gamma Party", "GAM", "OTHER"),
    ("Independent", "Independent", "IND", "IND"),
    ("None of the Above", "None of the Above", "NOTA", "NOTA"),
]


def entry(state, ac_no, sn, party, votes, ac_name=None, candidate=None, vote_percent=None, postal=0):
    """One entry row; evm = votes - postal."""
    evm = None if votes is None else votes - postal
    return (
        state,
        ac_no,
        ac_name or f"AC {ac_no}",
        sn,
        candidate or f"cand-{state}-{ac_no}-{sn}",
        party,
        evm,
        postal if votes is not None else None,
        votes,
        vote_percent,
    )


def entries_df(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def candidates_df(spark: SparkSession, rows) -> DataFrame:
    return flag_winners(entries_df(spark, rows))


def party_map_df(spark: SparkSession, rows=PARTY_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, PARTY_MAP_SCHEMA)


def totals_from(spark: SparkSession, rows, skip=()) -> DataFrame:
    """Contest totals as the sum of the entries, leaving out contests in ``skip``."""
    acc: dict = {}
    for r in rows:
        key = (r[0], r[1])
        if key in skip:
            continue
        t = acc.setdefault(key, [r[2], 0, 0, 0])
        t[1] += r[6] or 0
        t[2] += r[7] or 0
        t[3] += r[8] or 0
    out = [(k[0], k[1], v[0], v[1], v[2], v[3]) for k, v in acc.items()]
    return spark.createDataFrame(out, TOTALS_SCHEMA)


def as_dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
