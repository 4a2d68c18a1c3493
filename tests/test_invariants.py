"""Invariants over the whole sf0.01 contest view."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from psephos.operators import (
    alliance_summary,
    contest_margins,
    enrich,
    opponents,
    party_profiles,
    party_summary,
)
from psephos.sources.testview import contest_tables
from tests.conftest import ORACLE_SF


@pytest.fixture(scope="module")
def view(spark):
    t = contest_tables(spark, ORACLE_SF)
    return t, enrich(t.candidates, t.party_map)


def test_view_counts(view):
    t, _ = view
    assert t.candidates.count() == 54985
    assert t.totals.count() == 4316


def test_evm_plus_postal_is_total(view):
    t, _ = view
    assert t.candidates.where(F.col("evm_votes") + F.col("postal_votes") != F.col("total_votes")).count() == 0
    assert t.totals.where(F.col("total_evm_votes") + F.col("total_postal_votes") != F.col("total_votes")).count() == 0


def test_vote_shares_sum_to_100_per_state(view):
    t, _ = view
    sums = party_summary(t.candidates).groupBy("state").agg(F.sum("vote_share").alias("s")).collect()
    assert all(math.isclose(r["s"], 100.0, rel_tol=1e-9) for r in sums)


def test_margins_non_negative_and_one_per_contest(view):
    t, ce = view
    m = contest_margins(ce, t.totals)
    assert m.count() == 4316
    assert m.where(F.col("margin_votes") < 0).count() == 0
    assert m.select("state", "ac_no").distinct().count() == 4316
    assert m.where(F.col("runner_candidate").isNull()).count() == 44


def test_seats_at_least_contests(view):
    t, _ = view
    seats = party_summary(t.candidates).agg(F.sum("seats_won")).collect()[0][0]
    ties = t.candidates.groupBy("state", "ac_no").agg(F.count_if("is_winner").alias("w")).where("w > 1").count()
    assert ties == 288
    assert seats >= 4316


def test_finishes_add_up(view):
    _, ce = view
    for r in party_profiles(ce).collect():
        assert r["pos_1"] + r["pos_2"] + r["pos_3"] + r["pos_4"] + r["pos_5_plus"] == r["total_seats_contested"]
    total = party_profiles(ce).agg(F.sum("total_seats_contested")).collect()[0][0]
    assert total == 54985


def test_alliance_labels_unique_by_default(view):
    t, _ = view
    labels = [r["alliance"] for r in alliance_summary(t.candidates, t.party_map, t.totals).collect()]
    assert len(labels) == len(set(labels))


def test_opponent_counts_symmetric(view):
    t, ce = view
    m = contest_margins(ce, t.totals)
    a = {r["party_short"]: r["contests"] for r in opponents(ce, m, "N3").collect()}
    b = {r["party_short"]: r["contests"] for r in opponents(ce, m, "N8").collect()}
    assert a["N8"] == b["N3"]
