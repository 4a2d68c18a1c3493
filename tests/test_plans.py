"""Plan shape: the physical plans are the ones meant for large data."""

from __future__ import annotations

import pytest

from psephos.operators import contest_margins, enrich, head_to_head, opponents, party_profile
from psephos.plans.catalog import QUERIES
from psephos.sources.testview import contest_tables
from tests.conftest import SMOKE


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def view(spark):
    return contest_tables(spark, SMOKE)


def test_margins_use_group_limit_and_no_self_join(spark, view):
    m = contest_margins(enrich(view.candidates, view.party_map), view.totals)
    p = plan_text(m)
    assert "WindowGroupLimit" in p and "Partial" in p
    # one SortMergeJoin at most: top-two rows to the contest totals, never ranked rows to ranked rows
    assert p.count("SortMergeJoin") <= 1
    assert p.count("Window [") <= 2


def test_party_map_join_is_broadcast(spark, view):
    p = plan_text(enrich(view.candidates, view.party_map))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan_text(QUERIES[name](spark, SMOKE))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    p = plan_text(QUERIES[name](spark, SMOKE))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_head_to_head_hash_aggregates_only(spark, view):
    p = plan_text(head_to_head(enrich(view.candidates, view.party_map), "N3", "N8"))
    assert "SortAggregate" not in p and "ObjectHashAggregate" not in p
    assert "WindowGroupLimit" in p  # winner: top-1 over winner-flagged rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_sort_aggregate(spark, name):
    p = plan_text(QUERIES[name](spark, SMOKE))
    assert "SortAggregate" not in p


def test_opponents_joins_aggregated_sides(spark, view):
    ce = enrich(view.candidates, view.party_map)
    m = contest_margins(ce, view.totals)
    q = opponents(ce, m, "N3")
    p = plan_text(q)
    assert "CartesianProduct" not in p


def test_profile_filters_after_ranking(spark, view):
    q = party_profile(enrich(view.candidates, view.party_map), "N3")
    optimized = q._jdf.queryExecution().optimizedPlan().toString()
    # the party filter sits above the window (positions are taken over the whole contest)
    window_at = optimized.find("Window [row_number()")
    filter_at = optimized.find("(party_short")
    assert window_at > 0 and 0 <= filter_at < window_at


def test_detail_filter_pushed_to_scan(spark, view):
    from psephos.operators import contest_detail

    p = plan_text(contest_detail(enrich(view.candidates, view.party_map), 1))
    assert "PushedFilters: [IsNotNull(ac_no), EqualTo(ac_no,1)]" in p


def scans(df) -> int:
    """Scans of the candidates in the plan: only they have a winner flag."""
    return plan_text(df).count("is_winner:boolean")


def test_summaries_read_the_candidates_once(spark, view):
    from psephos.operators import alliance_summary, party_summary

    assert scans(party_summary(view.candidates)) == 1
    for split in (False, True):
        a = alliance_summary(view.candidates, view.party_map, view.totals, split_unmapped=split)
        assert scans(a) == 1


def test_winner_flag_reads_the_candidates_twice(spark, view):
    """Once for the rows and once for the groups: hot and cold groups share one aggregate."""
    from psephos.operators import flag_winners

    df = flag_winners(view.candidates.drop("is_winner"))
    rows = df.collect()
    p = plan_text(df)
    final = p[p.find("== Final Plan ==") : p.find("== Initial Plan ==")] or p
    assert rows and final.count("FileScan parquet") <= 2 and "ReusedExchange" in final
