"""One test per data quirk of the reference (FIXTURES.md section 4)."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from psephos.operators import (
    alliance_summary,
    contest_detail,
    contest_margins,
    enrich,
    enrich_summary,
    head_to_head,
    independents_summary,
    nota_by_contest,
    nota_summary,
    opponents,
    party_contest_stats,
    party_performance,
    party_performance_filtered,
    party_profile,
    party_summary,
    relevant_parties,
    search_contests,
)
from psephos.sources.sinks import answer_rows, json_rows, preview
from tests.helpers import as_dicts, candidates_df, entry, party_map_df, totals_from


def test_tie_for_first(spark):
    rows = [entry("S", 1, 2, "Party Alpha", 100), entry("S", 1, 1, "Party Beta", 100), entry("S", 1, 3, "Party Gamma", 5)]
    c = candidates_df(spark, rows)
    winners = c.where("is_winner").count()
    assert winners == 2
    m = as_dicts(contest_margins(enrich(c, party_map_df(spark)), totals_from(spark, rows)))
    assert len(m) == 1
    assert m[0]["margin_votes"] == 0 and m[0]["margin_percent"] == 0.0
    assert m[0]["winner_party_short"] == "BET"  # lower serial number wins the tie
    assert m[0]["runner_party_short"] == "ALP"
    ps = {r["party"]: r["seats_won"] for r in as_dicts(party_summary(c))}
    assert ps["Party Alpha"] == 1 and ps["Party Beta"] == 1


def test_single_entry(spark):
    rows = [entry("S", 7, 1, "Party Alpha", 42)]
    m = as_dicts(contest_margins(enrich(candidates_df(spark, rows), party_map_df(spark)), totals_from(spark, rows)))
    assert len(m) == 1
    assert m[0]["runner_candidate"] is None and m[0]["runner_votes"] is None
    assert m[0]["margin_votes"] == 42 and m[0]["margin_percent"] == 100.0


def test_null_votes(spark):
    rows = [entry("S", 1, 1, "Party Alpha", None), entry("S", 1, 2, "Party Beta", 10), entry("S", 1, 3, "Party Gamma", 3)]
    c = candidates_df(spark, rows)
    flags = {r["party"]: r["is_winner"] for r in as_dicts(c)}
    assert flags == {"Party Alpha": None, "Party Beta": True, "Party Gamma": False}
    ps = {r["party"]: r["seats_won"] for r in as_dicts(party_summary(c))}
    assert ps["Party Alpha"] == 0
    prof = as_dicts(party_profile(enrich(c, party_map_df(spark)), "ALP"))[0]
    assert prof["pos_3"] == 1  # null votes rank last


def test_missing_totals(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 10), entry("S", 2, 1, "Party Alpha", 20), entry("S", 2, 2, "Party Beta", 5)]
    c = candidates_df(spark, rows)
    totals = totals_from(spark, rows, skip={("S", 2)})
    ce = enrich(c, party_map_df(spark))
    assert [r["ac_no"] for r in as_dicts(contest_margins(ce, totals))] == [1]
    stats = as_dicts(party_contest_stats(ce, totals, ["party_short"]))
    assert {r["party_short"]: r["seats_contested"] for r in stats} == {"ALP": 1}
    assert sorted(r["ac_no"] for r in as_dicts(nota_by_contest(c))) == [1, 2]


def test_zero_votes(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 0), entry("S", 1, 2, "None of the Above", 0)]
    c = candidates_df(spark, rows)
    ce = enrich(c, party_map_df(spark))
    totals = totals_from(spark, rows)
    assert as_dicts(nota_by_contest(c))[0]["nota_percent"] is None
    assert as_dicts(party_summary(c))[0]["vote_share"] is None
    m = as_dicts(contest_margins(ce, totals))[0]
    assert m["margin_percent"] is None
    perf = as_dicts(party_performance(ce, totals, enrich_summary(party_summary(c), party_map_df(spark))))
    assert perf[0]["vote_pct_contested"] is None
    assert as_dicts(independents_summary(ce))[0]["ind_vote_share"] is None


def test_unmapped_and_other(spark):
    rows = [entry("S", 1, 1, "Party Gamma", 10), entry("S", 1, 2, "Unlisted Front", 8), entry("S", 2, 1, "Party Alpha", 4)]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    totals = totals_from(spark, rows)
    merged = as_dicts(alliance_summary(c, pm, totals))
    assert sorted(r["alliance"] for r in merged) == ["NDA", "OTHER"]
    other = [r for r in merged if r["alliance"] == "OTHER"][0]
    assert other["total_votes"] == 18 and other["seats_won"] == 1
    split = as_dicts(alliance_summary(c, pm, totals, split_unmapped=True))
    assert sorted(r["alliance"] for r in split) == ["NDA", "OTHER", "OTHER"]
    assert sorted(r["total_votes"] for r in split if r["alliance"] == "OTHER") == [8, 10]
    assert math.isclose(sum(r["vote_share"] for r in merged), 100.0)
    assert math.isclose(sum(r["seat_share"] for r in merged), 100.0)


def test_unmapped_party_fallback(spark):
    rows = [entry("S", 1, 1, "Unlisted Front", 10)]
    ce = as_dicts(enrich(candidates_df(spark, rows), party_map_df(spark)))[0]
    assert ce["party_short"] == "Unlisted Front" and ce["party_canonical"] == "Unlisted Front"
    assert ce["alliance"] == "OTHER"


def test_null_party_excluded_from_performance(spark):
    rows = [entry("S", 1, 1, None, 10), entry("S", 1, 2, "Party Alpha", 5)]
    c = candidates_df(spark, rows)
    ce = enrich(c, party_map_df(spark))
    perf = as_dicts(party_performance(ce, totals_from(spark, rows), enrich_summary(party_summary(c), party_map_df(spark))))
    assert [r["party_short"] for r in perf] == ["ALP"]


def test_nota_runner_up_is_relevant(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 50), entry("S", 1, 2, "None of the Above", 30), entry("S", 1, 3, "Party Beta", 10)]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    ce = enrich(c, pm)
    m = contest_margins(ce, totals_from(spark, rows))
    assert as_dicts(m)[0]["runner_party_short"] == "NOTA"
    rel = [r["party_short"] for r in as_dicts(relevant_parties(m, enrich_summary(party_summary(c), pm)))]
    assert rel == ["ALP", "NOTA"]
    s = as_dicts(nota_summary(nota_by_contest(c)))[0]
    assert s["total_nota_votes"] == 30 and s["num_acs_over_2pct"] == 1 and s["num_acs_over_5pct"] == 1


def test_many_independents(spark):
    rows = [
        entry("S", 1, 1, "Independent", 40),
        entry("S", 1, 2, "Independent", 30),
        entry("S", 1, 3, "Independent", 5),
        entry("S", 1, 4, "Party Alpha", 20),
        entry("S", 1, 5, "Party Beta", 25),
    ]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    ce = enrich(c, pm)
    totals = totals_from(spark, rows)
    stats = {r["party_short"]: r for r in as_dicts(party_contest_stats(ce, totals, ["party_short"]))}
    assert stats["IND"]["seats_contested"] == 1
    assert stats["IND"]["total_votes_in_those_acs"] == 3 * 120  # contest total once per entry
    prof = as_dicts(party_profile(ce, "IND"))[0]
    assert prof["total_seats_contested"] == 3
    # 40, 30 and 5 votes finish 1st, 2nd and 5th (BET 25 is 3rd, ALP 20 is 4th)
    assert (prof["pos_1"], prof["pos_2"], prof["pos_3"], prof["pos_4"], prof["pos_5_plus"]) == (1, 1, 0, 0, 1)
    assert prof["pos_1"] + prof["pos_2"] + prof["pos_3"] + prof["pos_4"] + prof["pos_5_plus"] == 3
    m = contest_margins(ce, totals)
    # only IND finished in the top two, and IND is never listed as an opponent
    assert as_dicts(opponents(ce, m, "BET")) == []
    assert as_dicts(opponents(ce, m, "ALP")) == []
    ind = as_dicts(independents_summary(ce))[0]
    assert ind["total_ind_votes"] == 75 and ind["seats_won_by_ind"] == 1


def test_opponents_counts_pairs(spark):
    # subject has two entries, the opponent three: 6 pairs in one contest
    rows = [entry("S", 1, i, "Party Alpha", 50 - i) for i in range(1, 3)] + [
        entry("S", 1, 10 + i, "Party Beta", 40 - i) for i in range(1, 4)
    ]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    ce = enrich(c, pm)
    m = contest_margins(ce, totals_from(spark, rows))
    # Beta never finished top two here, so add a second contest where it did
    rows2 = rows + [entry("S", 2, 1, "Party Beta", 9), entry("S", 2, 2, "Party Alpha", 8)]
    c2 = candidates_df(spark, rows2)
    ce2 = enrich(c2, pm)
    m2 = contest_margins(ce2, totals_from(spark, rows2))
    assert as_dicts(opponents(ce, m, "ALP")) == []
    opp = as_dicts(opponents(ce2, m2, "ALP"))
    assert opp == [{"party_short": "BET", "alliance": "MGB", "contests": 7}]


def test_two_states_kept_apart(spark):
    rows = [
        entry("A", 1, 1, "Party Alpha", 10),
        entry("A", 1, 2, "Party Beta", 5),
        entry("B", 1, 1, "Party Alpha", 1),
        entry("B", 1, 2, "Party Beta", 7),
    ]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    ce = enrich(c, pm)
    totals = totals_from(spark, rows)
    winners = {(r["state"], r["ac_no"]): r["winner_party_short"] for r in as_dicts(contest_margins(ce, totals))}
    assert winners == {("A", 1): "ALP", ("B", 1): "BET"}
    shares = {(r["state"], r["party"]): r["vote_share"] for r in as_dicts(party_summary(c))}
    assert math.isclose(shares[("A", "Party Alpha")] + shares[("A", "Party Beta")], 100.0)
    h2h = as_dicts(head_to_head(ce, "ALP", "BET"))
    assert [(r["state"], r["actual_winner"]) for r in h2h] == [("A", "ALP"), ("B", "BET")]
    perf = as_dicts(party_performance(ce, totals, enrich_summary(party_summary(c), pm)))
    assert {(r["state"], r["party_short"]): r["seat_share"] for r in perf} == {
        ("A", "ALP"): 100.0,
        ("A", "BET"): 0.0,
        ("B", "ALP"): 0.0,
        ("B", "BET"): 100.0,
    }
    alliances = as_dicts(alliance_summary(c, pm, totals))
    assert {r["alliance"]: r["seat_share"] for r in alliances} == {"NDA": 50.0, "MGB": 50.0}


def test_dup_names_search(spark):
    rows = [entry("S", 38, 1, "Party Alpha", 5, ac_name="GREENFIELD"), entry("S", 69, 1, "Party Beta", 5, ac_name="GREENFIELD")]
    out = as_dicts(search_contests(candidates_df(spark, rows), "greenf"))
    assert [(r["ac_no"], r["ac_name"]) for r in out] == [(38, "GREENFIELD"), (69, "GREENFIELD")]


def test_bucket_edges(spark):
    pcts = [50.0, 40.0, 25.0, 10.0, 9.99, None]
    rows = [entry("S", i, 1, "Party Alpha", 10, vote_percent=p) for i, p in enumerate(pcts, start=1)]
    prof = as_dicts(party_profile(enrich(candidates_df(spark, rows), party_map_df(spark)), "ALP"))[0]
    assert (prof["vote_gt_50"], prof["vote_40_50"], prof["vote_25_40"], prof["vote_10_25"], prof["vote_lt_10"]) == (1, 1, 1, 1, 1)
    assert prof["total_seats_contested"] == 6 and prof["pos_1"] == 6


def test_search_text_rules(spark):
    rows = [
        entry("S", 12, 1, "Party Alpha", 5, ac_name="NORTH 100%"),
        entry("S", 120, 1, "Party Alpha", 5, ac_name="SOUTH_EAST"),
        entry("S", 3, 1, "Party Alpha", 5, ac_name="WEST\\END"),
        entry("S", 4, 1, "Party Alpha", 5, ac_name="O'BRIEN"),
    ]
    c = candidates_df(spark, rows)

    def hits(q):
        return sorted(r["ac_no"] for r in as_dicts(search_contests(c, q)))

    assert hits("") == [] and hits("   ") == [] and hits("'") == []
    assert hits("%") == [3, 4, 12, 120]  # wildcard, as in the reference
    assert hits("_") == [3, 4, 12, 120]
    assert hits("\\") == [3]  # a backslash is literal
    assert hits("12") == [12]  # exact number or name part
    assert hits("012") == []
    assert hits("h_e") == [120]
    # quotes are removed from q (not from names), as the reference does
    assert hits("O'BRIEN") == []
    assert hits("'brien") == [4]


def test_contest_detail_order_and_state(spark):
    rows = [entry("A", 5, 1, "Party Alpha", 3), entry("A", 5, 2, "Party Beta", 9), entry("B", 5, 1, "Party Beta", 1)]
    ce = enrich(candidates_df(spark, rows), party_map_df(spark))
    assert [(r["state"], r["total_votes"]) for r in as_dicts(contest_detail(ce, 5))] == [("A", 9), ("A", 3), ("B", 1)]
    assert [r["total_votes"] for r in as_dicts(contest_detail(ce, 5, state="A"))] == [9, 3]


def test_filtered_performance_or_rule(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 90), entry("S", 1, 2, "Party Beta", 9), entry("S", 1, 3, "Party Gamma", 1)]
    c = candidates_df(spark, rows)
    pm = party_map_df(spark)
    ce = enrich(c, pm)
    pse = enrich_summary(party_summary(c), pm)
    totals = totals_from(spark, rows)
    assert len(as_dicts(party_performance_filtered(ce, totals, pse))) == 3
    kept = [r["party_short"] for r in as_dicts(party_performance_filtered(ce, totals, pse, 1, 5.0))]
    assert kept == ["ALP", "BET"]  # ALP by seats, BET by share; ordered by share


def test_missing_party_profile_is_zero(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 5)]
    prof = as_dicts(party_profile(enrich(candidates_df(spark, rows), party_map_df(spark)), "NOPE"))
    assert len(prof) == 1 and all(v == 0 for v in prof[0].values())


def test_json_nulls(spark):
    df = spark.createDataFrame([("x", 1.5), (None, float("nan")), ("y", None)], "s string, d double")
    rows = [json.loads(r["json"]) for r in json_rows(df).collect()]
    assert rows == [{"s": "x", "d": 1.5}, {"s": None, "d": None}, {"s": "y", "d": None}]


def test_preview_rule(spark, tmp_out):
    small = spark.range(25).withColumnRenamed("id", "n")
    n, rows, every = preview(small, f"{tmp_out}/a")
    assert n == 25 and len(rows) == every.count() == 25
    big = spark.range(26).withColumnRenamed("id", "n")
    n, rows, every = preview(big.orderBy(F.col("n").desc()), f"{tmp_out}/b")
    assert n == 26 and [json.loads(r)["n"] for r in rows] == [25, 24, 23, 22, 21]
    assert [json.loads(r["json"])["n"] for r in every.collect()] == list(range(25, -1, -1))
    answer = answer_rows(spark.range(500).orderBy("id"), f"{tmp_out}/c")
    assert [r["id"] for r in json.loads(answer.rows)] == list(range(120)) and answer.total == 500
    assert [json.loads(r["json"])["id"] for r in answer.every.collect()] == list(range(500))


def test_preview_runs_the_query_once(spark, tmp_out):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(n):
        runs.add(1)
        return n

    n, rows, every = preview(spark.range(300).select(seen("id").alias("n")), f"{tmp_out}/a")
    assert (n, len(rows), every.count()) == (300, 5, 300) and runs.value == 300
    answer = answer_rows(spark.range(300).select(seen("id").alias("n")), f"{tmp_out}/b")
    assert answer.total == answer.every.count() == 300 and runs.value == 600
    n, rows, _ = preview(spark.range(0), f"{tmp_out}/c")
    assert (n, rows) == (0, [])


def test_head_to_head_same_party(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 5), entry("S", 1, 2, "Party Alpha", 7), entry("S", 1, 3, "Party Beta", 6)]
    ce = enrich(candidates_df(spark, rows), party_map_df(spark))
    out = as_dicts(head_to_head(ce, "ALP", "ALP"))
    assert len(out) == 1 and out[0]["p1_votes"] == 7 and out[0]["p2_votes"] == 7 and out[0]["actual_winner"] == "ALP"
    assert as_dicts(head_to_head(ce, "ALP", "GAM")) == []


def test_vote_share_is_double_not_decimal(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 300), entry("S", 1, 2, "Party Beta", 400)]
    ps = party_summary(candidates_df(spark, rows))
    assert dict(ps.dtypes)["vote_share"] == "double"
    share = {r["party"]: r["vote_share"] for r in as_dicts(ps)}
    assert share["Party Alpha"] == 300 * 100.0 / 700


def test_party_scope_override(spark):
    rows = [entry("A", 1, 1, "Party Alpha", 30), entry("B", 1, 1, "Party Beta", 70)]
    national = {r["party"]: r["vote_share"] for r in as_dicts(party_summary(candidates_df(spark, rows), scope=[]))}
    assert national == {"Party Alpha": 30.0, "Party Beta": 70.0}
    per_state = {r["party"]: r["vote_share"] for r in as_dicts(party_summary(candidates_df(spark, rows)))}
    assert per_state == {"Party Alpha": 100.0, "Party Beta": 100.0}


def test_empty_input_global_aggregates(spark):
    rows = [entry("S", 1, 1, "Party Alpha", 5)]
    c = candidates_df(spark, rows).where(F.lit(False))
    s = as_dicts(nota_summary(nota_by_contest(c)))[0]
    assert s["num_acs_over_2pct"] == 0 and s["total_votes"] is None


def test_repeated_totals_rows_are_one_contest(spark):
    """Two totals rows for a contest (its name spelt in two ways): one contest contested, votes and wins per row."""
    rows = [entry("S", 1, 1, "Party Alpha", 60), entry("S", 1, 2, "Party Beta", 50), entry("S", 2, 1, "Party Beta", 40)]
    totals = totals_from(spark, rows)
    again = totals.unionByName(totals.where("ac_no = 1").withColumn("ac_name", F.lit("other spelling")))
    ce = enrich(candidates_df(spark, rows), party_map_df(spark))
    pse = enrich_summary(party_summary(candidates_df(spark, rows)), party_map_df(spark))
    perf = {r["party_short"]: r for r in as_dicts(party_performance(ce, again, pse))}
    assert perf["ALP"]["seats_contested"] == 1 and perf["ALP"]["seats_won"] == 2
    assert perf["ALP"]["strike_rate"] == 200.0 and perf["ALP"]["avg_votes_per_seat"] == 120.0
    assert perf["BET"]["seats_contested"] == 2 and perf["BET"]["seats_won"] == 1
    assert perf["BET"]["avg_votes_per_seat"] == (50 * 2 + 40) / 2
    assert perf["BET"]["vote_pct_contested"] == 140 * 100.0 / (110 * 2 + 40)
    short = {r["party_short"]: r for r in as_dicts(party_performance_filtered(ce, again, pse))}
    assert short["BET"]["seats_contested"] == 2 and short["ALP"]["strike_rate"] == 200.0


def test_opponents_are_relevant_nationally(spark):
    """Gamma wins in T only, and meets Alpha in S, where it comes third."""
    rows = [
        entry("S", 1, 1, "Party Alpha", 60), entry("S", 1, 2, "Party Beta", 50), entry("S", 1, 3, "Party Gamma", 10),
        entry("T", 1, 1, "Party Gamma", 9),
    ]
    ce = enrich(candidates_df(spark, rows), party_map_df(spark))
    m = contest_margins(ce, totals_from(spark, rows))
    assert {r["party_short"]: r["contests"] for r in as_dicts(opponents(ce, m, "ALP"))} == {"BET": 1, "GAM": 1}
