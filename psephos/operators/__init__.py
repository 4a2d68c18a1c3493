"""Contest operators: each takes DataFrames and returns a lazy DataFrame."""

from psephos.operators.enrich import enrich, enrich_summary
from psephos.operators.lookup import contest_detail, contest_grams, gram_counts, search_contests
from psephos.operators.margins import close_contests, contest_margins
from psephos.operators.matchups import contest_parties, contest_parties_dealt, contest_winner_party, finishers, head_to_head, opponents, relevant_parties
from psephos.operators.nota import nota_by_contest, nota_summary
from psephos.operators.positions import contest_places, party_profile, party_profiles
from psephos.operators.summary import (
    alliance_summary,
    independents_summary,
    overview_alliances,
    overview_parties,
    party_contest_stats,
    party_performance,
    party_performance_filtered,
    party_summary,
)
from psephos.operators.winners import flag_winners, winner_flag

__all__ = [
    "enrich",
    "enrich_summary",
    "contest_detail",
    "contest_grams",
    "gram_counts",
    "search_contests",
    "close_contests",
    "contest_margins",
    "contest_parties",
    "contest_parties_dealt",
    "contest_winner_party",
    "finishers",
    "head_to_head",
    "opponents",
    "relevant_parties",
    "nota_by_contest",
    "nota_summary",
    "contest_places",
    "party_profile",
    "party_profiles",
    "alliance_summary",
    "independents_summary",
    "overview_alliances",
    "overview_parties",
    "party_contest_stats",
    "party_performance",
    "party_performance_filtered",
    "party_summary",
    "flag_winners",
    "winner_flag",
]
