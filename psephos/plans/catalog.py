"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the whole test tables through the contest view
(``psephos.sources.testview``) and runs one operator, or a dataset built
from several, over all of it.  Dataset queries (party summary, margins,
...) run their operator from the candidates each time.  Route queries
(party performance, overviews, matchups, profiles, search, detail, ad-hoc SQL)
read the named datasets written once per session, as the reference's routes
read the tables it builds at start-up; ``*_from_entries`` queries run the same
operators without those tables.  Parameters (party codes, thresholds, search
text) are the ones the reference's routes take; the values here are chosen
to exist in the view.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.text import sql_is_read_only, strip_code_fences
from psephos.operators import (
    alliance_summary,
    close_contests,
    contest_detail,
    contest_margins,
    enrich,
    enrich_summary,
    flag_winners,
    head_to_head,
    independents_summary,
    nota_by_contest,
    nota_summary,
    opponents,
    overview_alliances,
    overview_parties,
    party_performance,
    party_performance_filtered,
    party_profile,
    party_profiles,
    party_summary,
    relevant_parties,
    search_contests,
)
from psephos.plans.adhoc import adhoc_query
from psephos.plans.datasets import build_datasets
from psephos.plans.service import Service
from psephos.schema import ENTRY_SCHEMA, OTHER_ALLIANCE, TOTALS_SCHEMA
from psephos.sources.files import party_map_from_rows, read_entries, read_totals
from psephos.sources.fs import delete_on_exit
from psephos.sources.store import register_views
from psephos.session import app_id
from psephos.sources.sinks import answer_rows, json_rows, preview
from psephos.sources.testview import VIEW_NOTA_PARTY, contest_tables, local_shared_dir, view_fingerprint

Query = Callable[[SparkSession, str], DataFrame]

# The ad-hoc statement run by the "adhoc_select" query (same text in the oracle).
ADHOC_SQL = """
SELECT pse.alliance,
       COUNT(*) AS party_rows,
       CAST(SUM(pse.seats_won) AS BIGINT) AS seats,
       CAST(SUM(pse.total_votes) AS BIGINT) AS votes,
       CAST(MAX(cm.margin_votes) AS BIGINT) AS widest_margin
FROM party_summary_enriched pse
LEFT JOIN (SELECT state, winner_party_short, MAX(margin_votes) AS margin_votes
           FROM constituency_margins GROUP BY state, winner_party_short) cm
  ON cm.state = pse.state AND cm.winner_party_short = pse.party_short
GROUP BY pse.alliance
"""


# Words put into statements by the "statement_check" query: those of the read-only rule, and harmless ones.
STATEMENT_WORDS = ("Insert", "upDate", "deleted", "drop", "ALTER", "created", "truncate", "value")


class _View:
    """The contest view's derived inputs for one query (lazy DataFrames)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        t = contest_tables(spark, sf_dir)
        self.candidates, self.totals, self.party_map = t.candidates, t.totals, t.party_map

    @property
    def enriched(self) -> DataFrame:
        return enrich(self.candidates, self.party_map)

    @property
    def summary(self) -> DataFrame:
        return party_summary(self.candidates)

    @property
    def summary_enriched(self) -> DataFrame:
        return enrich_summary(self.summary, self.party_map)

    @property
    def margins(self) -> DataFrame:
        return contest_margins(self.enriched, self.totals)

    def alliances(self, split: bool = False) -> DataFrame:
        return alliance_summary(self.candidates, self.party_map, self.totals, split_unmapped=split)


def _q(fn: Callable[[_View], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_View(spark, str(sf_dir)))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, deleted when the application ends."""
    out = f"{local_shared_dir(spark).rstrip('/')}/psephos-scratch/{name}-{uuid.uuid4().hex[:8]}"
    delete_on_exit(spark, out)
    return out


# Named datasets written once per (application, input fingerprint), as the
# reference builds its tables once at start-up and serves its routes from them.
_DATASETS: dict[tuple[str, str], dict[str, DataFrame]] = {}
_SERVICES: dict[tuple[str, str], Service] = {}
_DATASETS_LOCK = threading.Lock()


def served_datasets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The named datasets of the contest view, written to the shared folder on first use."""
    fp = view_fingerprint(spark, sf_dir)
    key = (app_id(spark), fp)
    with _DATASETS_LOCK:  # callers on several threads share one build
        if key not in _DATASETS:
            t = contest_tables(spark, sf_dir)
            out = f"{local_shared_dir(spark).rstrip('/')}/psephos-datasets/{fp}-{uuid.uuid4().hex[:8]}"
            delete_on_exit(spark, out)
            _DATASETS[key] = build_datasets(
                t.candidates,
                t.totals,
                t.party_map,
                out_dir=out,
                nota_party=VIEW_NOTA_PARTY,
                register=False,
                write_base=False,
            )
            _SERVICES[key] = Service(spark, out, _DATASETS[key])
    return _DATASETS[key]


def service(spark: SparkSession, sf_dir: str) -> Service:
    """The routes with kept results over the written datasets."""
    served_datasets(spark, sf_dir)
    return _SERVICES[(app_id(spark), view_fingerprint(spark, sf_dir))]


def _route(fn: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    q = lambda spark, sf_dir: fn(served_datasets(spark, str(sf_dir)))
    q.served = True  # reads the datasets written once per session
    return q


def _opponents(d: dict[str, DataFrame], party: str) -> DataFrame:
    return opponents(
        d["candidates_enriched"], d["constituency_margins"], party,
        parties=d["contest_parties"], by_party=d["contest_parties_by_party"],
    )


def _head_to_head(d: dict[str, DataFrame], p1: str, p2: str) -> DataFrame:
    return head_to_head(
        d["candidates_enriched"], p1, p2, parties=d["contest_parties_by_party"], winners=d["contest_winners"]
    )


def _filtered(d: dict[str, DataFrame], min_seats: int, min_share: float) -> DataFrame:
    return party_performance_filtered(
        d["candidates_enriched"], d["ac_totals"], d["party_summary_enriched"], min_seats, min_share,
        parties=d["contest_parties"],
    )


def _flag_winners(v: _View) -> DataFrame:
    return flag_winners(v.candidates.drop("is_winner"))


def _served(query: Query) -> Query:
    query.served = True
    return query


def is_served(query: Query) -> bool:
    """True for route queries, which read the datasets written once per session."""
    return getattr(query, "served", False) or query is _adhoc


def _adhoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(served_datasets(spark, str(sf_dir)))
    return adhoc_query(spark, ADHOC_SQL)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/conversations.parquet")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts dressed up as statements: by turn they start like a query or not, by length
    they hold one of the words of the read-only rule or none, and fences surround every third."""
    c = _conversations(spark, sf_dir)
    kind = F.pmod(F.length("text") + F.col("turn"), F.lit(24))
    word = F.get(F.array(*[F.lit(w) for w in STATEMENT_WORDS]), F.pmod(kind, F.lit(len(STATEMENT_WORDS))))
    start = F.when(kind % 3 == 0, " Select ").when(kind % 3 == 1, "\n WITH ").otherwise("EXPLAIN ")
    fence = F.when(kind % 4 == 0, "```sql").when(kind % 4 == 1, "```").when(kind % 4 == 2, "```sql```").otherwise("")
    return c.select("conv_id", "turn", F.concat(F.lit(" "), fence, start, word, F.lit(" "), "text", F.when(kind % 4 < 3, "```").otherwise(""), F.lit("\n")).alias("text"))


def _statement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir)
    return s.select("conv_id", "turn", sql_is_read_only(strip_code_fences(F.col("text"))).alias("is_read_only"), strip_code_fences(F.col("text")).alias("sql_text"))


def _json_round_trip(d: dict[str, DataFrame]) -> DataFrame:
    """Margins as JSON rows, with a NaN where the margin is over 50 %, read back into columns."""
    m = d["constituency_margins"].select("state", "ac_no", "winner_candidate", F.when(F.col("margin_percent") > 50, F.lit(float("nan"))).otherwise(F.col("margin_percent")).alias("margin_percent"))
    return json_rows(m).select(F.from_json("json", m.schema).alias("r")).select("r.*")


def _placed(d: dict[str, DataFrame]) -> DataFrame:
    """Margins of every contest among the entries outside the OTHER alliance: its parties never place."""
    return contest_margins(d["candidates_enriched"].where(F.col("alliance") != OTHER_ALLIANCE), d["ac_totals"])


def _two_spellings(v: _View) -> DataFrame:
    """Head to head where every other entry has its contest's name in capitals."""
    name = F.when(F.col("sn") % 2 == 1, F.upper("ac_name")).otherwise(F.col("ac_name"))
    return head_to_head(v.enriched.withColumn("ac_name", name), "N3", "N8")


def _csv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scratch(spark, "entries-csv")
    _View(spark, str(sf_dir)).candidates.select(*ENTRY_SCHEMA.names).write.option("header", True).csv(out)
    return read_entries(spark, out)


def _csv_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _scratch(spark, "totals-csv")
    _View(spark, str(sf_dir)).totals.select(*reversed(TOTALS_SCHEMA.names)).write.option("header", True).csv(out)
    return read_totals(spark, out)


def _inline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary enriched by a map given as rows in the program (the map has a row for each nation)."""
    v = _View(spark, str(sf_dir))
    return enrich_summary(v.summary, party_map_from_rows(spark, [tuple(r) for r in v.party_map.collect()]))


def _widest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = served_datasets(spark, str(sf_dir))["constituency_margins"]
    return m.select("state", "ac_no", "margin_votes").orderBy(F.col("margin_votes").desc(), "state", "ac_no")


def _preview_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a preview of the margins, widest first, passes on, beside the number of all rows."""
    df = _widest(spark, sf_dir)
    total, passed, _ = preview(df, _scratch(spark, "preview"))
    return spark.createDataFrame([(r,) for r in passed], "json string").select(F.from_json("json", df.schema).alias("r"), F.lit(total).alias("total")).select("r.*", "total")


def _answer_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row kept beside an answer's sample, marked with whether the sample holds it."""
    df = _widest(spark, sf_dir)
    answer = answer_rows(df, _scratch(spark, "answer"))
    sample = spark.createDataFrame([(answer.rows,)], "json string").select(F.explode(F.from_json("json", f"array<{df.schema.simpleString()}>")).alias("r"))
    sample = sample.select("r.state", "r.ac_no", F.lit(True).alias("_in"))
    every = answer.every.select(F.from_json("json", df.schema).alias("r")).select("r.*")
    return every.join(F.broadcast(sample), ["state", "ac_no"], "left").select("state", "ac_no", "margin_votes", F.coalesce("_in", F.lit(False)).alias("in_sample"))


def _opponents_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call of a route, which reads what the first one kept."""
    routes = service(spark, str(sf_dir))
    routes.opponents("N3")
    return routes.opponents("N3")


def _search(d: dict[str, DataFrame], q: str) -> DataFrame:
    return search_contests(d["contest_index"], q, grams=d["contest_grams"], counts=d["gram_counts"])


def _sql_text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir)
    return c.select("conv_id", "turn", sql_is_read_only(F.col("text")).alias("is_read_only"))


def _strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir)
    return c.select("conv_id", "turn", strip_code_fences(F.col("text")).alias("sql_text"))


QUERIES: dict[str, Query] = {
    "flag_winners": _q(_flag_winners),
    "party_summary": _q(lambda v: v.summary),
    "candidates_enriched": _q(lambda v: v.enriched),
    "party_summary_enriched": _q(lambda v: v.summary_enriched),
    "alliance_summary": _q(lambda v: v.alliances()),
    "alliance_summary_split": _q(lambda v: v.alliances(split=True)),
    # built like the reference's table, from the totals and the party-summary view
    # over the written party summary, starting from the per-(contest, party) table
    "party_performance": _route(
        lambda d: party_performance(
            d["candidates_enriched"], d["ac_totals"], d["party_summary_enriched"], parties=d["contest_parties"]
        )
    ),
    "contest_margins": _q(lambda v: v.margins),
    "nota_by_contest": _q(lambda v: nota_by_contest(v.candidates, VIEW_NOTA_PARTY)),
    "nota_summary": _q(lambda v: nota_summary(nota_by_contest(v.candidates, VIEW_NOTA_PARTY))),
    "independents_summary": _q(lambda v: independents_summary(v.enriched)),
    "overview_parties": _route(lambda d: overview_parties(d["party_summary_enriched"])),
    "overview_alliances": _route(lambda d: overview_alliances(d["alliance_summary"])),
    "overview_alliances_split": _route(lambda d: overview_alliances(d["alliance_summary_split"])),
    "relevant_parties_few": _route(lambda d: relevant_parties(_placed(d), d["party_summary_enriched"])),
    "opponents_N3_few": _route(
        lambda d: opponents(
            d["candidates_enriched"], _placed(d), "N3", parties=d["contest_parties"], by_party=d["contest_parties_by_party"]
        )
    ),
    "opponents_N3_from_entries": _q(lambda v: opponents(v.enriched, v.margins, "N3")),
    "head_to_head_N3_N8_from_entries": _q(lambda v: head_to_head(v.enriched, "N3", "N8")),
    "party_profiles_from_entries": _q(lambda v: party_profiles(v.enriched)),
    "party_performance_from_entries": _q(lambda v: party_performance(v.enriched, v.totals, v.summary_enriched)),
    "party_performance_filtered_half": _route(lambda d: _filtered(d, 10**9, 4.0)),
    "json_round_trip": _route(_json_round_trip),
    "statement_check": _statement_check,
    "relevant_parties": _route(lambda d: relevant_parties(d["constituency_margins"], d["party_summary_enriched"])),
    "opponents_N3": _route(lambda d: _opponents(d, "N3")),
    "opponents_IND": _route(lambda d: _opponents(d, "IND")),
    "opponents_NOTA": _route(lambda d: _opponents(d, "NOTA")),
    "head_to_head_N3_N8": _route(lambda d: _head_to_head(d, "N3", "N8")),
    "head_to_head_IND_NOTA": _route(lambda d: _head_to_head(d, "IND", "NOTA")),
    "head_to_head_same_party": _route(lambda d: _head_to_head(d, "N3", "N3")),
    "party_performance_filtered_default": _route(lambda d: _filtered(d, 0, 0.0)),
    "party_performance_filtered_3_2": _route(lambda d: _filtered(d, 3, 2.0)),
    "close_contests_10": _route(lambda d: close_contests(d["constituency_margins"], 2.0, 10)),
    "party_profile_N3": _route(
        lambda d: party_profile(d["candidates_enriched"], "N3", places=d["contest_places"], parties=d["contest_parties"])
    ),
    "party_profile_NOTA": _route(
        lambda d: party_profile(d["candidates_enriched"], "NOTA", places=d["contest_places"], parties=d["contest_parties"])
    ),
    "party_profile_missing": _route(
        lambda d: party_profile(d["candidates_enriched"], "NO_SUCH_PARTY", places=d["contest_places"], parties=d["contest_parties"])
    ),
    "party_profiles": _route(lambda d: party_profiles(d["candidates_enriched"], places=d["contest_places"], parties=d["contest_parties"])),
    "contest_search_text": _route(lambda d: _search(d, "er#0000001")),
    "contest_search_number": _route(lambda d: _search(d, "12")),
    "contest_search_wildcard": _route(lambda d: _search(d, " customer#00000_12' ")),
    "contest_detail": _route(lambda d: contest_detail(d["candidates_enriched"], 1)),
    "adhoc_select": _adhoc,
    "head_to_head_two_spellings": _q(_two_spellings),
    "margins_from_places": _route(lambda d: contest_margins(d["candidates_enriched"], d["ac_totals"], places=d["contest_places"])),
    "contest_search_every": _route(lambda d: search_contests(d["contest_index"], "R#0", limit=None, grams=d["contest_grams"], counts=d["gram_counts"])),
    "csv_entries_round_trip": _csv_entries,
    "csv_totals_round_trip": _csv_totals,
    "inline_rows": _inline_rows,
    "preview_margins": _served(_preview_margins),
    "answer_margins": _served(_answer_margins),
    "opponents_N3_kept": _served(_opponents_kept),
    "sql_text_check": _sql_text_check,
    "strip_fences": _strip_fences,
}
