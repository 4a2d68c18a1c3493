"""Command line: build the datasets from CSV files, run a route, or run read-only SQL.

    python -m psephos build --entries E.csv --totals T.csv [--party-map P.csv] --out DIR
    python -m psephos route opponents --party JDU (--tables DIR | --entries E.csv --totals T.csv) [--out DIR]
    python -m psephos sql "SELECT ..." (--tables DIR | --entries E.csv --totals T.csv)

Without ``--party-map`` the reference's map is used.  Routes print every row
(JSON, one per line, streamed a partition at a time); ``--show N`` prints N and
fails, naming the total, if there are more; the dashboard's five routes keep their results beside
``--tables``, until a newer build; ``--out`` writes the whole result
as JSON text files from the executors instead of through the driver.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from psephos.operators import (
    close_contests,
    contest_detail,
    head_to_head,
    opponents,
    overview_alliances,
    overview_parties,
    party_performance_filtered,
    party_profile,
    relevant_parties,
    search_contests,
)
from psephos.plans.adhoc import adhoc_query
from psephos.plans.datasets import build_datasets, load_datasets
from psephos.plans.service import Service
from psephos.session import build_session
from psephos.sources import default_party_map, json_rows, read_entries, read_party_map, read_totals

# The reference's routes, by name, over the named datasets.
ROUTES = {
    "relevant-parties": lambda d, a: relevant_parties(d["constituency_margins"], d["party_summary_enriched"]),
    "opponents": lambda d, a: opponents(
        d["candidates_enriched"], d["constituency_margins"], a.party,
        parties=d["contest_parties"], by_party=d["contest_parties_by_party"],
    ),
    "head-to-head": lambda d, a: head_to_head(
        d["candidates_enriched"], a.party1, a.party2, parties=d["contest_parties_by_party"], winners=d["contest_winners"]
    ),
    "overview-parties": lambda d, a: overview_parties(d["party_summary_enriched"]),
    "overview-alliances": lambda d, a: overview_alliances(
        d["alliance_summary_split" if a.split_alliances else "alliance_summary"]
    ),
    "party-performance": lambda d, a: party_performance_filtered(
        d["candidates_enriched"],
        d["ac_totals"],
        d["party_summary_enriched"],
        a.min_seats_won,
        a.min_vote_share,
        parties=d["contest_parties"],
    ),
    "nota": lambda d, a: d["nota_summary"],
    "nail-biters": lambda d, a: close_contests(d["constituency_margins"], 2.0, a.limit),
    "party-analytics": lambda d, a: party_profile(d["candidates_enriched"], a.party_short, places=d["contest_places"], parties=d["contest_parties"]),
    "search": lambda d, a: search_contests(d["contest_index"], a.q, a.limit, grams=d["contest_grams"], counts=d["gram_counts"]),
    "detail": lambda d, a: contest_detail(d["candidates_enriched"], a.ac_no, a.state),
}

# Routes whose results are kept beside the written tables, by version and parameters.
KEPT_ROUTES = {
    "relevant-parties": lambda s, a: s.relevant_parties(),
    "opponents": lambda s, a: s.opponents(a.party),
    "head-to-head": lambda s, a: s.head_to_head(a.party1, a.party2),
    "overview-parties": lambda s, a: s.overview_parties(),
    "overview-alliances": lambda s, a: s.overview_alliances(a.split_alliances),
}

# Parameters without which a route has nothing to answer.
REQUIRED = {
    "opponents": ("party",),
    "head-to-head": ("party1", "party2"),
    "party-analytics": ("party_short",),
    "search": ("q",),
    "detail": ("ac_no",),
}


def _inputs(p: argparse.ArgumentParser) -> None:
    p.add_argument("--entries", help="entries CSV/Parquet (one row per candidate)")
    p.add_argument("--totals", help="contest totals CSV/Parquet")
    p.add_argument("--party-map", help="party map CSV/Parquet (default: the reference's map)")
    p.add_argument("--tables", help="folder written by 'build' (instead of --entries/--totals)")
    p.add_argument("--master", help="Spark master for local runs, e.g. local[8]")


def _datasets(spark, a) -> dict[str, DataFrame]:
    if a.tables:
        return load_datasets(spark, a.tables)
    if not (a.entries and a.totals):
        raise SystemExit("give --tables, or --entries and --totals")
    pm = read_party_map(spark, a.party_map) if a.party_map else default_party_map(spark)
    return build_datasets(read_entries(spark, a.entries), read_totals(spark, a.totals), pm)


def _emit(df: DataFrame, a) -> None:
    rows = json_rows(df)
    if a.out:
        rows.write.mode("overwrite").text(a.out)
        print(json.dumps({"written": a.out}))
        return
    if a.show is None:
        for r in rows.toLocalIterator():
            print(r[0])
        return
    first = rows.limit(a.show + 1).collect()
    for r in first[: a.show]:
        print(r[0])
    if len(first) > a.show:
        raise SystemExit(f"{a.show} of {df.count()} rows shown; leave out --show, or write all of them with --out")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="psephos")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="write every named dataset")
    _inputs(b)
    b.add_argument("--out", required=True)
    r = sub.add_parser("route", help="run one of the reference's routes")
    r.add_argument("name", choices=sorted(ROUTES))
    _inputs(r)
    r.add_argument("--party")
    r.add_argument("--party1")
    r.add_argument("--party2")
    r.add_argument("--party-short")
    r.add_argument("--min-seats-won", type=int, default=0)
    r.add_argument("--min-vote-share", type=float, default=0.0)
    r.add_argument("--limit", type=int, default=10)
    r.add_argument("--q")
    r.add_argument("--split-alliances", action="store_true", help="parties outside the map as an OTHER row of their own")
    r.add_argument("--ac-no", type=int)
    r.add_argument("--state")
    r.add_argument("--out")
    r.add_argument("--show", type=int)
    q = sub.add_parser("sql", help="run one read-only query over the named datasets")
    q.add_argument("statement")
    _inputs(q)
    q.add_argument("--out")
    q.add_argument("--show", type=int)
    a = ap.parse_args(argv)
    if a.cmd == "route":
        missing = [p for p in REQUIRED.get(a.name, ()) if getattr(a, p) is None]
        if missing:
            ap.error(f"{a.name} needs " + ", ".join("--" + p.replace("_", "-") for p in missing))

    spark = build_session(a.master, None, app_name="psephos-cli")
    if a.cmd == "build":
        if a.tables:
            raise SystemExit("build reads --entries/--totals")
        pm = read_party_map(spark, a.party_map) if a.party_map else default_party_map(spark)
        build_datasets(read_entries(spark, a.entries), read_totals(spark, a.totals), pm, out_dir=a.out, register=False)
        print(json.dumps({"tables": a.out}))
    elif a.cmd == "route":
        if a.tables and a.name in KEPT_ROUTES:
            _emit(KEPT_ROUTES[a.name](Service(spark, a.tables), a), a)
        else:
            _emit(ROUTES[a.name](_datasets(spark, a), a), a)
    else:
        _datasets(spark, a)
        _emit(adhoc_query(spark, a.statement), a)


if __name__ == "__main__":
    main(sys.argv[1:])
