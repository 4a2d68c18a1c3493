"""Build every named dataset in dependency order and name them (O-20).

entries -> candidates (+is_winner) -> party_summary -> party_summary_enriched
party_map -> candidates_enriched -> party_performance, constituency_margins,
independents_summary; alliance_summary; nota_by_ac -> nota_summary; and
contest_index (distinct contest numbers and names, which search scans) and
contest_places (places 1-4 of every contest, which the profiles read) and
contest_parties (one row per contest and party, which the matchups read)
and contest_winners (the winner's party per contest, for head to head).

contest_parties_by_party holds the rows of contest_parties in files by ranges
of the party, for reads of one or two parties; contest_grams and gram_counts
hold the names' trigrams, for search.

With ``out_dir`` the reference's tables are written as Parquet there (its
CREATE TABLE AS) as one snapshot (``psephos.sources.snapshots``): all of them
are published together at the end, so a build that dies leaves the version
before it in place.  Tables of one row or a few for each contest are written in
buckets by its key.  Later queries reuse them and a lost executor re-reads
files instead of re-running the joins; views stay lazy over those tables.
``out_dir`` must be a folder every executor can reach (see
``psephos.session.shared_dir``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from psephos.operators import (
    alliance_summary,
    contest_grams,
    contest_margins,
    contest_parties,
    contest_parties_dealt,
    contest_places,
    contest_winner_party,
    enrich,
    enrich_summary,
    flag_winners,
    gram_counts,
    independents_summary,
    nota_by_contest,
    nota_summary,
    party_performance,
    party_summary,
)
from psephos.schema import ALLIANCE_SCOPE, CONTEST_KEY, NOTA_PARTY, PARTY_SCOPE
from psephos.sources.snapshots import SnapshotStore
from psephos.sources.store import register_views, shuffles_freed

DATASET_NAMES = (
    "candidates",
    "ac_totals",
    "party_map",
    "party_summary",
    "candidates_enriched",
    "party_summary_enriched",
    "alliance_summary",
    "alliance_summary_split",
    "party_performance",
    "constituency_margins",
    "nota_by_ac",
    "nota_summary",
    "independents_summary",
    "contest_index",
    "contest_places",
    "contest_parties",
    "contest_winners",
    "contest_parties_by_party",
    "contest_grams",
    "gram_counts",
)

# Tables of one row, or few, for each contest: in buckets by its key.
BUCKETED = ("ac_totals", "contest_places", "contest_parties", "contest_winners")

# Contests of a bucket, at most on average; every core gets one at least.  A bucket is one task's, which keeps
# a group for each party of each of its contests in memory, so this bounds that memory whatever the input.
BUCKET_CONTESTS = 25_000


def bucket_count(contests: int, cores: int) -> int:
    """Buckets of the tables by contest: one for each core, and as many as keep ``BUCKET_CONTESTS``."""
    return max(cores, contests // BUCKET_CONTESTS + 1)


def build_datasets(
    candidates: DataFrame,
    totals: DataFrame,
    party_map: DataFrame,
    out_dir: str | None = None,
    nota_party: str = NOTA_PARTY,
    party_scope: Sequence[str] = PARTY_SCOPE,
    alliance_scope: Sequence[str] = ALLIANCE_SCOPE,
    keys: Sequence[str] = CONTEST_KEY,
    register: bool = True,
    write_base: bool = True,
    parallel_writes: int = 4,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """All named datasets as DataFrames (written and published under ``out_dir`` when given), registered as views.

    ``write_base=False`` leaves candidates and party map as given (for inputs
    that are already files), writing only the totals (in buckets) and the derived
    tables.  With ``out_dir``, up to ``parallel_writes`` derived tables are
    written at the same time (concurrent jobs from driver threads).
    ``buckets`` defaults to one for each core, and more beyond ``BUCKET_CONTESTS`` contests each.
    """
    keys = list(keys)
    build = SnapshotStore(candidates.sparkSession, out_dir).begin() if out_dir else None
    if build and buckets is None:
        with shuffles_freed(candidates.sparkSession):
            buckets = bucket_count(totals.count(), candidates.sparkSession.sparkContext.defaultParallelism)

    def table(name: str, df: DataFrame) -> DataFrame:
        if not build:
            return df
        if name in BUCKETED:
            return build.write(name, df, bucket_by=keys, buckets=buckets, dealt=name == "contest_parties")
        cluster_by = [k for k in keys if k in df.columns]
        # contest detail looks contests up by number: the candidates lie in files by ranges of it
        range_by = {
            "candidates": [*reversed(keys), "sn"],
            "contest_parties_by_party": ["party_short", *keys],
            "contest_grams": ["gram", *keys],
        }.get(name)
        return build.write(name, df, cluster_by=range_by or cluster_by or None, range_by=range_by)

    def tables(make: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Independent tables: submitted as concurrent jobs (each is small next to the cluster or the cores)."""
        if build and parallel_writes > 1:
            with ThreadPoolExecutor(max_workers=parallel_writes) as pool:
                futures = {name: pool.submit(table, name, one()) for name, one in make.items()}
                return {name: f.result() for name, f in futures.items()}
        return {name: table(name, one()) for name, one in make.items()}

    if "is_winner" not in candidates.columns:
        candidates = flag_winners(candidates, keys)
    if write_base:
        candidates = table("candidates", candidates)
        party_map = table("party_map", party_map)
    totals = table("ac_totals", totals)
    ce = enrich(candidates, party_map)
    # Read by the other tables, so written first.
    first = tables(
        {
            "party_summary": lambda: party_summary(candidates, party_scope),
            # places 1-4 of every contest: what the profiles and the margins read
            "contest_places": lambda: contest_places(ce, keys),
            # distinct (contest, name) pairs: what contest search scans instead of every entry
            "contest_index": lambda: candidates.select(*keys, "ac_name").distinct(),
        }
    )
    # One row per (contest, party): what opponents, head to head and performance read.  Tables with large
    # exchanges are written one after the other, so their shuffle files never lie side by side.
    first |= tables({"contest_parties": lambda: contest_parties_dealt(ce, buckets, keys) if build else contest_parties(ce, keys)})
    pse = enrich_summary(first["party_summary"], party_map, party_scope)
    written = first if build else {}
    parties, places = written.get("contest_parties"), written.get("contest_places")
    second = tables(
        {
            "alliance_summary": lambda: alliance_summary(candidates, party_map, totals, alliance_scope, keys=keys),
            # the map's own groups: parties outside the map are an OTHER row of their own
            "alliance_summary_split": lambda: alliance_summary(
                candidates, party_map, totals, alliance_scope, split_unmapped=True, keys=keys
            ),
            "party_performance": lambda: party_performance(ce, totals, pse, party_scope, keys, parties=parties),
            "constituency_margins": lambda: contest_margins(ce, totals, keys, places=places),
            # the first-placed winner's party of every contest: what head to head joins
            "contest_winners": lambda: contest_winner_party(ce, keys),
            # the rows of contest_parties by party
            "contest_parties_by_party": lambda: first["contest_parties"],
        }
    )
    second |= tables({"contest_grams": lambda: contest_grams(first["contest_index"], keys)})
    second["gram_counts"] = table("gram_counts", gram_counts(second["contest_grams"]))
    nba = nota_by_contest(candidates, nota_party, keys)
    datasets = {
        "candidates": candidates,
        "ac_totals": totals,
        "party_map": party_map,
        "candidates_enriched": ce,
        "party_summary_enriched": pse,
        "nota_by_ac": nba,
        "nota_summary": nota_summary(nba),
        "independents_summary": independents_summary(ce),
        **first,
        **second,
    }
    if build:
        build.publish()
    if register:
        register_views(datasets)
    return datasets


def load_datasets(
    spark,
    tables_dir: str,
    nota_party: str = NOTA_PARTY,
    party_scope: Sequence[str] = PARTY_SCOPE,
    keys: Sequence[str] = CONTEST_KEY,
    register: bool = True,
    version: str | None = None,
) -> dict[str, DataFrame]:
    """Datasets of one published version (by default the newest) of ``build_datasets(out_dir=tables_dir)``, with the views over them."""
    d = SnapshotStore(spark, tables_dir).load(version)
    d["candidates_enriched"] = enrich(d["candidates"], d["party_map"])
    d["party_summary_enriched"] = enrich_summary(d["party_summary"], d["party_map"], party_scope)
    d["nota_by_ac"] = nota_by_contest(d["candidates"], nota_party, keys)
    d["nota_summary"] = nota_summary(d["nota_by_ac"])
    d["independents_summary"] = independents_summary(d["candidates_enriched"])
    if register:
        register_views(d)
    return d
