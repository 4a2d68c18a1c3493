"""The five routes the reference answers from memory, over the current snapshot, with kept results."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from psephos.operators import head_to_head, opponents, overview_alliances, overview_parties, relevant_parties
from psephos.plans.datasets import load_datasets
from psephos.plans.kept import KeptResults
from psephos.sources.snapshots import SnapshotStore


class Service:
    """Routes over the datasets written under ``tables_dir``; ``refresh`` moves on to a newer version.

    ``datasets`` are those of the current version, where the caller has them at hand.
    """

    def __init__(self, spark: SparkSession, tables_dir: str, datasets: dict[str, DataFrame] | None = None):
        self.spark, self.tables_dir = spark, tables_dir
        self._lock = threading.Lock()
        self.version: str | None = None
        self.refresh(datasets)

    def refresh(self, datasets: dict[str, DataFrame] | None = None) -> bool:
        """True if there was a newer version; what was kept of the old one is deleted."""
        with self._lock:
            current = SnapshotStore(self.spark, self.tables_dir).current()
            if current == self.version:
                return False
            if current is None:
                raise FileNotFoundError(f"nothing is published under {self.tables_dir}")
            self.datasets = datasets or load_datasets(self.spark, self.tables_dir, register=False, version=current)
            self.kept = KeptResults(self.spark, self.tables_dir, current)
            self.version = current
            return True

    def overview_parties(self) -> DataFrame:
        return self.kept.get("overview_parties", {}, lambda: overview_parties(self.datasets["party_summary_enriched"]))

    def overview_alliances(self, split_unmapped: bool = False) -> DataFrame:
        name = "alliance_summary_split" if split_unmapped else "alliance_summary"
        return self.kept.get("overview_alliances", {"table": name}, lambda: overview_alliances(self.datasets[name]))

    def relevant_parties(self) -> DataFrame:
        d = self.datasets
        return self.kept.get("relevant_parties", {}, lambda: relevant_parties(d["constituency_margins"], d["party_summary_enriched"]))

    def opponents(self, party: str) -> DataFrame:
        d = self.datasets
        make = lambda: opponents(
            d["candidates_enriched"], d["constituency_margins"], party, parties=d["contest_parties"], by_party=d["contest_parties_by_party"]
        )
        return self.kept.get("opponents", {"party": party}, make)

    def head_to_head(self, party1: str, party2: str) -> DataFrame:
        d = self.datasets
        make = lambda: head_to_head(
            d["candidates_enriched"], party1, party2, parties=d["contest_parties_by_party"], winners=d["contest_winners"]
        )
        return self.kept.get("head_to_head", {"party1": party1, "party2": party2}, make)
