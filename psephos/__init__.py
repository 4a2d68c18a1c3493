"""Contest (election) analytics on Spark DataFrames.

Entries (one row per candidate in a contest), contest totals and a party map
go in; DataFrames come out for winner flags, party and alliance summaries,
party performance, margins, NOTA and independent tallies, matchups, finish
profiles, contest search and detail, and read-only ad-hoc SQL over the named
datasets.  Every operator is a lazy DataFrame plan built from native Column
expressions, aggregates, windows and joins; nothing is collected to the driver.
"""

from psephos.schema import CONTEST_KEY

__all__ = ["CONTEST_KEY"]
