"""Sources and sinks: CSV/Parquet readers, the party map, the contest view of
the driver's test tables, materialised tables, views and JSON output."""

from psephos.sources.default_party_map import DEFAULT_PARTY_MAP_ROWS, default_party_map
from psephos.sources.files import party_map_from_rows, read_entries, read_party_map, read_totals
from psephos.sources.store import materialize, register_views
from psephos.sources.sinks import answer_rows, json_rows, preview
from psephos.sources.testview import ContestTables, contest_tables, view_party_map

__all__ = [
    "DEFAULT_PARTY_MAP_ROWS",
    "default_party_map",
    "read_entries",
    "read_totals",
    "read_party_map",
    "party_map_from_rows",
    "materialize",
    "register_views",
    "json_rows",
    "preview",
    "answer_rows",
    "ContestTables",
    "contest_tables",
    "view_party_map",
]
