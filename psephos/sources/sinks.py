"""Result sinks: JSON rows with real nulls, and bounded previews.

Rows leave as JSON text built on the executors (``to_json``), so a large
result is written as files (``json_rows(df).write.text(path)``) and never
pulled through the driver.  The bounded helpers (``preview``,
``answer_rows``) write the whole result in one run, which counts it, and bring
back only the first of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephos.functions.columns import nan_to_null
from psephos.sources.store import CODEC, shuffles_freed

# Fixed values of the reference's result handling.
PREVIEW_THRESHOLD = 25  # more rows than this -> only a sample is passed on
PREVIEW_SAMPLE = 5
ANSWER_MAX_ROWS = 120


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row; NaN doubles and nulls both become JSON null."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        fields.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


@dataclass(frozen=True)
class StoredRows:
    """A result written whole as JSON rows, with the number of its rows."""

    rows: DataFrame  # one column ``json``, in the result's order
    total: int

    def first(self, n: int) -> list[str]:
        """The first ``n`` rows (a bounded read of what was written; the query does not run again)."""
        return [r[0] for r in self.rows.limit(n).collect()]


def store_rows(df: DataFrame, path: str) -> StoredRows:
    """Write every row of ``df`` as JSON under ``path`` in one run, which counts them on the way."""
    counted = Observation()
    placed = json_rows(df).select(F.monotonically_increasing_id().alias("place"), "json")
    with shuffles_freed(df.sparkSession):
        placed.observe(counted, F.count(F.lit(1)).alias("total")).write.mode("overwrite").option("compression", CODEC).parquet(path)
    rows = df.sparkSession.read.schema("place bigint, json string").parquet(path).orderBy("place").select("json")
    return StoredRows(rows, counted.get["total"])


def preview(
    df: DataFrame, path: str, threshold: int = PREVIEW_THRESHOLD, sample: int = PREVIEW_SAMPLE
) -> tuple[int, list[str], DataFrame]:
    """(row count, JSON rows to pass on, all rows): passed on are all rows if at most ``threshold``, else the first ``sample``.

    The query runs once, into ``path``; at most ``threshold`` rows reach the driver.
    """
    stored = store_rows(df, path)
    return stored.total, stored.first(stored.total if stored.total <= threshold else sample), stored.rows


@dataclass(frozen=True)
class Answer:
    """Rows passed on to the answer text: their JSON array, the number of all rows, a note if some are left out, and all rows."""

    rows: str
    total: int
    note: str | None
    every: DataFrame


def answer_rows(df: DataFrame, path: str, max_rows: int = ANSWER_MAX_ROWS) -> Answer:
    """At most ``max_rows`` rows as JSON, with the total and a note that says what is missing; the query runs once, into ``path``."""
    stored = store_rows(df, path)
    note = f"first {max_rows} of {stored.total} rows" if stored.total > max_rows else None
    return Answer("[" + ",".join(stored.first(max_rows)) + "]", stored.total, note, stored.rows)
