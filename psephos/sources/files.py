"""Readers for the reference's inputs: entries, contest totals, party map.

Columns are found by name, in any order; a missing one is an error that names
it, and columns beyond the schema are left out.  Values are cast to an explicit
schema (no inference pass): integers are bigint everywhere, and a value that is
no number is an error.  CSV needs a header row; Parquet works as well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.schema import ENTRY_SCHEMA, PARTY_MAP_SCHEMA, TOTALS_SCHEMA


def _read(spark: SparkSession, path: str, schema, fmt: str | None) -> DataFrame:
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(raw.columns)}")
    return raw.select(*[_cast(raw, f).alias(f.name) for f in schema.fields])


def _cast(raw: DataFrame, field) -> Column:
    value = F.col(f"`{field.name}`")
    if raw.schema[field.name].dataType == field.dataType:
        return value
    cast = value.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), value.cast("string")))
    return F.when(cast.isNull() & value.isNotNull(), wrong.cast(field.dataType)).otherwise(cast)


def read_entries(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One row per candidate entry: state, ac_no, ac_name, sn, candidate, party, votes, vote_percent."""
    return _read(spark, path, ENTRY_SCHEMA, fmt)


def read_totals(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One row per contest: state, ac_no, ac_name, total_evm_votes, total_postal_votes, total_votes."""
    return _read(spark, path, TOTALS_SCHEMA, fmt)


def read_party_map(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Party dimension: party_name (raw), canonical_name, short_code, alliance."""
    return _read(spark, path, PARTY_MAP_SCHEMA, fmt)


def party_map_from_rows(spark: SparkSession, rows: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Party map from inline rows (the reference keeps its map inline)."""
    return spark.createDataFrame(list(rows), PARTY_MAP_SCHEMA)
