"""Every registered query against its DuckDB oracle on the sf0.001 tables (t2 layer, small)."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_mod
from psephos.plans.catalog import QUERIES
from psephos.plans.oracle import ORACLE_SQL
from tests.conftest import SMOKE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    yield con
    con.close()


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v

    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE_SQL) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    expected = rel.fetchall()
    assert len(rows) == len(expected)
    assert _bag(df.columns, rows) == _bag(rel.columns, expected)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 434  # every contest of sf0.001
    assert df.where("runner_candidate IS NULL").count() == 4


def _ordered(name, spark, key):
    rows = [r.asDict() for r in QUERIES[name](spark, SMOKE).collect()]
    assert len(rows) > 2
    assert rows == sorted(rows, key=key)


def test_orders(spark):
    _ordered("overview_parties", spark, lambda r: (-r["seats_won"], -r["vote_share"], r["state"], r["party_short"]))
    _ordered("overview_alliances", spark, lambda r: (-r["seats_won"], r["alliance"]))
    _ordered("overview_alliances_split", spark, lambda r: (-r["seats_won"], r["alliance"]))
    _ordered("close_contests_10", spark, lambda r: (r["margin_percent"], r["state"], r["ac_no"]))


def test_filters_take_something_out(spark):
    """Each of these queries gives fewer rows than without its filter, and some."""
    count = lambda name: QUERIES[name](spark, SMOKE).count()
    assert 0 < count("relevant_parties_few") < count("relevant_parties")
    assert 0 < count("opponents_N3_few") < count("opponents_N3")
    check = QUERIES["statement_check"](spark, SMOKE)
    assert 0 < check.where("is_read_only").count() < check.count()
    assert count("overview_alliances_split") == count("overview_alliances") + 1
    assert QUERIES["json_round_trip"](spark, SMOKE).where("margin_percent IS NULL").count() > 0
