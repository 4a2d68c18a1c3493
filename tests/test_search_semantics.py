"""Search text rules against DuckDB's ILIKE (the reference's engine) on random query strings."""

from __future__ import annotations

import random

import duckdb

from psephos.operators import search_contests
from psephos.operators.lookup import clean_query
from psephos.sources.testview import contest_tables
from tests.conftest import SMOKE


def test_random_queries_match_duckdb(spark):
    t = contest_tables(spark, SMOKE)
    index = t.candidates.select("state", "ac_no", "ac_name").distinct()
    rows = [tuple(r) for r in index.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (state VARCHAR, ac_no BIGINT, ac_name VARCHAR)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", rows)
    rng = random.Random(3)
    alphabet = list("Cc0123%_\\' #sTu")
    queries = ["%", "_", "\\", "12", " 7 ", "'", "er#0", "ER#00000_1", "#%9"]
    queries += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    for q in queries:
        got = [tuple(r) for r in search_contests(index, q, limit=10).collect()]
        qc = clean_query(q)
        if not qc:
            assert got == []
            continue
        want = con.execute(
            "SELECT DISTINCT state, ac_no, ac_name FROM c WHERE ac_name ILIKE ? OR CAST(ac_no AS VARCHAR) = ? "
            "ORDER BY state, ac_no, ac_name LIMIT 10",
            ["%" + qc + "%", qc],
        ).fetchall()
        assert got == want, q
