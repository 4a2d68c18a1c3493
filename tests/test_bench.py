"""bench.py prints exactly one JSON line with the fields the driver records."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from psephos.plans.catalog import QUERIES
from tests.conftest import SMOKE

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMOKE, BENCH_RUNS="1", BENCH_CPUS="4")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env,
        capture_output=True,
        text=True,
        timeout=900,
        check=True,
    ).stdout
    lines = [x for x in out.splitlines() if x.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001" and isinstance(d["value"], float)
    assert set(d["queries"]) == set(QUERIES)
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-3
    assert abs(d["build_and_queries_sec"] - d["build_sec"] - d["value"]) < 1e-3
    assert abs(d["route_sec"] + d["dataset_sec"] - d["value"]) < 1e-3
