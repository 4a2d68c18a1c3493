"""Time every registered query of the reference's operators; print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 3).  Each query gets one warm-up run and
the median of BENCH_RUNS timed runs; every run consumes the full result
through the noop sink.  The one-off build of the contest view (the
reference's start-up table build: base tables, then the named datasets
the routes read) is timed on its own as ``build_sec``.  ``route_sec`` and
``dataset_sec`` split ``value`` into route queries (served from the written
datasets) and the rest (operators recomputed from the candidates or raw tables).
``build_and_queries_sec`` adds the build to the queries; ``serving_tables``
names the tables it writes that the reference does not have.
The text operators of ``psephos/llm`` are not timed here.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from psephos.session import build_session, ensure_shared_dir  # noqa: E402
from psephos.sources.testview import contest_tables  # noqa: E402

from psephos.plans.catalog import QUERIES, is_served, served_datasets  # noqa: E402

SERVING_TABLES = [
    "contest_grams",
    "contest_index",
    "contest_parties",
    "contest_parties_by_party",
    "contest_places",
    "contest_winners",
    "gram_counts",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [a for a in sys.argv[1:]]
    spark = build_session(
        f"local[{cpus}]",
        cpus,
        app_name="psephos-bench",
        extra={"spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark, tempfile.mkdtemp(prefix="psephos-bench-", dir="/tmp"))

    t0 = time.perf_counter()
    t = contest_tables(spark, sf_dir)
    view_sec = time.perf_counter() - t0
    served_datasets(spark, sf_dir)
    build_sec = time.perf_counter() - t0
    n_entries = t.candidates.count()

    times: dict[str, float] = {}
    served: set[str] = set()
    for name, q in QUERIES.items():
        if is_served(q):
            served.add(name)
        if only and name not in only:
            continue
        run(q(spark, sf_dir))
        samples = []
        for _ in range(runs):
            s = time.perf_counter()
            run(q(spark, sf_dir))
            samples.append(time.perf_counter() - s)
        times[name] = round(statistics.median(samples), 4)
    total = round(sum(times.values()), 4)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum_of_median_query_sec",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "route_sec": round(sum(v for k, v in times.items() if k in served), 4),
                "dataset_sec": round(sum(v for k, v in times.items() if k not in served), 4),
                "build_sec": round(build_sec, 4),
                "build_and_queries_sec": round(total + build_sec, 4),
                "serving_tables": SERVING_TABLES,
                "view_build_sec": round(view_sec, 4),
                "entries": n_entries,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
