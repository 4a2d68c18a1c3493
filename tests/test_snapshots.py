"""Versioned snapshots, buckets, reads by party, kept results, trigram search, a contest under two names."""

from __future__ import annotations

import os
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from psephos.operators import (
    contest_margins,
    contest_parties,
    contest_parties_dealt,
    enrich,
    head_to_head,
    opponents,
    party_performance,
    search_contests,
)
from psephos.operators.lookup import clean_query, contest_grams, gram_counts, pattern_grams
from psephos.operators.matchups import finishers
from psephos.plans import build_datasets, datasets, load_datasets
from psephos.plans.kept import KEPT_RESULTS, KeptResults
from psephos.plans.service import Service
from psephos.sources import fs
from psephos.sources.snapshots import SnapshotStore
from psephos.sources.store import shuffles_freed
from psephos.sources.testview import contest_tables
from tests.conftest import SMOKE
from tests.helpers import as_dicts, candidates_df, entry, party_map_df, totals_from
from tests.test_skew import SORT_MERGE, settings

ROWS = [
    *[entry("S", ac, sn, p, 100 * ac + 7 * sn) for ac in range(1, 9) for sn, p in enumerate(("Party Alpha", "Party Beta", "Independent", "None of the Above"), 1)],
    entry("S", 9, 1, "Party Gamma", 5),
]


def build(spark, out, rows=ROWS, **more):
    c = candidates_df(spark, rows)
    return build_datasets(c, totals_from(spark, rows), party_map_df(spark), out_dir=out, register=False, buckets=4, **more)


def seats(d):
    return {r["party"]: r["seats_won"] for r in as_dicts(d["party_summary"])}


# ------------------------------------------------------------------ snapshots


def test_a_build_that_dies_leaves_the_old_version(spark, tmp_out, monkeypatch):
    build(spark, tmp_out)
    old = seats(load_datasets(spark, tmp_out, register=False))
    other = [entry("S", 1, 1, "Party Beta", 9)]
    for dies_at in ("contest_margins", "gram_counts"):
        with monkeypatch.context() as m:
            m.setattr(datasets, dies_at, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("executor lost")))
            with pytest.raises(RuntimeError):
                build(spark, tmp_out, other)
        assert len(os.listdir(f"{tmp_out}/versions")) > 1 and len(SnapshotStore(spark, tmp_out).versions()) == 1
        loaded = load_datasets(spark, tmp_out, register=False)
        assert seats(loaded) == old
        assert loaded["candidates"].count() == len(ROWS) and loaded["contest_index"].count() == loaded["constituency_margins"].count() == 9
    build(spark, tmp_out, other)
    assert seats(load_datasets(spark, tmp_out, register=False)) == {"Party Beta": 1}


def test_manifest_is_written_whole_or_not(spark, tmp_out):
    store = SnapshotStore(spark, tmp_out)
    b = store.begin()
    b.write("t", spark.range(5))
    assert store.current() is None
    with pytest.raises(FileNotFoundError):
        store.load()
    first = b.publish()
    open(f"{tmp_out}/manifests/00000002-half.json.abc.tmp", "w").write('{"version": ')  # a writer died before the rename
    assert store.current() == first and store.load()["t"].count() == 5


def test_versions_are_numbered_and_pruned(spark, tmp_out):
    store = SnapshotStore(spark, tmp_out)
    made = []
    for n in (1, 2, 3):
        b = store.begin()
        b.write("t", spark.range(n))
        b.write("u", spark.range(n).withColumn("k", F.col("id") % 2), bucket_by=["k"], buckets=2)
        made.append(b.publish())
    dead = store.begin()
    dead.write("t", spark.range(9))
    assert store.versions() == made and [store.load(v)["t"].count() for v in made] == [1, 2, 3]
    assert sorted(store.prune(keep=2)) == sorted([made[0], dead.version])
    assert store.versions() == made[1:] and sorted(os.listdir(f"{tmp_out}/versions")) == sorted(made[1:])
    assert store.load(made[1])["u"].count() == 2
    with pytest.raises(FileNotFoundError):
        store.load(made[0])


def test_tables_load_in_a_session_that_did_not_write_them(spark, tmp_out):
    built = build(spark, tmp_out)
    version = SnapshotStore(spark, tmp_out).current()
    for name in datasets.BUCKETED:
        spark.sql(f"DROP TABLE psephos_{name}_{version}")  # external: the files stay
    loaded = load_datasets(spark, tmp_out, register=False)
    for name in datasets.BUCKETED:
        assert sorted(map(str, loaded[name].collect())) == sorted(map(str, built[name].collect()))


# -------------------------------------------------------------------- buckets


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    t = contest_tables(spark, SMOKE)
    out = str(tmp_path_factory.mktemp("tables"))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # several files, small as the tables are
        return t, build_datasets(t.candidates, t.totals, t.party_map, out_dir=out, register=False, buckets=8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BY_CONTEST = r"hashpartitioning\(state#\d+, ac_no#\d+"


def test_no_exchange_by_contest_over_written_tables(spark, served):
    t, d = served
    with settings(spark, SORT_MERGE):
        m = contest_margins(d["candidates_enriched"], d["ac_totals"], places=d["contest_places"])
        assert "Exchange" not in plan(m) and "SortMergeJoin" in plan(m)
        p = party_performance(d["candidates_enriched"], d["ac_totals"], d["party_summary_enriched"], parties=d["contest_parties"])
        assert not re.search(BY_CONTEST, plan(p)) and "SortMergeJoin" in plan(p)
        plain = party_performance(d["candidates_enriched"], t.totals, d["party_summary_enriched"])
        assert re.search(BY_CONTEST, plan(plain))
        assert sorted(map(str, m.collect())) == sorted(map(str, contest_margins(d["candidates_enriched"], t.totals).collect()))
        assert sorted(map(str, p.collect())) == sorted(map(str, plain.collect()))


def test_buckets_grow_with_the_contests():
    """Six times the contests are six times the buckets, not buckets of six times the rows."""
    for contests in (2_500_000, 15_000_000):
        assert contests / datasets.bucket_count(contests, 12) <= 25_000
    assert datasets.bucket_count(1_000, 12) == 12


def test_opponents_move_the_subject_alone(spark, served):
    """The table of all parties stays in its buckets, and every finisher is one row, however many contests."""
    _, d = served
    margins = d["constituency_margins"]
    assert finishers(margins, []).count() == finishers(margins, []).distinct().count() <= 25
    with settings(spark, SORT_MERGE):
        q = opponents(d["candidates_enriched"], margins, "N3", parties=d["contest_parties"], by_party=d["contest_parties_by_party"])
        assert len(re.findall(BY_CONTEST, plan(q))) == 1
        by_contest = opponents(d["candidates_enriched"], margins, "N3")
        assert q.collect() == by_contest.collect() and len(q.collect()) > 5


def test_one_file_a_bucket(spark, served):
    _, d = served
    for name in datasets.BUCKETED:
        numbers = [re.search(r"_(\d{5})\.c\d+", f)[1] for f in d[name].inputFiles()]
        assert len(numbers) == len(set(numbers)) <= 8, name


def test_entries_are_not_in_buckets(spark, tmp_out):
    """A contest of a third of all entries would be one file, and one task's."""
    rows = [entry("S", 1, sn, "Independent", sn % 50) for sn in range(1, 2001)] + [entry("S", ac, sn, "Party Alpha", sn) for ac in range(2, 42) for sn in range(1, 101)]
    c = candidates_df(spark, rows).repartition(8)
    with settings(spark, {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        d = build_datasets(c, totals_from(spark, rows), party_map_df(spark), out_dir=tmp_out, register=False, buckets=8)
    assert "candidates" not in datasets.BUCKETED
    by_file = [r["count"] for r in d["candidates"].where("ac_no = 1").groupBy(F.input_file_name()).count().collect()]
    assert sum(by_file) == 2000 and max(by_file) < 1500
    for name in datasets.BUCKETED:
        assert d[name].where("ac_no = 1").count() <= 4


# ------------------------------------------------------------- reads by party


def rows_scanned(df, column):
    """Rows that the scans with a column brought in, of a ``df`` run once (row groups that the statistics rule out are not read)."""
    total, stack, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while stack:
        node = stack.pop()
        if node.id() in seen:
            continue
        seen.add(node.id())
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            stack.append(node.plan())
        if kind == "FileSourceScanExec" and column in node.schema().fieldNames():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return total


def test_reads_by_party_skip_the_others(spark, served):
    _, d = served
    every = d["contest_parties"].count()
    both = d["contest_parties"].where(F.col("party_short").isin("N3", "N8")).count()
    args = (d["candidates_enriched"], "N3", "N8")
    plain = head_to_head(*args, parties=d["contest_parties"], winners=d["contest_winners"])
    fast = head_to_head(*args, parties=d["contest_parties_by_party"], winners=d["contest_winners"])
    assert fast.collect() == plain.collect()
    assert rows_scanned(plain, "best_votes") >= every
    assert both <= rows_scanned(fast, "best_votes") < every / 2
    margins = d["constituency_margins"]
    plain = opponents(d["candidates_enriched"], margins, "N3", parties=d["contest_parties"])
    fast = opponents(d["candidates_enriched"], margins, "N3", parties=d["contest_parties"], by_party=d["contest_parties_by_party"])
    assert fast.collect() == plain.collect()
    assert rows_scanned(fast, "entries") < 1.5 * every <= rows_scanned(plain, "entries") * 0.8


# --------------------------------------------------------------- kept results


def test_second_call_reads_what_was_kept(spark, tmp_out):
    build(spark, tmp_out)
    s = Service(spark, tmp_out)
    routes = {
        "overview_parties": lambda s: s.overview_parties(),
        "overview_alliances": lambda s: s.overview_alliances(),
        "relevant_parties": lambda s: s.relevant_parties(),
        "opponents": lambda s: s.opponents("ALP"),
        "head_to_head": lambda s: s.head_to_head("ALP", "BET"),
    }
    assert set(routes) == set(KEPT_RESULTS)
    first = {n: r(s).collect() for n, r in routes.items()}
    assert all(first.values())
    other = Service(spark, tmp_out)  # as another session would open it
    for name, route in routes.items():
        for service in (s, other):
            again = route(service)
            assert again.collect() == first[name]
            assert again.inputFiles() and all(f"/results/{s.version}/{name}/" in f for f in again.inputFiles())
    assert s.refresh() is False


def test_rebuild_invalidates(spark, tmp_out):
    build(spark, tmp_out)
    s = Service(spark, tmp_out)
    before = [tuple(r) for r in s.opponents("ALP").collect()]
    build(spark, tmp_out, ROWS[:4])
    assert [tuple(r) for r in s.opponents("ALP").collect()] == before  # until it moves on
    assert s.refresh() is True
    after = [tuple(r) for r in s.opponents("ALP").collect()]
    assert after == [("NOTA", "NOTA", 1)] and after != before
    assert os.listdir(f"{tmp_out}/results") == [s.version]


def test_least_recently_used_goes(spark, tmp_out):
    runs = []

    def make(n):
        def go():
            runs.append(n)
            return spark.range(n).orderBy(F.col("id").desc())

        return go

    kept = KeptResults(spark, tmp_out, "v", {"q": 2, "r": 1}, grace=0.0)
    for n in (3, 4, 3, 5, 3, 4):
        got = kept.get("q", {"n": n}, make(n))
        assert [r["id"] for r in got.collect()] == list(range(n - 1, -1, -1))
    assert runs == [3, 4, 5, 4] and kept.held("q") == 2  # 5 put 4 out, 4 put 5 out, 3 stayed
    assert len(os.listdir(f"{tmp_out}/results/v/q")) == 2
    kept.get("r", {"n": 3}, make(3))
    assert runs[-1] == 3 and kept.held("q") == 2
    again = KeptResults(spark, tmp_out, "v", {"q": 2, "r": 1})
    again.get("q", {"n": 3}, make(3))
    assert len(runs) == 5
    # a result whose writer died is not one
    fs.delete(spark, next(f"{tmp_out}/results/v/r/{k}" for k in os.listdir(f"{tmp_out}/results/v/r")) + "/schema.json")
    KeptResults(spark, tmp_out, "v", {"q": 2, "r": 1}).get("r", {"n": 3}, make(3))
    assert len(runs) == 6


def test_a_result_deleted_by_a_newer_version_is_made_again(spark, tmp_out):
    old = KeptResults(spark, tmp_out, "v1", {"q": 2})
    old.get("q", {}, lambda: spark.range(3)).collect()
    KeptResults(spark, tmp_out, "v2", {"q": 2})
    assert os.listdir(f"{tmp_out}/results") == []
    assert old.get("q", {}, lambda: spark.range(4)).count() == 4


def test_no_rows_are_kept_too(spark, tmp_out):
    kept = KeptResults(spark, tmp_out, "v", {"q": 2})
    none = spark.range(5).where("id > 9")
    assert kept.get("q", {}, lambda: none).collect() == [] == kept.get("q", {}, lambda: 1 / 0).collect()


# ------------------------------------------------------------- trigram search


def test_search_by_trigrams_equals_the_scan(spark, tmp_out):
    rng = random.Random(8)
    names = ["Raj\\Ghat", "50%_north", "ŻÓŁW İstanbul", "ab", "", None, "Straße", "ΟΔΟΣ", "a_c%d\\e"]
    names += ["".join(rng.choice("abcAB%_\\ ß") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    index = spark.createDataFrame([("S", i, n) for i, n in enumerate(names)], "state string, ac_no bigint, ac_name string")
    grams = contest_grams(index).cache()
    counts = gram_counts(grams).cache()
    queries = ["ghat", "J\\G", "%_n", "50%", "straße", "οδος", "żółw", "İst", "ab", "7", "   ", "a_c%d", "___", "%%%", "zzz"]
    queries += ["".join(rng.choice("abcAB%_\\ ß") for _ in range(rng.randint(1, 7))) for _ in range(25)]
    looked_up = 0
    for q in queries:
        fast = search_contests(index, q, None, grams=grams, counts=counts)
        assert fast.collect() == search_contests(index, q, None).collect(), q
        looked_up += "gram" in fast._jdf.queryExecution().optimizedPlan().toString()
    assert looked_up > 5


def test_pattern_grams():
    assert pattern_grams("%abcd%") == ["abc", "bcd"]
    assert pattern_grams("%ab_cd%e%") == []
    assert pattern_grams("%a\\%c\\\\d%") == ["%c\\", "a%c", "c\\d"]
    assert pattern_grams("") == [] and clean_query(" o'k ") == "ok"


def test_common_trigrams_scan_the_index(spark, monkeypatch):
    from psephos.operators import lookup

    index = spark.createDataFrame([("S", i, f"same {i}") for i in range(20)], "state string, ac_no bigint, ac_name string")
    grams = contest_grams(index)
    counts = gram_counts(grams)
    monkeypatch.setattr(lookup, "MOST_NAMES", 10)
    common = search_contests(index, "same", None, grams=grams, counts=counts)
    assert "gram#" not in common._jdf.queryExecution().optimizedPlan().toString() and common.count() == 20
    rare = search_contests(index, "same 19", None, grams=grams, counts=counts)
    assert "gram#" in rare._jdf.queryExecution().optimizedPlan().toString() and rare.count() == 1


# ------------------------------------------------------- contest of two names


def test_head_to_head_under_two_names(spark):
    rows = [
        entry("S", 1, 1, "Party Alpha", 50, ac_name="Ham"),
        entry("S", 1, 2, "Party Beta", 40, ac_name="HAM"),
        entry("S", 2, 1, "Party Alpha", 5, ac_name="Hill"),
        entry("S", 2, 2, "Party Beta", 6, ac_name="Hill"),
        entry("S", 2, 3, "Party Alpha", 9, ac_name="HILL"),
        entry("S", 3, 1, "Party Alpha", 1, ac_name="Only"),
    ]
    ce = enrich(candidates_df(spark, rows), party_map_df(spark))
    want = [
        (1, "HAM", None, 40, "ALP"),
        (1, "Ham", 50, None, "ALP"),
        (2, "HILL", 9, None, "ALP"),
        (2, "Hill", 5, 6, "ALP"),
    ]
    for parties in (None, contest_parties(ce)):
        got = [(r["ac_no"], r["ac_name"], r["p1_votes"], r["p2_votes"], r["actual_winner"]) for r in head_to_head(ce, "ALP", "BET", parties=parties).collect()]
        assert got == want


# ----------------------------------------------------------------------- disk


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def left(spark, before):
    """Shuffle files that are there now and were not before (they are deleted in the background)."""
    until = time.time() + 20
    while (now := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return now


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_written_tables_leave_no_shuffle_files(spark, tmp_out):
    before, set_to = shuffle_files(spark), spark.conf.get(FREES)
    b = SnapshotStore(spark, tmp_out).begin()
    df = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    for name, how in {"plain": {}, "ranges": {"range_by": ["k"]}, "buckets": {"bucket_by": ["k"], "buckets": 3}}.items():
        b.write(name, df, **how)
        assert not left(spark, before), name
    assert spark.conf.get(FREES) == set_to
    b.publish()
    assert [t.count() for t in SnapshotStore(spark, tmp_out).load().values()] == [100, 100, 100]


def test_a_build_leaves_no_shuffle_files(spark, tmp_out):
    rows = [entry("S", ac, sn, f"P{sn % 5}", ac + sn) for ac in range(1, 30) for sn in range(1, 7)]
    candidates, totals, party_map = candidates_df(spark, rows), totals_from(spark, rows), party_map_df(spark)
    before = shuffle_files(spark)
    built = build_datasets(candidates, totals, party_map, out_dir=tmp_out, register=False)
    assert not left(spark, before)
    files = [f for name in ("candidates", "contest_parties", "contest_grams") for f in built[name].inputFiles()]
    codecs = {pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(0).column(0).compression for f in files}
    assert codecs == {"ZSTD"}


def test_freeing_ends_with_the_last_of_several_callers(spark):
    set_to = spark.conf.get(FREES)
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            assert spark.conf.get(FREES) == "true"
        assert spark.conf.get(FREES) == "true"
    assert spark.conf.get(FREES) == set_to


def test_the_view_keeps_no_steps(spark):
    t = contest_tables(spark, SMOKE)
    base = os.path.dirname(os.path.dirname(t.candidates.inputFiles()[0].removeprefix("file:")))
    assert [n for n in sorted(os.listdir(base)) if not n.startswith(".")] == ["ac_totals", "candidates"]


@pytest.mark.parametrize("hot_rows", [0, 4, 5, 10**6])
def test_dealt_parties_equal_contest_parties(spark, hot_rows):
    rng = random.Random(5)
    parties = ["Party Alpha", "Party Beta", "Independent", "Elsewhere", None]
    rows = [entry("S", ac, sn, rng.choice(parties), rng.choice((None, 0, 5, 40, 900)), vote_percent=rng.choice((None, 0.0, 9.9, 10.0, 50.0, 77.7))) for ac in (1, 2, 3) for sn in range(1, 3 * ac)]
    rows += [entry(None, 7, 1, "Party Beta", 5), entry(None, 7, 2, "Party Beta", None), entry(None, None, 1, None, 3), *[entry("S", None, sn, "Party Alpha", sn) for sn in range(9)]]
    rows += [rows[0], rows[-1]]
    ce = enrich(candidates_df(spark, rows), party_map_df(spark, [("Party Alpha", "Alpha Party", "ALP", "NDA"), ("Party Alpha", "Alpha Party", "ALP", "MGB"), ("Party Beta", "Beta Party", "BET", "MGB")]))
    dealt = contest_parties_dealt(ce, 3, hot_rows=hot_rows)
    want = contest_parties(ce)
    assert dealt.dtypes == want.dtypes
    assert sorted(map(str, dealt.collect())) == sorted(map(str, want.collect()))
    places = dealt.select("state", "ac_no", F.spark_partition_id().alias("p")).distinct().groupBy("state", "ac_no").count()
    assert places.where("count > 1").isEmpty()  # a contest lies in one partition


def test_parties_are_exchanged_once(spark, tmp_out):
    """Entries go to the buckets as they are: no exchange by party before, none by bucket after."""
    ce = enrich(candidates_df(spark, ROWS), party_map_df(spark))
    with settings(spark, SORT_MERGE | {"spark.sql.adaptive.enabled": "false"}):
        p = plan(contest_parties_dealt(ce, 3))
    top = p[: p.index("REPARTITION_BY_NUM")]
    assert top.count("Exchange") == 1 and "NestedLoop" not in p
    b = SnapshotStore(spark, tmp_out).begin()
    out = b.write("contest_parties", contest_parties_dealt(ce, 3), bucket_by=["state", "ac_no"], buckets=3, dealt=True)
    files = [os.path.basename(f) for f in out.inputFiles()]
    assert len(files) == len({re.search(r"_(\d{5})\.", f).group(1) for f in files}) <= 3
    assert sorted(map(str, out.collect())) == sorted(map(str, contest_parties(ce).collect()))
