"""Readers, the dataset build (materialised and lazy) and named views."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from psephos.plans import adhoc_query, build_datasets, DATASET_NAMES
from psephos.sources import party_map_from_rows, read_entries, read_party_map, read_totals
from tests.helpers import PARTY_ROWS, as_dicts

TOTALS_CSV = """state,ac_no,ac_name,total_evm_votes,total_postal_votes,total_votes
Northland,1,LAKE VIEW,231000,640,231640
Northland,10,HILLCREST,212000,800,212800
Northland,2,RIVERSIDE,210000,500,210500
"""

ENTRIES_CSV = """state,ac_no,ac_name,sn,candidate,party,evm_votes,postal_votes,total_votes,vote_percent
Northland,1,LAKE VIEW,1,Cand A,Party Alpha,120000,400,120400,51.98
Northland,1,LAKE VIEW,2,Cand B,Party Beta,98000,180,98180,42.39
Northland,1,LAKE VIEW,3,NOTA,None of the Above,13000,60,13060,5.64
Northland,10,HILLCREST,1,Cand C,Party Beta,109000,450,109450,51.43
Northland,10,HILLCREST,2,Cand D,Independent,103000,350,103350,48.57
Northland,2,RIVERSIDE,1,Cand E,Party Alpha,105000,250,105250,50.0
Northland,2,RIVERSIDE,2,Cand F,Party Gamma,105000,250,105250,50.0
"""


def write(tmp_out, name, text):
    path = os.path.join(tmp_out, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_readers_explicit_schema(spark, tmp_out):
    totals = read_totals(spark, write(tmp_out, "totals.csv", TOTALS_CSV))
    assert dict(totals.dtypes) == {
        "state": "string",
        "ac_no": "bigint",
        "ac_name": "string",
        "total_evm_votes": "bigint",
        "total_postal_votes": "bigint",
        "total_votes": "bigint",
    }
    assert totals.where(F.col("total_evm_votes") + F.col("total_postal_votes") != F.col("total_votes")).count() == 0
    entries = read_entries(spark, write(tmp_out, "entries.csv", ENTRIES_CSV))
    assert entries.count() == 7 and dict(entries.dtypes)["vote_percent"] == "double"
    pm_path = write(tmp_out, "pm.csv", "party_name,canonical_name,short_code,alliance\n" + "\n".join(",".join(r) for r in PARTY_ROWS))
    assert read_party_map(spark, pm_path).count() == len(PARTY_ROWS)


def test_build_datasets_materialised(spark, tmp_out):
    entries = read_entries(spark, write(tmp_out, "entries.csv", ENTRIES_CSV))
    totals = read_totals(spark, write(tmp_out, "totals.csv", TOTALS_CSV))
    pm = party_map_from_rows(spark, PARTY_ROWS)
    out = os.path.join(tmp_out, "tables")
    ds = build_datasets(entries, totals, pm, out_dir=out)
    assert set(ds) == set(DATASET_NAMES)
    (version,) = os.listdir(os.path.join(out, "versions"))
    for name in ("candidates", "ac_totals", "party_map", "party_summary", "alliance_summary", "party_performance", "constituency_margins"):
        assert os.path.isdir(os.path.join(out, "versions", version, name)), name
    # tie in contest 2: two winners flagged, one winner in the margins (lower serial)
    assert ds["candidates"].where("is_winner").count() == 4
    m = {r["ac_no"]: r for r in as_dicts(ds["constituency_margins"])}
    assert m[2]["winner_party_short"] == "ALP" and m[2]["margin_votes"] == 0
    assert m[10]["runner_party_short"] == "IND"
    nota = as_dicts(ds["nota_summary"])[0]
    assert nota["total_nota_votes"] == 13060 and nota["num_acs_over_5pct"] == 1
    # views are registered under the reference's names
    rows = as_dicts(adhoc_query(spark, "SELECT alliance, seats_won FROM alliance_summary ORDER BY seats_won DESC, alliance"))
    seats = {r["alliance"]: r["seats_won"] for r in rows}
    assert seats == {"NDA": 2, "MGB": 1, "OTHER": 1, "IND": 0, "NOTA": 0}
    perf = {r["party_short"]: r for r in as_dicts(ds["party_performance"])}
    assert perf["ALP"]["seats_contested"] == 2 and perf["ALP"]["strike_rate"] == 100.0
    assert "NOTA" not in perf


def test_build_datasets_lazy_equals_materialised(spark, tmp_out):
    entries = read_entries(spark, write(tmp_out, "entries.csv", ENTRIES_CSV))
    totals = read_totals(spark, write(tmp_out, "totals.csv", TOTALS_CSV))
    pm = party_map_from_rows(spark, PARTY_ROWS)
    lazy = build_datasets(entries, totals, pm, register=False)
    written = build_datasets(entries, totals, pm, out_dir=os.path.join(tmp_out, "t2"), register=False)
    for name in DATASET_NAMES:
        a = sorted(map(tuple, lazy[name].collect()), key=repr)
        b = sorted(map(tuple, written[name].select(*lazy[name].columns).collect()), key=repr)
        assert a == b, name


def test_load_datasets_equals_build(spark, tmp_out):
    from psephos.plans import load_datasets

    entries = read_entries(spark, write(tmp_out, "entries.csv", ENTRIES_CSV))
    totals = read_totals(spark, write(tmp_out, "totals.csv", TOTALS_CSV))
    pm = party_map_from_rows(spark, PARTY_ROWS)
    out = os.path.join(tmp_out, "tables")
    built = build_datasets(entries, totals, pm, out_dir=out, register=False)
    loaded = load_datasets(spark, out, register=False)
    assert set(loaded) == set(built) == set(DATASET_NAMES)
    for name in DATASET_NAMES:
        cols = built[name].columns
        a = sorted(map(tuple, built[name].collect()), key=repr)
        b = sorted(map(tuple, loaded[name].select(*cols).collect()), key=repr)
        assert a == b, name


def test_csv_columns_go_by_name(spark, tmp_out):
    import pytest

    rows = [line.split(",") for line in TOTALS_CSV.strip().split("\n")]
    plain = [tuple(r) for r in read_totals(spark, write(tmp_out, "a.csv", TOTALS_CSV)).collect()]
    turned = "\n".join(",".join([*reversed(r), "more" if i else "extra"]) for i, r in enumerate(rows))
    assert [tuple(r) for r in read_totals(spark, write(tmp_out, "b.csv", turned)).collect()] == plain
    fewer = "\n".join(",".join(r[:-1]) for r in rows)
    with pytest.raises(ValueError, match="total_votes"):
        read_totals(spark, write(tmp_out, "c.csv", fewer))
    for reader, text in ((read_entries, ENTRIES_CSV), (read_party_map, "party_name,canonical_name,short_code,alliance\na,b,c,d\n")):
        rows = [line.split(",") for line in text.strip().split("\n")]
        one = [tuple(r) for r in reader(spark, write(tmp_out, "d.csv", text)).collect()]
        turned = "\n".join(",".join(["z", *reversed(r)]) for r in rows)
        assert [tuple(r) for r in reader(spark, write(tmp_out, "e.csv", turned)).collect()] == one
        with pytest.raises(ValueError, match=rows[0][0]):
            reader(spark, write(tmp_out, "f.csv", "\n".join(",".join(r[1:]) for r in rows)))
    wrong = TOTALS_CSV.replace("231640", "many")
    with pytest.raises(Exception, match="total_votes"):
        read_totals(spark, write(tmp_out, "g.csv", wrong)).collect()


def test_answer_rows_says_what_is_left_out(spark, tmp_out):
    from psephos.sources import answer_rows, preview

    some = answer_rows(spark.range(130), f"{tmp_out}/a")
    assert some.total == 130 and some.note == "first 120 of 130 rows" and some.rows.count("{") == 120
    few = answer_rows(spark.range(120), f"{tmp_out}/b")
    assert few.total == 120 and few.note is None
    n, rows, _ = preview(spark.range(26), f"{tmp_out}/c")
    assert n == 26 and len(rows) == 5
    n, rows, _ = preview(spark.range(25), f"{tmp_out}/d")
    assert n == 25 and len(rows) == 25


def test_no_local_folder_on_a_cluster(monkeypatch):
    import pytest

    from psephos.sources import testview

    class Session:
        class sparkContext:
            master = "spark://host:7077"

    def none(spark):
        raise RuntimeError("no shared folder")

    monkeypatch.setattr(testview, "shared_dir", none)
    with pytest.raises(RuntimeError):
        testview.local_shared_dir(Session())


def test_fingerprint_sees_part_files(spark, tmp_out):
    import shutil

    from psephos.sources.testview import _VIEW_INPUTS, view_fingerprint

    for name in _VIEW_INPUTS:
        spark.range(4).repartition(2).write.parquet(f"{tmp_out}/{name}.parquet")
    before = view_fingerprint(spark, tmp_out)
    assert before == view_fingerprint(spark, tmp_out)
    part = next(f for f in os.listdir(f"{tmp_out}/nation.parquet") if f.startswith("part-"))
    shutil.copy(f"{tmp_out}/nation.parquet/{part}", f"{tmp_out}/nation.parquet/part-more.parquet")
    assert view_fingerprint(spark, tmp_out) != before
