"""Contest-shaped view of the driver's TPC-H-like test tables.

There is no election data among the test tables, so every registered query
runs on this mapping: a contest is (order status, customer), an entry is a
supplier in that contest, the party is the supplier's nation and the votes
are line quantities (returned lines count as postal votes).  Nations with
key % 7 = 6 stay out of the party map (unmapped parties); nation 24 plays
none-of-the-above and nation 21 the independents.

Plan notes.  Lines are summed per (status, customer, supplier) right after
the lineitem-orders join, before any dimension join: customer, supplier and
nation names are functions of those keys, so joining them after the partial
aggregation gives the same rows while moving far fewer through the shuffles.
Contest totals and maxima are grouped aggregates joined back to the entries
with ``attach_group_aggregates`` (no window, and a hot contest is salted
over several join tasks instead of landing in one).  Customers, whose key is
a contest's, are joined last: written entries then lie by contest, and partial
aggregates by contest leave little to exchange.

Disk.  The build is a chain of written steps (lines summed, entries, entries
with their contest's figures, candidates); a step's shuffle files go when it
is written, and its input when nothing reads it any more.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions.columns import pct
from psephos.operators.grouped import attach_group_aggregates
from psephos.operators.winners import winner_flag
from psephos.schema import CONTEST_KEY
from psephos.session import app_id, shared_dir
from psephos.sources import fs
from psephos.sources.store import materialize

# Fixed value of the mapping: the raw party name (a nation name) that plays
# none-of-the-above.
VIEW_NOTA_PARTY = "NATION_24"


@dataclass(frozen=True)
class ContestTables:
    candidates: DataFrame  # entries with vote_percent and is_winner
    totals: DataFrame  # one row per contest
    party_map: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view_party_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    short = (
        F.when(k == 24, F.lit("NOTA"))
        .when(k == 21, F.lit("IND"))
        .otherwise(F.concat(F.lit("N"), k.cast("string")))
    )
    alliance = (
        F.when(k == 24, F.lit("NOTA"))
        .when(k == 21, F.lit("IND"))
        .when((k % 5).isin(0, 1), F.lit("A"))
        .when((k % 5).isin(2, 3), F.lit("B"))
        .otherwise(F.lit("OTHER"))
    )
    return (
        _table(spark, sf_dir, "nation")
        .where(k % 7 != 6)
        .select(
            F.col("n_name").alias("party_name"),
            F.concat(F.lit("Party "), F.col("n_name")).alias("canonical_name"),
            short.alias("short_code"),
            alliance.alias("alliance"),
        )
    )


def _votes_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by (status, customer, supplier): the lines of all orders summed."""
    lineitem = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    qty = F.col("l_quantity")
    returned = F.col("l_returnflag") == "R"
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderstatus", "o_custkey", "l_suppkey")
        .agg(
            F.sum(F.when(~returned, qty).otherwise(F.lit(0.0))).cast("bigint").alias("evm_votes"),
            F.sum(F.when(returned, qty).otherwise(F.lit(0.0))).cast("bigint").alias("postal_votes"),
            F.sum(qty).cast("bigint").alias("total_votes"),
        )
    )


def _named_entries(spark: SparkSession, sf_dir: str, per_supplier: DataFrame) -> DataFrame:
    """``_votes_per_supplier`` as entries, with the names of supplier, nation and customer."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        per_supplier.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.col("o_orderstatus").alias("state"),
            F.col("o_custkey").alias("ac_no"),
            F.col("c_name").alias("ac_name"),
            F.col("s_suppkey").alias("sn"),
            F.col("s_name").alias("candidate"),
            F.col("n_name").alias("party"),
            "evm_votes",
            "postal_votes",
            "total_votes",
        )
    )


def view_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without derived columns: state, ac_no, ac_name, sn, candidate, party, votes."""
    return _named_entries(spark, sf_dir, _votes_per_supplier(spark, sf_dir))


def _totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*CONTEST_KEY, "ac_name").agg(
        F.sum("evm_votes").alias("total_evm_votes"),
        F.sum("postal_votes").alias("total_postal_votes"),
        F.sum("total_votes").alias("total_votes"),
    )


def _with_contest(entries: DataFrame) -> DataFrame:
    """Entries with the votes of their contest and its maximum."""
    return attach_group_aggregates(
        entries,
        list(CONTEST_KEY),
        [F.sum("total_votes").alias("_contest_votes"), F.max("total_votes").alias("_contest_max")],
    )


def _candidates(with_contest: DataFrame) -> DataFrame:
    return with_contest.select(
        *[F.col(c) for c in with_contest.columns if c not in ("_contest_votes", "_contest_max")],
        pct("total_votes", "_contest_votes").alias("vote_percent"),
        winner_flag(F.col("total_votes"), F.col("_contest_max")).alias("is_winner"),
    )


# Written views, per (application, input fingerprint): the reference builds its
# tables once at start-up and serves every query from them; so does this.  The
# DataFrames over the written files are kept, so their footers are read once.
_BUILT: dict[tuple[str, str], ContestTables] = {}
_BUILD_LOCK = threading.Lock()

_VIEW_INPUTS = ("lineitem", "orders", "customer", "supplier", "nation")


def view_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of all input files, part files included, on any file system Spark reads."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1()
    for name in _VIEW_INPUTS:
        path = path_of(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        files = fs.listStatus(path)  # a file lists itself, a directory its part files
        h.update("".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()};" for f in files)).encode())
    return h.hexdigest()[:16]


_LOCAL_FALLBACK: dict[str, str] = {}


def local_shared_dir(spark: SparkSession) -> str:
    """The session's shared folder.  Only with a ``local`` master, where all executors are
    this process, may it be a temporary folder; elsewhere a session without one is an error."""
    try:
        return shared_dir(spark)
    except RuntimeError:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise
        app = app_id(spark)
        if app not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="psephos-shared-", dir="/tmp")
        return shared_dir(spark, _LOCAL_FALLBACK[app])


def contest_tables(spark: SparkSession, sf_dir: str) -> ContestTables:
    """Candidates, contest totals and party map, built once per session and written to the shared folder.

    The entries are used three times (as rows, for the contest totals and
    maximum, and joined back to them), so they are written first and read
    back: the lineitem-orders join runs once.  Candidates and totals are then
    written too, like the reference's tables.  The folder is the session's
    ``spark.checkpoint.dir``; a local one is set only when none is (tests).
    """
    key = (app_id(spark), view_fingerprint(spark, sf_dir))
    with _BUILD_LOCK:  # callers on several threads share one build
        if key not in _BUILT:
            _BUILT[key] = _build(spark, sf_dir, key[1])
    return _BUILT[key]


def _build(spark: SparkSession, sf_dir: str, fingerprint: str) -> ContestTables:
    root = local_shared_dir(spark)
    base = f"{root.rstrip('/')}/psephos-contest-view/{fingerprint}-{uuid.uuid4().hex[:8]}"
    keys = list(CONTEST_KEY)
    by_number = ["ac_no", "state", "sn"]
    fs.delete_on_exit(spark, base)
    lines = materialize(_votes_per_supplier(spark, sf_dir), f"{base}/lines")
    entries = materialize(_named_entries(spark, sf_dir, lines), f"{base}/entries")
    fs.delete(spark, f"{base}/lines")
    with ThreadPoolExecutor(max_workers=2) as pool:  # two independent writes, as concurrent jobs
        whole = pool.submit(materialize, _with_contest(entries), f"{base}/with_contest")
        tot = pool.submit(materialize, _totals(entries), f"{base}/ac_totals", None, keys)
        with_contest, totals = whole.result(), tot.result()
    fs.delete(spark, f"{base}/entries")
    # The figures of the contest, the same in its rows, take less in the exchange than the percent made of them.
    laid = with_contest.repartitionByRange(*by_number).sortWithinPartitions(*by_number)
    candidates = materialize(_candidates(laid), f"{base}/candidates")
    fs.delete(spark, f"{base}/with_contest")  # nothing reads the steps any more; the rest lasts as long as the application
    return ContestTables(candidates=candidates, totals=totals, party_map=view_party_map(spark, sf_dir))
