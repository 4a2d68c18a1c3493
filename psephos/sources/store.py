"""Materialised tables (the reference's CREATE TABLE AS) and named views.

``materialize`` writes a DataFrame as Parquet under a folder the cluster
shares and reads it back, which both reuses the result across queries and
cuts its lineage: a lost executor re-reads the files instead of re-running
the joins that built them.

Disk.  Spark keeps a job's shuffle files until the driver happens to collect
its garbage, so those of all writes of a build would pile up.  ``shuffles_freed``
has each job's files deleted when the job ends; all tables are written under it.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Fixed value: compression of written tables (Spark's default, snappy, takes about a third more).
CODEC = "zstd"

_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[str, tuple[int, str | None]] = {}
_FREEING_LOCK = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of every job of the session are deleted as soon as the job has ended.

    The setting is the session's, so callers on several threads share it and
    the last one to leave puts back what was set before.
    """
    session = str(spark._jsparkSession.sessionUUID())
    with _FREEING_LOCK:
        inside, before = _FREEING.get(session, (0, None))
        if not inside:
            before = spark.conf.get(_FREES, None)
            spark.conf.set(_FREES, "true")
        _FREEING[session] = (inside + 1, before)
    try:
        yield
    finally:
        with _FREEING_LOCK:
            inside, before = _FREEING.pop(session)
            if inside > 1:
                _FREEING[session] = (inside - 1, before)
            elif before is None:
                spark.conf.unset(_FREES)
            else:
                spark.conf.set(_FREES, before)


def materialize(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    cluster_by: list[str] | None = None,
    range_by: list[str] | None = None,
) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and return a DataFrame reading it.

    ``cluster_by`` sorts each task's rows by those columns before writing
    (no shuffle, so a hot key cannot overload one task): every file then has
    narrow min/max statistics per row group on them, and a point filter on
    the key reads only the row groups that can hold it.
    ``range_by`` deals the rows out by ranges of those columns first, so a
    point filter on the first of them reads few of the files; the last one
    should tell rows of one key apart, so that a hot key spans several files.
    """
    if range_by:
        df = df.repartitionByRange(*range_by)
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite").option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_freed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def register_views(datasets: Mapping[str, DataFrame]) -> None:
    """Name every dataset as a temporary view (the reference's CREATE VIEW)."""
    for name, df in datasets.items():
        df.createOrReplaceTempView(name)
