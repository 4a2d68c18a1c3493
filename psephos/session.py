"""Session settings and the shared folder for materialised tables."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job of this package relies on.  AQE re-plans joins from the
# real shuffle sizes (sort-merge -> broadcast when a side turns out small),
# coalesces small partitions and splits skewed join partitions at run time.
SPARK_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "psephos",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster pass neither ``master`` nor ``shuffle_partitions``: the
    submit command decides both.  Local runs (tests, bench) pass them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SPARK_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def app_id(spark: SparkSession) -> str:
    """Application id of the session (works without a local SparkContext handle)."""
    try:
        return spark.conf.get("spark.app.id")
    except Exception:  # pragma: no cover - sessions without the key
        return f"session-{id(spark)}"


def _configured_dir(spark: SparkSession) -> str | None:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # no SparkContext handle on this session (e.g. Spark Connect)
        return None


def shared_dir(spark: SparkSession, local_fallback: str | None = None) -> str:
    """Folder the cluster shares for checkpoints and written tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint directory).  Only when neither is set, and only if the caller
    passes one (tests, local bench), is ``local_fallback`` used and set as
    the checkpoint directory.  Otherwise this raises: a machine-local
    temporary folder is not a valid place to cut lineage on a cluster.
    """
    path = _configured_dir(spark)
    if path:
        return path
    if local_fallback is None:
        raise RuntimeError(
            "no shared folder: set spark.checkpoint.dir (or sc.setCheckpointDir) for this session"
        )
    os.makedirs(local_fallback, exist_ok=True)
    try:
        spark.sparkContext.setCheckpointDir(local_fallback)
    except Exception:  # pragma: no cover
        pass
    return local_fallback


def ensure_shared_dir(spark: SparkSession, local_fallback: str) -> str:
    """Use the session's shared folder; set ``local_fallback`` only where none is set (tests, bench)."""
    return shared_dir(spark, local_fallback)
