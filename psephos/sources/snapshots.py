"""Versioned snapshots of a set of tables.

A build writes its tables into a folder of its own version, where nobody looks
for them, and publishes them by one small manifest, written last.  Readers take
the newest whole manifest and read the tables it names: a build that dies half
way, or runs beside another one, never leaves them tables of two builds.

    root/versions/<version>/<table>/...     Parquet
    root/manifests/<number>-<version>.json  names, schemas and buckets

Tables with one row, or few, for each contest (never the entries, of which one
contest may hold a third) can be written in buckets by its key, one file a bucket, so joins and
aggregates on the key need no exchange.  Buckets are read through the session's
catalog, under a name that holds the version; a session that does not know it
registers it from the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from psephos.sources import fs
from psephos.sources.store import CODEC, materialize, shuffles_freed


@dataclass(frozen=True)
class Table:
    """A table of a version: where it lies, its schema (JSON), and its buckets, if it has any."""

    path: str
    schema: str
    buckets: int = 0
    bucket_by: tuple[str, ...] = ()


class Build:
    """One version being written; nothing of it is seen before ``publish``."""

    def __init__(self, store: SnapshotStore):
        self.store = store
        self.version = uuid.uuid4().hex[:16]
        self.tables: dict[str, Table] = {}

    def write(
        self,
        name: str,
        df: DataFrame,
        bucket_by: Sequence[str] = (),
        buckets: int = 0,
        cluster_by: list[str] | None = None,
        range_by: list[str] | None = None,
        dealt: bool = False,
    ) -> DataFrame:
        """Write a table of this version and return it as read back; ``dealt``: its partitions are the buckets already."""
        path = f"{self.store.root}/versions/{self.version}/{name}"
        if not (bucket_by and buckets):
            out = materialize(df, path, cluster_by=cluster_by, range_by=range_by)
            self.tables[name] = Table(path, out.schema.json())
            return out
        bucket_by = tuple(bucket_by)
        self.tables[name] = table = Table(path, df.schema.json(), buckets, bucket_by)
        # Dealt by the same hash first: every bucket is one task's, and one file.
        writer = (df if dealt else df.repartition(buckets, *bucket_by)).write.format("parquet").option("path", path).option("compression", CODEC)
        with shuffles_freed(self.store.spark):
            writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(self.store.catalog_name(self.version, name))
        return self.store.read(self.version, name, table)

    def publish(self) -> str:
        """Make this version the current one."""
        text = json.dumps({"version": self.version, "tables": {n: asdict(t) for n, t in self.tables.items()}})
        numbers = [int(m.split("-")[0]) for m in self.store.manifests()]
        number = max(numbers, default=0) + 1
        fs.write_text(self.store.spark, f"{self.store.root}/manifests/{number:08d}-{self.version}.json", text)
        return self.version


class SnapshotStore:
    """The versions under a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifests(self) -> list[str]:
        return [n for n in fs.list_names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]

    def versions(self) -> list[str]:
        """Published versions, the oldest first."""
        return [n[: -len(".json")].split("-", 1)[1] for n in self.manifests()]

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def begin(self) -> Build:
        return Build(self)

    def catalog_name(self, version: str, name: str) -> str:
        return f"psephos_{name}_{version}"

    def _manifest(self, version: str | None) -> dict:
        names = [n for n in self.manifests() if version is None or n.endswith(f"-{version}.json")]
        if not names:
            raise FileNotFoundError(f"no published version {version or ''} under {self.root}")
        return json.loads(fs.read_text(self.spark, f"{self.root}/manifests/{names[-1]}"))

    def load(self, version: str | None = None) -> dict[str, DataFrame]:
        """All tables of one published version (by default the current one)."""
        m = self._manifest(version)
        return {n: self.read(m["version"], n, Table(**{**t, "bucket_by": tuple(t["bucket_by"])})) for n, t in m["tables"].items()}

    def read(self, version: str, name: str, table: Table) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        if not table.buckets:
            return self.spark.read.schema(schema).parquet(table.path)
        known = self.catalog_name(version, name)
        if not self.spark.catalog.tableExists(known):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            by = ", ".join(f"`{c}`" for c in table.bucket_by)
            where = table.path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS `{known}` ({columns}) USING parquet"
                f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {table.buckets} BUCKETS LOCATION '{where}'"
            )
        return self.spark.table(known)

    def prune(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` published versions, and folders of builds that were published or died before
        the oldest kept one; returns the versions deleted.  Not for use beside a running build."""
        kept = self.versions()[-keep:] if keep else []
        gone = [v for v in fs.list_names(self.spark, f"{self.root}/versions") if v not in kept]
        for name in self.manifests():
            if name[: -len(".json")].split("-", 1)[1] not in kept:
                fs.delete(self.spark, f"{self.root}/manifests/{name}")  # first: no reader finds a version half deleted
        for v in gone:
            for name in fs.list_names(self.spark, f"{self.root}/versions/{v}"):
                self.spark.sql(f"DROP TABLE IF EXISTS `{self.catalog_name(v, name)}`")
            fs.delete(self.spark, f"{self.root}/versions/{v}")
        return gone
