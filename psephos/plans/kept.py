"""Results kept by dataset version, query and parameters.

The first call of a query with some parameters writes its rows to the shared
folder; later calls read them back, in the same order, from any session that
opens the same folder.  Each query keeps a number of results of its own; beyond
it the one used longest ago goes.  A new version of the datasets starts empty
and deletes what older ones kept (a session still on an older version makes its
results again).
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephos.sources import fs
from psephos.sources.store import shuffles_freed

#: Results kept of each route, as many as the reference keeps.
KEPT_RESULTS = {"overview_parties": 128, "overview_alliances": 1, "relevant_parties": 1, "opponents": 64, "head_to_head": 128}
#: Seconds an evicted result stays on disk for those who still read it.
GRACE = 600.0
_PLACE = "_place"


class KeptResults:
    def __init__(self, spark: SparkSession, root: str, version: str, sizes: Mapping[str, int] = KEPT_RESULTS, grace: float = GRACE):
        self.spark, self.base, self.version = spark, f"{root.rstrip('/')}/results", version
        self.sizes, self.grace = dict(sizes), grace
        self._lock = threading.Lock()
        self._making: dict[tuple[str, str], threading.Lock] = {}
        self._kept: dict[str, OrderedDict[str, str]] = {q: OrderedDict() for q in self.sizes}
        self._evicted: list[tuple[float, str]] = []
        for other in fs.list_names(spark, self.base):
            if other != version:
                fs.delete(spark, f"{self.base}/{other}")
        for query in self.sizes:
            folder = f"{self.base}/{version}/{query}"
            whole = [k for k in fs.list_names(spark, folder) if fs.exists(spark, f"{folder}/{k}/schema.json")]
            for key in sorted(whole, key=lambda k: fs.modified(spark, f"{folder}/{k}")):
                self._kept[query][key] = f"{folder}/{key}"

    def get(self, query: str, params: Mapping[str, object], make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of ``query`` with ``params``: read back if kept, else made by ``make``, written and read back."""
        key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]
        with self._lock:
            making = self._making.setdefault((query, key), threading.Lock())
        with making:  # callers with the same parameters share one run
            with self._lock:
                path = self._kept[query].get(key)
                if path:
                    self._kept[query].move_to_end(key)
            if path and not fs.exists(self.spark, f"{path}/schema.json"):
                path = None  # a session that opened a newer version deleted it
            if path is None:
                path = self._write(query, key, make())
                with self._lock:
                    self._kept[query][key] = path
                    while len(self._kept[query]) > self.sizes[query]:
                        self._evicted.append((time.monotonic(), self._kept[query].popitem(last=False)[1]))
                    late = [p for t, p in self._evicted if time.monotonic() - t >= self.grace]
                    self._evicted = [(t, p) for t, p in self._evicted if p not in late]
                for p in late:
                    if p not in self._kept[query].values():
                        fs.delete(self.spark, p)
            return self._read(path)

    def held(self, query: str) -> int:
        return len(self._kept[query])

    def _write(self, query: str, key: str, df: DataFrame) -> str:
        path = f"{self.base}/{self.version}/{query}/{key}"
        # Partitions of a sorted result follow one another, so this numbers its rows in order.
        with shuffles_freed(self.spark):
            df.withColumn(_PLACE, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
        fs.delete(self.spark, f"{path}/schema.json")
        fs.write_text(self.spark, f"{path}/schema.json", df.schema.json())  # last: marks the result as whole
        return path

    def _read(self, path: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(fs.read_text(self.spark, f"{path}/schema.json")))
        placed = T.StructType([*schema.fields, T.StructField(_PLACE, T.LongType())])
        return self.spark.read.schema(placed).parquet(f"{path}/rows").orderBy(_PLACE).drop(_PLACE)
