"""Helpers shared by the text operators: words, digests, written tables, hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.session import shared_dir

#: A word is a run of anything but the six ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: A key with more rows than this (or than 1/20,000 of all rows, if that is more) is hot.
HOT_ROWS = 2_000
HOT_KEYS = 20_000
#: Rows of an Arrow batch (see ``ship``).
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors' Python workers, once for each application.

    Where the session leaves Spark's default, Arrow batches are limited to
    ``BATCH_ROWS`` rows: texts are long, and a batch is held several times over
    by the executor and its worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_psephos_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    sources = Path(tempfile.mkdtemp(prefix="psephos-")) / "psephos_sources.zip"
    with zipfile.ZipFile(sources, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    sc.addPyFile(str(sources))
    sc._psephos_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: after the loss of an executor the files are read again
    instead of running what made them.  The folder is deleted when the
    application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/psephos-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of such structs, comma-joined in array order."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def spans_sha256(spans: Column) -> Column:
    return F.sha2(spans_text(spans).cast("binary"), 256)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def hot_limit(rows: int, least: int = HOT_ROWS) -> int:
    """Rows beyond which a key is hot: at most ``HOT_KEYS`` keys can be, whatever the input."""
    return max(least, rows // HOT_KEYS)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Left join of one row per ``key`` (``groups``, with the number of ``rows`` it meets in ``size``).

    Keys met by more than ``limit`` rows (see ``hot_limit``: there are at most
    ``HOT_KEYS`` of them) travel to the rows in a broadcast, so no task gets
    all rows of a hot key; the others are joined on the key.  ``rows`` is read
    twice, each row is returned once.  Null keys meet nothing.
    """
    values = [c for c in groups.columns if c not in (key, size)]
    hot = F.broadcast(groups.where(F.col(size) > limit).drop(size))
    cold = groups.where(F.col(size) <= limit).drop(size)
    near = rows.join(hot.withColumn("_hot", F.lit(True)), key, "left")
    is_hot = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = [F.col(f"`{c}`") for c in [*rows.columns, *values]]
    return near.where(is_hot).select(*out).unionByName(
        near.where(~is_hot).select(*[F.col(f"`{c}`") for c in rows.columns]).join(cold, key, "left").select(*out)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most ``most`` labelled documents, in no order.

    Takes the first labels by a hash of the id; the smallest label of an id
    and the smallest of its texts count.  The sampled labels have at most
    ``most`` rows, so they are broadcast and no other text is shuffled.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.min(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(most)
    texts = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").alias("text"))
    return texts.join(F.broadcast(chosen), id).groupBy(id, "y").agg(F.min("text").alias("text"))
