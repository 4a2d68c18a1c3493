"""Small files and folders on any file system Spark reaches (the driver's side only)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    where, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def modified(spark: SparkSession, path: str) -> int:
    where, fs = _at(spark, path)
    return fs.getFileStatus(where).getModificationTime()


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a written folder when the application's file system closes."""
    where, fs = _at(spark, path)
    fs.deleteOnExit(where)


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, whole or not there: written beside its place under another name, then renamed."""
    where, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(beside, where):
        fs.delete(beside, False)
        raise FileExistsError(path)
