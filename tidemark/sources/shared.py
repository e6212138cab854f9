"""Tables that are written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which goes when the session ends; only a local session without that setting gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    store, at = _on_store(spark, path)
    store.deleteOnExit(at)
    return path


def _on_store(spark: SparkSession, path: str):
    """(the file system of a path, the path as it knows it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _on_store(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    store, at = _on_store(spark, path)
    store.delete(at, True)


def stamp(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of everything in a folder: it changes when a file is replaced."""
    store, at = _on_store(spark, folder)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(at)))


def parts_of(table: DataFrame) -> int:
    """A number of tasks that grows with a table that is read from files: 16 for each of its splits, and as many as Spark shuffles into at least."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * table.rdd.getNumPartitions())


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read again: computed once, whatever reads them, and not again when an executor is lost."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
