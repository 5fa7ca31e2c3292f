"""Intermediate results on shared storage.

Iterative operators cut their lineage by writing a parquet table under the
folder the cluster names in ``spark.checkpoint.dir``. A written table survives
lost executors, keeps column pruning and statistics, and freezes values that
depend on the physical partitioning (surrogate ids).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_chosen: str | None = None
_scopes: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# where each table lies that ``materialize`` returned
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def use_folder(folder: str) -> None:
    """Folder for sessions that do not set ``spark.checkpoint.dir``; every executor must see it."""
    global _chosen
    _chosen = folder


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or _chosen


def is_set(spark: SparkSession) -> bool:
    return _base(spark) is not None


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    base = _base(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/".join([f"{base.rstrip('/')}/pageloom-{spark.sparkContext.applicationId}", *_scopes])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it is over, not when the driver happens to collect its garbage."""
    usual = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, usual)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and that nothing reads any more."""
    path = _written.pop(table, None)
    if path is not None:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written within go to a folder that is deleted at the end."""
    _scopes.append(f"own-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear_scratch(spark)
        _scopes.pop()


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application (of the innermost ``own_scratch``).

    Results that have not been read yet depend on them.
    """
    _delete(spark, scratch_root(spark))
