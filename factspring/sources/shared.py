"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files behind a table that was written go at once; nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []
_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset the context's checkpoint folder, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get() if own.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folder_of[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more. ``table`` is what ``stage`` returned; other frames are left alone."""
    path = _folder_of.pop(table, None)
    if path:
        _remove(table.sparkSession, path)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the ``with`` block are removed at its end; results are read lazily, so write them inside it."""
    first = len(_written)
    try:
        yield
    finally:
        for path in _written[first:]:
            _remove(spark, path)
        del _written[first:]
