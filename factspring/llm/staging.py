"""What the operators take from the library: staged tables, shipped modules, and the session's shuffle width."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shipping import ship
from ..sources.shared import discard, shared_folder, stage

__all__ = ["discard", "shared_folder", "ship", "stage", "width"]


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
