"""Picks of one row for each key: the latest word, the first, or all that tie for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total.

    As an aggregate, ``max_by`` would combine before the shuffle but can't mix directions and null placements; the
    window's rank limit does: Spark keeps a task's first row of each key before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def newest_ties(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows that have their key's greatest ``by``."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, with ``place`` from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
