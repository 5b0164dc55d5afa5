"""Tables without a table format: upsert, replacement, quarantine, replay, batches, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], preserve: list[str] = ()) -> DataFrame:
    """``incoming`` over ``current`` by natural key; columns in ``preserve`` keep their current value where there is one."""
    rest = [c for c in current.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_came"))
    pick = lambda c: F.coalesce(c, f"_new_{c}") if c in preserve else F.when(F.col("_came"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return current.join(new, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in rest])


def replace_groups(current: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """Groups that ``incoming`` holds are replaced whole, others stay."""
    return current.join(incoming.select(*group).distinct(), group, "left_anti").unionByName(incoming)


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their ``reason``."""
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def replay(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows written several times the last of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def batches(rows: DataFrame, group: str, order: list[str], size: str, most_bytes: int) -> DataFrame:
    """Number batches inside each group by running bytes: a new one at each multiple of ``most_bytes``; null sizes count as nought.

    Rows are dealt to ranges of group and order and staged; the totals of a group's ranges, one row each, give where
    each range begins, so running sums stay inside ranges and a large group isn't one task's.
    """
    bytes_ = F.coalesce(F.col(size), F.lit(0)).cast("long")
    dealt = stage(rows.repartitionByRange(F.col(group), *map(F.col, order)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(group, "_range").agg(F.sum(bytes_).alias("_total"))
    begin = F.sum("_total").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")
    starts = totals.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), begin.alias("_begin"))
    placed = dealt.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    inside = F.sum(bytes_).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - bytes_
    return placed.withColumn("batch", F.floor((F.col("_begin") + inside) / most_bytes).cast("long")).select(*rows.columns, "batch")


def current_of(events: DataFrame, key: str) -> DataFrame:
    """Rows that no later row supersedes."""
    return events.join(events.select(F.col("supersedes").alias(key)).where(F.col(key).isNotNull()), key, "left_anti")


def input_hash(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
