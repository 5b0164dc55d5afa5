"""Contiguous shards of nearly equal bytes from global prefix sums.

Only ``(id, size, checksum)`` is shuffled, never a text. Rows are range-partitioned by id; per-partition
totals give each partition the bytes and rows before it, a window inside the partition does the rest, so no
task ever sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, width


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def prefix_shards(items: DataFrame, n_shards: int, id_col: str = "doc_id", size_col: str = "size", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0) to ``items``.

    Rows lie in the order of ``id_col`` (nulls first; ties by the columns ``ties``, rows equal in all of them in
    any order). A row goes to the shard in whose equal share of the bytes its middle byte lies, so shards are
    contiguous and differ by one row's size at most. An empty table gives an empty result.
    """
    order = [id_col, *ties, size_col]
    ranged = items.repartitionByRange(width(items.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "shard-ranges")
    totals = ranged.groupBy("_range").agg(F.sum(size_col).alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select(
        "_range",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_b").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    start = F.col("_bytes_before") + F.sum(size_col).over(inside) - F.col(size_col)
    placed = (
        ranged.join(F.broadcast(totals), "_range")
        .withColumn("_start", start.cast("long"))
        .withColumn("_row", F.col("_rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * _start + {size_col}) * {n_shards} div (2 * _all)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).select(*items.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents; law ``bytes``."""
    items = docs.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = prefix_shards(items, n_shards, ties=("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
