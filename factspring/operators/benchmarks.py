"""Ratios of lines across entities: guarded units, reasons where there is none, places and middles without one task for a ratio."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage


@dataclass(frozen=True)
class Ratio:
    """``times * top / bottom`` (or ``top`` as printed) to some places; each line is wanted in its own unit."""

    name: str
    top: str
    top_unit: str
    bottom: str | None = None
    bottom_unit: str | None = None
    times: int = 1
    places: int = 2


def _worked(ratio: Ratio) -> Column:
    """struct<ratio, value, reason> from the columns ``line`` (value, unit) of a wide row."""
    wanted = [(ratio.top, ratio.top_unit)] + ([(ratio.bottom, ratio.bottom_unit)] if ratio.bottom else [])
    listed = lambda cases: F.concat_ws(", ", *[F.when(c, text) for c, text in cases])
    missing = listed([(F.col(f"{c}.value").isNull(), F.lit(c)) for c, _ in wanted])
    other = listed([(~F.col(f"{c}.unit").eqNullSafe(F.lit(u)), F.concat(F.lit(f"{c} in "), F.coalesce(F.col(f"{c}.unit"), F.lit("no unit")))) for c, u in wanted])
    value = F.col(f"{ratio.top}.value").cast("double")
    nought = F.lit(False)
    if ratio.bottom:
        nought = F.col(f"{ratio.bottom}.value") == 0
        value = F.try_divide(value, F.col(f"{ratio.bottom}.value").cast("double")) * ratio.times
    reason = F.when(missing != "", F.concat(F.lit("not printed: "), missing)).when(other != "", F.concat(F.lit("another unit: "), other)).when(nought, f"{ratio.bottom} is nought")
    rounded = F.round(value.cast("decimal(38,9)"), ratio.places).cast("decimal(28,4)")
    return F.struct(F.lit(ratio.name).alias("ratio"), F.when(reason.isNull(), rounded).alias("value"), reason.alias("reason"))


def ratios(facts: DataFrame, entity: list[str], newest: Column, metrics: list[Ratio]) -> DataFrame:
    """``*entity, ratio, value, reason`` for each entity and ratio. ``facts`` has ``*entity, line, value, unit``; of several figures of a line the greatest ``newest`` counts, null ones never.

    An entity without a needed line, with one in another unit or with nought below has a null value and the reason.
    """
    codes = sorted({c for m in metrics for c in (m.top, m.bottom) if c})
    pick = [F.max_by(F.struct("value", "unit"), F.when((F.col("line") == c) & F.col("value").isNotNull(), newest)).alias(c) for c in codes]
    wide = facts.groupBy(*entity).agg(*pick)
    return wide.select(*entity, F.inline(F.array(*map(_worked, metrics))))


def placed(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """``values`` with ``place`` (one and how many are smaller), ``n``, ``low``, ``middle`` and ``high`` of its group; rows without a value keep nulls for a place.

    Distinct values are counted first and dealt to ranges; the totals of a group's ranges, one row each, say where each range begins, so a group of any size is many tasks' work.
    The middle of an even number is the mean of the two.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    dealt = stage(counts.repartitionByRange(*map(F.col, group), F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*group, "_range").agg(F.sum("_n").alias("_total"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    whole = Window.partitionBy(*group)
    starts = ranges.select(*group, "_range", (F.sum("_total").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")).alias("_begin"), F.sum("_total").over(whole).alias("n"), F.min("_low").over(whole).alias("low"), F.max("_high").over(whole).alias("high"))
    running = F.sum("_n").over(Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    at = stage(dealt.join(starts, [*group, "_range"]).withColumn("_before", F.col("_begin") + running), "places")
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))
    half = lambda i: F.max(F.when(holds(i), F.col(value)))
    middles = at.groupBy(*group).agg(F.max("n").alias("n"), F.max("low").alias("low"), ((half(F.floor((F.col("n") - 1) / 2)) + half(F.floor(F.col("n") / 2))) / 2).alias("middle"), F.max("high").alias("high"))
    places = at.select(*group, value, (F.col("_before") + 1).alias("place"))
    return values.join(places, [*group, value], "left").join(middles, group, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
