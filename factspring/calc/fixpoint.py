"""Filling of bound cells from other cells until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stage

PASSES = 12


def fill(cells: DataFrame, terms: DataFrame, passes: int = PASSES) -> tuple[DataFrame, int]:
    """``cells (cell, value)`` with each bound cell set to the sum of its ``terms (cell, source, weight)``, and the passes taken.

    A bound cell with a term that has no value stays empty. A pass recomputes only cells that read one changed by
    the pass before; the table is written after each. What still changes after the last pass is an error.
    """
    terms = stage(terms, "terms")
    bound = terms.select("cell").distinct()
    cells = stage(cells.join(bound.withColumn("bound", F.lit(True)), "cell", "full_outer").select("cell", F.when(F.col("bound").isNull(), F.col("value")).alias("value")), "cells")
    dirty = terms
    for number in range(1, passes + 1):
        read = dirty.join(cells.select(F.col("cell").alias("source"), F.col("value").alias("given")), "source", "left")
        made = read.groupBy("cell").agg(F.when(F.count("given") == F.count("*"), F.sum(F.col("given") * F.col("weight"))).alias("new"))
        changed = cells.join(made, "cell").where(~F.col("value").eqNullSafe(F.col("new").cast(cells.schema["value"].dataType)))
        changed = stage(changed.select("cell", F.col("new").cast(cells.schema["value"].dataType).alias("new")), "changed")
        if not changed.limit(1).count():
            return cells, number
        cells = stage(cells.join(changed.withColumn("came", F.lit(True)), "cell", "left").select("cell", F.when(F.col("came"), F.col("new")).otherwise(F.col("value")).alias("value")), "cells")
        dirty = terms.join(terms.join(changed.select(F.col("cell").alias("source")), "source", "left_semi").select("cell").distinct(), "cell", "left_semi")
    raise RuntimeError(f"cells still change after {passes} passes")
