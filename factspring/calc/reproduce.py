"""Filed figures computed again: rows of a sheet bound to a rule set's inputs and outputs, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import RuleSet


def reproduce(cells: DataFrame, rules: RuleSet, inputs: dict[str, tuple[str, str]], outputs: dict[str, str], keys: list[str]) -> DataFrame:
    """``keys, output, filed, computed, result`` for each bound output of each column of a sheet.

    ``cells`` is long: ``keys`` (sheet, fiscal year, ...), ``row``, ``value`` (decimal) and ``places`` printed.
    ``inputs`` binds a rule source to a row and its unit, ``outputs`` a rule's output to the row that prints it. A
    figure is reproduced if it is equal at the printed places; ``blocked`` gives the rule's reason.
    """
    needed = sorted({row for row, _ in inputs.values()} | set(outputs.values()))
    wide = cells.where(F.col("row").isin(needed)).groupBy(*keys).agg(*[F.max(F.when(F.col("row") == r, F.col(c))).alias(f"in_{c}_{i}") for i, r in enumerate(needed) for c in ("value", "places")])
    at = {r: i for i, r in enumerate(needed)}
    made = rules.evaluate(wide, {source: (F.col(f"in_value_{at[row]}"), unit) for source, (row, unit) in inputs.items()})
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.col(f"in_value_{at[r]}").alias("filed"), F.col(f"in_places_{at[r]}").alias("places"), F.col(o).cast("decimal(38,9)").alias("computed"), F.col(f"{o}_blocked").alias("blocked")) for o, r in outputs.items()]))
    out = made.select(*keys, rows.alias("c")).select(*keys, "c.*")
    unit = F.pow(F.lit(10.0), -F.coalesce("places", F.lit(0)))
    same = F.abs(F.round(F.col("computed").cast("double") / unit, 0) - F.round(F.col("filed").cast("double") / unit, 0)) < 0.5
    result = F.when(F.col("filed").isNull(), "not filed").when(F.col("blocked").isNotNull(), F.concat(F.lit("blocked: "), "blocked")).when(same, "reproduced").otherwise("differs")
    return out.select(*keys, "output", "filed", F.round("computed", 4).alias("computed"), result.alias("result"))
