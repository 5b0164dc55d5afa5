"""Roll-ups over a tree of lines: a printed figure counts as it stands, others are the signed sum of their children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_up(lines: DataFrame, depth: int) -> DataFrame:
    """``code, value, how`` of lines ``(code, parent, level, sign, printed)``, level 0 at the root.

    Levels are closed lists, so they are folded from the deepest up, one aggregation each. A line without a printed
    figure and without any valued child has no value.
    """
    done = None
    below = None
    for level in range(depth, -1, -1):
        own = lines.where(F.col("level") == level)
        if below is not None:
            sums = below.where("value is not null").groupBy(F.col("parent").alias("code")).agg(F.sum(F.col("value") * F.col("sign")).alias("children"))
            own = own.join(sums, "code", "left")
        else:
            own = own.withColumn("children", F.lit(None).cast("decimal(38,2)"))
        own = own.withColumn("value", F.coalesce(F.col("printed").cast("decimal(38,2)"), F.col("children").cast("decimal(38,2)")))
        own = own.withColumn("how", F.when(F.col("printed").isNotNull(), "printed").when(F.col("children").isNotNull(), "summed").otherwise("missing"))
        out = own.select("code", "value", "how")
        done = out if done is None else done.unionByName(out)
        below = own.select("parent", "value", "sign")
    return done
