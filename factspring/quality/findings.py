"""Validators: each gives a frame of findings of one shape, so that they union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, validator: str, severity: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), message.alias("message"))


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def types_hold(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """A finding for each row and rule (name: SQL condition) that doesn't hold or is null, in one pass."""
    failed = F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(name)) for name, c in rules.items()])
    bad = df.select(F.col(key), F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("rule"))
    return findings(bad, "types", "error", F.col(key), F.col("rule"))


def one_unit(df: DataFrame, group: list[str], unit: str) -> DataFrame:
    g = df.groupBy(*group).agg(F.count_distinct(unit).alias("n")).where("n > 1")
    return findings(g, "unit_consistency", "warning", F.concat_ws("|", *group), F.concat(F.col("n").cast("string"), F.lit(" units")))


def conflicting_duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1")
    return findings(g, "conflicting_duplicates", "error", F.concat_ws("|", *keys), F.concat(F.col("n").cast("string"), F.lit(" values")))


def plausible(df: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    return findings(df.where(~F.col(value).between(low, high)), "plausibility", "warning", F.col(key), F.lit("outside the plausible range"))


def day_covered(bands: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Bands in minutes must fill the day; a band may pass midnight, equal ends are a whole day."""
    length = F.when(F.col(start) == F.col(end), 1440).otherwise((F.col(end) - F.col(start) + 1440) % 1440)
    g = bands.groupBy(key).agg(F.sum(length).alias("minutes")).where("minutes <> 1440")
    return findings(g, "time_bands", "error", F.col(key), F.concat(F.col("minutes").cast("string"), F.lit(" of 1440 minutes")))


def exists_in(df: DataFrame, key: str, cited: DataFrame, cited_key: str, what: str) -> DataFrame:
    return findings(df.join(cited.select(F.col(cited_key).alias("_cited")).distinct(), F.col(key) == F.col("_cited"), "left_anti"), "evidence", "error", F.col(key), F.lit(f"no such {what}"))


def option_groups(df: DataFrame, category: str, alternative: str) -> DataFrame:
    """Groups of alternatives: one alone is blocking, several are told, since no default can be published."""
    g = df.where(F.col(alternative).isNotNull()).groupBy(category).agg(F.count_distinct(alternative).alias("n"))
    return g.select(F.lit("option_groups").alias("validator"), F.when(F.col("n") < 2, "blocking").otherwise("info").alias("severity"), F.col(category).cast("string").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" alternatives")).alias("message"))


def roles_apart(df: DataFrame, cell: list[str], role: str) -> DataFrame:
    """A cell cited in more than one role."""
    g = df.groupBy(*cell).agg(F.count_distinct(role).alias("n")).where("n > 1")
    return findings(g, "role_separation", "blocking", F.concat_ws("|", *cell), F.concat(F.col("n").cast("string"), F.lit(" roles")))


def priced_per(df: DataFrame, key: Column, component: str, unit: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """A component priced per a unit that it can't be; components without an entry are let be."""
    units = F.element_at(F.create_map(*[x for c, u in allowed.items() for x in (F.lit(c), F.array(*map(F.lit, u)))]), F.col(component))
    return findings(df.where(~F.array_contains(units, F.col(unit))), "component_units", "blocking", key, F.concat(F.col(component), F.lit(" priced per "), F.col(unit)))


def recomputed(df: DataFrame, key: Column, printed: str, computed: Column, places: int) -> DataFrame:
    """A printed result more than one unit of its last place from its own inputs; one that can't be computed is a warning."""
    off = df.withColumn("_c", computed).where(F.col("_c").isNull() | (F.abs(F.col("_c") - F.col(printed)) > 10**-places))
    return off.select(F.lit("derivation").alias("validator"), F.when(F.col("_c").isNull(), "warning").otherwise("blocking").alias("severity"), key.cast("string").alias("key"), F.when(F.col("_c").isNull(), "inputs incomplete").otherwise("the inputs give another figure").alias("message"))


def families_complete(df: DataFrame, scope: str, family: str, required: list[str], disposed: DataFrame) -> DataFrame:
    """Required families that a scope has no candidate of and no disposition for (``disposed``: scope, family)."""
    wanted = df.select(scope).distinct().select(scope, F.explode(F.array(*map(F.lit, required))).alias(family))
    missing = wanted.join(df.select(scope, family).distinct(), [scope, family], "left_anti").join(disposed, [scope, family], "left_anti")
    return findings(missing, "completeness", "blocking", F.concat_ws("|", scope, family), F.lit("no candidate and no disposition"))
