"""Schedules that feed each other: tables of rows, of periods and of free cells, and columns computed from them.

A schedule is a set of rules over a table with a row for each key. Its inputs are its own columns, figures that other
schedules computed, or constants with a reason. Schedules are ordered once, on the driver; each then is one DataFrame
plan, staged where others read it, so that plans stay short however deep the feeds go. What is blocked upstream blocks what needs it, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage
from .formula import Typed
from .rules import Rule, RuleSet
from .units import RuleError, dimensions, scale


@dataclass(frozen=True)
class Feed:
    """A source that is the unrounded ``output`` of another schedule. ``why`` must be given where that is a column of the same kind: a year opening with what the one before closed with, say."""

    schedule: str
    output: str
    why: str = ""


@dataclass
class Schedule:
    """``frame`` has a row for each key; ``rows``, if there are rules per category, one for each key and category."""

    rules: list[Rule]
    frame: DataFrame
    sources: dict[str, tuple[Column, str] | Typed] = field(default_factory=dict)
    rows: DataFrame | None = None
    row_sources: dict[str, tuple[Column, str]] = field(default_factory=dict)
    feeds: dict[str, Feed] = field(default_factory=dict)
    fiscal_year: str = "FY2024-25"
    column: bool = False  # one of several that are computed alike, of another year or voice


def ordered(schedules: dict[str, Schedule]) -> list[str]:
    """Names so that each comes after those that feed it."""
    for name, s in schedules.items():
        for source, feed in s.feeds.items():
            if feed.schedule not in schedules:
                raise RuleError(f"{name}: {source} comes from {feed.schedule}, which is no schedule")
            if feed.output not in {r.output for r in schedules[feed.schedule].rules}:
                raise RuleError(f"{name}: {feed.schedule} computes no {feed.output}")
            if s.column and schedules[feed.schedule].column and not feed.why:
                raise RuleError(f"{name}: {source} comes from the column {feed.schedule} without a reason")
    out: list[str] = []
    while len(out) < len(schedules):
        ready = [n for n, s in schedules.items() if n not in out and all(f.schedule in out for f in s.feeds.values())]
        if not ready:
            raise RuleError(f"schedules feed each other in a circle: {', '.join(sorted(set(schedules) - set(out)))}")
        out += ready
    return out


def evaluated(schedules: dict[str, Schedule], keys: list[str], staged: Callable[[DataFrame, str], DataFrame] = stage) -> dict[str, DataFrame]:
    """Each schedule's ``keys``, and of each of its rules that isn't per category the rounded ``output`` and ``output_blocked``.

    A key that a feeding schedule hasn't got gets nothing from it, and is blocked where it needs that. Keys must be
    unique in every frame.
    """
    made: dict[str, DataFrame] = {}
    fed = {f.schedule for s in schedules.values() for f in s.feeds.values()}
    for name in ordered(schedules):
        s = schedules[name]
        frame, sources = s.frame, dict(s.sources)
        for i, (source, feed) in enumerate(s.feeds.items()):
            rule = next(r for r in schedules[feed.schedule].rules if r.output == feed.output)
            raw, why, there = f"fed{i}", f"fed{i}_blocked", f"fed{i}_there"
            given = made[feed.schedule].select(*keys, F.col(f"{feed.output}_raw").alias(raw), F.col(f"{feed.output}_blocked").alias(why), F.lit(True).alias(there))
            frame = frame.join(given, keys, "left")
            reason = F.when(F.col(there).isNull(), f"{feed.schedule} has no such key").when(F.col(why).isNotNull(), f"needs {feed.output} of {feed.schedule}, which is blocked")
            sources[source] = Typed(F.when(reason.isNull(), F.col(raw) * scale(rule.unit)), reason, dimensions(rule.unit))
        out = RuleSet(s.rules, s.fiscal_year).evaluate(frame, sources, keys, s.rows, s.row_sources, raw=True)
        wanted = [c for r in s.rules if not r.per for c in (r.output, f"{r.output}_raw", f"{r.output}_blocked")]
        out = out.select(*keys, *[c for c in dict.fromkeys(wanted) if c in out.columns])
        made[name] = staged(out, f"schedule-{name}") if name in fed else out
    return {n: df.select(*[c for c in df.columns if not c.endswith("_raw")]) for n, df in made.items()}


def periods(df: DataFrame, keys: list[str], start: str, end: Column | None = None) -> DataFrame:
    """Rows as periods of their key: ``from``, ``to`` and ``days``, both ends included. Without ``end`` a period lasts until the day before the next begins, and the last is dropped; of rows that begin on one day only the last lasts."""
    if end is None:
        end = F.date_sub(F.lead(F.to_date(start)).over(Window.partitionBy(*keys).orderBy(start)), 1)
    out = df.withColumn("from", F.to_date(start)).withColumn("to", end)
    return out.where("to is not null and to >= `from`").withColumn("days", F.datediff("to", "from") + 1)


@dataclass(frozen=True)
class Cell:
    """The address of an input; ``zero_why`` says why a blank counts as zero, else it blocks what needs it."""

    address: str
    unit: str
    zero_why: str = ""


def from_cells(cells: DataFrame, keys: list[str], address: str, value: str, named: dict[str, Cell]) -> tuple[DataFrame, dict[str, Typed]]:
    """A row for each key and the sources that its cells are: only the addresses named are read, in one pass. A cell given twice with unlike values blocks what needs it."""
    wanted = list(dict.fromkeys(c.address for c in named.values()))
    at = {a: f"cell{i}" for i, a in enumerate(wanted)}
    own = cells.where(F.col(address).isin(wanted)).select(*keys, F.col(address).alias("_at"), F.col(value).alias("_value"))
    each = lambda f, a: f(F.when(F.col("_at") == a, F.col("_value")))
    wide = own.groupBy(*keys).agg(*[c for a, n in at.items() for c in (each(F.min, a).alias(n), each(F.max, a).alias(f"{n}_most"))])
    frame = cells.select(*keys).distinct().join(wide, keys, "left")
    sources = {}
    for source, cell in named.items():
        n = at[cell.address]
        blank = F.lit(None) if cell.zero_why else F.when(F.col(n).isNull(), f"cell {cell.address} is blank")
        reason = F.coalesce(blank, F.when(F.col(n) != F.col(f"{n}_most"), f"cell {cell.address} has two values")).cast("string")
        exact = F.coalesce(F.col(n), F.lit(0)) if cell.zero_why else F.col(n)
        sources[source] = Typed(F.when(reason.isNull(), exact.cast("double") * scale(cell.unit)), reason, dimensions(cell.unit))
    return frame, sources


def against(computed: DataFrame, filed: DataFrame, keys: list[str], outputs: dict[str, str]) -> DataFrame:
    """``keys, output, computed, filed, status`` of each figure: ``match`` at the printed places, ``differs``, ``blocked`` (with the reason in ``note``), or ``not filed``."""
    both = computed.join(filed.select(*keys, *[F.col(c).alias(f"_filed_{o}") for o, c in outputs.items()]), keys, "left")
    rows = [
        F.struct(
            F.lit(o).alias("output"), F.col(o).cast("decimal(38,6)").alias("computed"), F.col(f"_filed_{o}").cast("decimal(38,6)").alias("filed"),
            F.when(F.col(f"{o}_blocked").isNotNull(), "blocked").when(F.col(f"_filed_{o}").isNull(), "not filed").when(F.col(o) == F.col(f"_filed_{o}"), "match").otherwise("differs").alias("status"), F.col(f"{o}_blocked").alias("note"),
        )
        for o in outputs
    ]
    return both.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
