"""Arithmetic that printed lines must keep, written as data: linear forms over one another, tolerances by unit, conventions.

All identities of all groups are read from one aggregation: a group becomes one row with a column for each line. Comparisons
are multiplied out, so that nothing is divided before it is judged and every decision is made in decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "decimal(18,4)"
FORM = "decimal(20,4)"
EACH = "/each"  # marks the categories of a line


@dataclass(frozen=True)
class Line:
    """A line of the tree. One that ``splits`` its parent another way is never added up into it."""

    code: str
    parent: str | None = None
    sign: int = 1
    splits: bool = False


@dataclass(frozen=True)
class Term:
    """``times`` a line, a line with its children in its place where it isn't printed, or the sum of its categories (``code/each``). A term not ``needed`` counts where it is there."""

    code: str
    times: int = 1
    needed: bool = True


@dataclass(frozen=True)
class Way:
    """``times * (sum of over) / (constant + sum of under)``, open to groups where ``where`` holds: SQL over the lines (as columns) and the conventions. Of ``over``, ``parts`` terms must be there."""

    what: str
    over: tuple[Term, ...]
    under: tuple[Term, ...] = ()
    times: int = 1
    constant: int = 0
    where: str = "true"
    parts: int = 1


@dataclass(frozen=True)
class Identity:
    """A printed line against the ways to reckon it. It holds if one open way agrees; ``hints`` are told, never passed, where none does."""

    name: str
    printed: str
    unit: str
    ways: tuple[Way, ...]
    hints: tuple[Way, ...] = ()
    severity: str = "blocking"


@dataclass(frozen=True)
class Tolerance:
    """The larger of an absolute amount for a unit and a share of what is expected."""

    absolute: dict[str, str] = field(default_factory=dict)
    relative: str = "0"


class _Lines:
    """Lines of a group read through the tree; lines with children stand in columns of their own, worked out once."""

    def __init__(self, lines: list[Line]):
        self.children: dict[str, list[Line]] = {}
        for line in lines:
            if line.parent is not None and not line.splits:
                self.children.setdefault(line.parent, []).append(line)
        self.known = {line.code for line in lines}

    def value(self, code: str) -> Column:
        """What is printed, else the signed sum of the children that have a value, null for none."""
        return F.col(f"_rolled {code}.value") if code in self.children else F.col(code)

    def used(self, code: str) -> Column:
        """Codes of the printed lines that ``value`` takes."""
        return F.col(f"_rolled {code}.used") if code in self.children else F.when(F.col(code).isNotNull(), F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))

    def rolled(self, wide: DataFrame) -> DataFrame:
        """``wide`` with a column for each line that has children, the deepest first."""
        depth = lambda code: 1 + max((depth(line.code) for line in self.children.get(code, [])), default=-1)
        for code in sorted(self.children, key=depth):
            below = self.children[code]
            own = F.col(code) if code in self.known else F.lit(None).cast(VALUE)
            total = reduce(lambda a, b: a + b, [F.coalesce(self.value(line.code), F.lit(0).cast(VALUE)) * line.sign for line in below])
            summed = F.when(F.coalesce(*[self.value(line.code) for line in below]).isNotNull(), total)
            used = F.when(own.isNotNull(), F.array(F.lit(code))).otherwise(F.concat(*[self.used(line.code) for line in below]))
            wide = wide.withColumn(f"_rolled {code}", F.struct(F.coalesce(own, summed).cast(FORM).alias("value"), used.alias("used")))
        return wide


def _form(tree: _Lines, terms: tuple[Term, ...], constant: int = 0) -> tuple[Column, Column]:
    """The sum of the terms, null where a needed one is missing, and how many are there."""
    values = [(t, tree.value(t.code)) for t in terms]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0).cast(VALUE)) * t.times for t, v in values], F.lit(constant).cast(VALUE))
    missing = reduce(lambda a, b: a | b, [v.isNull() for t, v in values if t.needed], F.lit(False))
    there = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for _, v in values], F.lit(0))
    return F.when(~missing, total).cast(FORM), there


def _judged(tree: _Lines, identity: Identity, way: Way, tolerance: Tolerance) -> Column:
    """``open, agrees, expected, what, lines`` of one way. Nothing divided by zero or less is open."""
    over, there = _form(tree, way.over)
    over = (over * way.times).cast(FORM)
    under, _ = _form(tree, way.under, way.constant) if way.under else (F.lit(1).cast(FORM), None)
    printed = F.col(identity.printed)
    absolute = F.lit(tolerance.absolute.get(identity.unit, "0")).cast("decimal(10,4)")
    room = F.greatest((under * absolute).cast("decimal(38,10)"), (F.abs(over) * F.lit(tolerance.relative).cast("decimal(8,6)")).cast("decimal(38,10)"))
    agrees = F.abs((printed * under).cast("decimal(38,8)") - over) <= room
    # a quotient is told to four places, a sum as it is
    expected = F.round(F.try_divide(over.cast("double"), under.cast("double")).cast("decimal(38,9)"), 4).cast(FORM) if way.under else over
    lines = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(identity.printed)), *[tree.used(t.code) for t in way.over + way.under])))
    is_open = F.coalesce(printed.isNotNull() & over.isNotNull() & (under > 0) & (there >= way.parts) & F.expr(way.where), F.lit(False))
    return F.struct(is_open.alias("open"), F.coalesce(agrees, F.lit(False)).alias("agrees"), expected.alias("expected"), F.lit(way.what).alias("what"), lines.alias("lines"))


def checked(values: DataFrame, group: list[str], lines: list[Line], identities: list[Identity], tolerance: Tolerance, conventions: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """``*group, identity, severity, holds, printed, expected, difference, what, hint, lines``: a row for each group and identity that can be evaluated.

    ``values`` has ``*group, line, category, value, ref``; of several figures for one line that of the smallest ``ref`` counts, null values and unknown
    lines are as if not printed, categories of a line are added up. ``conventions`` (a row for each ``by``, columns of any name) are what a way's ``where``
    reads; groups without a row have nulls. Where no open way agrees, the first open one is told, with the first hint that would agree.
    The aggregation combines before its shuffle, so a group of any size is one row of a column for each line.
    """
    categories = sorted({t.code for i in identities for w in i.ways + i.hints for t in w.over + w.under if t.code.endswith(EACH)})
    code, value = F.col("line"), F.col("value").cast(VALUE)
    alone = F.col("category").isNull() & F.col("value").isNotNull()
    one = [F.min(F.when(alone & (code == line.code), F.struct(F.col("ref"), value.alias("value")))).alias(line.code) for line in lines]
    each = [F.sum(F.when(F.col("category").isNotNull() & (code == c.removesuffix(EACH)), value)).cast(FORM).alias(c) for c in categories]
    wide = values.groupBy(*group).agg(*one, *each).select(*group, *[F.col(f"`{line.code}`.value").alias(line.code) for line in lines], *[F.col(f"`{c}`") for c in categories])
    if conventions is not None:
        wide = wide.join(conventions, by or group, "left")
    tree = _Lines(lines)
    wide = tree.rolled(wide)
    judged = lambda i, ways: F.filter(F.array(*[_judged(tree, i, w, tolerance) for w in ways]), lambda x: x["open"])
    # the ways of each identity are judged once, in columns that what is told of them is read from
    ways = {f"_ways {i.name}": judged(i, i.ways) for i in identities} | {f"_hints {i.name}": judged(i, i.hints) for i in identities if i.hints}
    wide = wide.select(*group, *[F.col(i.printed).alias(f"_printed {i.name}") for i in identities], *[c.alias(n) for n, c in ways.items()])
    results = []
    for i in identities:
        agreeing = F.filter(F.col(f"_ways {i.name}"), lambda x: x["agrees"])
        holds = F.size(agreeing) > 0
        told = F.coalesce(F.get(agreeing, F.lit(0)), F.get(F.col(f"_ways {i.name}"), F.lit(0)))
        hint = F.get(F.filter(F.col(f"_hints {i.name}"), lambda x: x["agrees"]), F.lit(0))["what"] if i.hints else F.lit(None).cast("string")
        results.append(F.struct(F.lit(i.name).alias("identity"), F.lit(i.severity).alias("severity"), holds.alias("holds"), F.col(f"_printed {i.name}").alias("printed"), told.alias("told"), F.when(~holds, hint).alias("hint")))
    rows = wide.select(*group, F.explode(F.filter(F.array(*results), lambda r: r["told"].isNotNull())).alias("r"))
    return rows.select(*group, "r.identity", "r.severity", "r.holds", "r.printed", "r.told.expected", (F.col("r.printed") - F.col("r.told.expected")).cast(FORM).alias("difference"), "r.told.what", "r.hint", "r.told.lines")


def tagged(values: DataFrame, group: list[str], checks: DataFrame) -> DataFrame:
    """``*group, line, category, ref, findings, blocking, tag`` of every value: how many failed identities took its line, how many of them block, and ``identity_failure`` where one does.

    Failed checks are counted for each line of a group before they meet the values, so no value is doubled; values of null groups have none.
    """
    name = F.when(F.col("category").isNull(), F.col("line")).otherwise(F.concat("line", F.lit(EACH)))
    failed = checks.where("not holds").select(*group, "severity", F.explode("lines").alias("_line"))
    counts = failed.groupBy(*group, "_line").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "blocking").alias("blocking"))
    out = values.withColumn("_line", name).join(counts, [*group, "_line"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*group, "line", "category", "ref", n("findings"), n("blocking"), F.when(F.col("blocking") > 0, "identity_failure").alias("tag"))
