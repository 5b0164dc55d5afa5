"""Rules as data: selection for a year, order of computation, evaluation over a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formula import Node, Typed, compiled, constant, names, parse
from .units import RuleError, dimensions, scale, spelled


@dataclass(frozen=True)
class Input:
    """Where an input comes from: ``rule:x``, ``sum:x``, ``regulation`` (with ``value``), or any other source string."""

    source: str
    unit: str
    value: float | None = None


@dataclass(frozen=True)
class Rule:
    output: str
    formula: str
    unit: str
    inputs: dict[str, Input] = field(default_factory=dict)
    id: str = ""
    version: int = 1
    places: int = 2
    mode: str = "half_up"
    feeds: str = "unrounded"
    per: str | None = None
    from_fy: str = ""
    to_fy: str = "FY9999"


def rounded(value: Column, rule: Rule) -> Column:
    exact = value.cast("decimal(38,9)")
    return (F.round if rule.mode == "half_up" else F.bround)(exact, rule.places).cast(f"decimal(38,{rule.places})")


def check(rule: Rule) -> Node:
    """The parsed formula of a rule whose names are its inputs and whose dimensions come out as its unit's."""
    tree = parse(rule.formula)
    if names(tree) != set(rule.inputs):
        raise RuleError(f"{rule.output}: the formula names {sorted(names(tree))}, the inputs are {sorted(rule.inputs)}")
    return tree


class RuleSet:
    """The rules of one fiscal year in an order in which each follows what it needs."""

    def __init__(self, rules: list[Rule], fiscal_year: str):
        chosen: dict[str, Rule] = {}
        for rule in rules:
            if not rule.from_fy <= fiscal_year <= rule.to_fy:
                continue
            other = chosen.get(rule.output)
            if other and other.id != rule.id:
                raise RuleError(f"{rule.output}: {other.id or 'a rule'} and {rule.id or 'another'} both apply in {fiscal_year}")
            if not other or rule.version > other.version:
                chosen[rule.output] = rule
        self.trees = {o: check(r) for o, r in chosen.items()}
        self.rules = self._ordered(chosen)

    @staticmethod
    def _needs(rule: Rule) -> list[tuple[str, str]]:
        return [tuple(i.source.split(":", 1)) for i in rule.inputs.values() if i.source.startswith(("rule:", "sum:"))]

    def _ordered(self, rules: dict[str, Rule]) -> list[Rule]:
        for r in rules.values():
            for kind, other in self._needs(r):
                if other not in rules:
                    raise RuleError(f"{r.output} needs {other}, which no rule makes")
                if (kind == "sum") != bool(rules[other].per and not r.per):
                    raise RuleError(f"{r.output}: {kind}:{other} crosses categories the wrong way")
        out, left = [], dict(rules)
        while left:
            ready = [o for o, r in left.items() if not any(n in left for _, n in self._needs(r))]
            if not ready:
                raise RuleError(f"rules need each other in a circle: {', '.join(sorted(left))}")
            out += [left.pop(o) for o in sorted(ready)]
        return out

    def _inputs(self, rule: Rule, sources: dict[str, tuple[Column, str]], made: dict[str, Typed]) -> dict[str, Typed]:
        given = {}
        for name, i in rule.inputs.items():
            kind, _, other = i.source.partition(":")
            if i.source == "regulation":
                typed = constant(i.value * scale(i.unit), dimensions(i.unit))
            elif kind in ("rule", "sum"):
                typed = made[other]
                typed = Typed(typed.value, F.when(typed.reason.isNotNull(), F.lit(f"needs {other}, which is blocked")), typed.dims)
            elif isinstance(sources.get(i.source), Typed):
                typed = sources[i.source]
            elif i.source in sources:
                column, unit = sources[i.source]
                value = column.cast("double") * scale(unit)
                typed = Typed(value, F.when(value.isNull(), F.lit(f"input {name} ({i.source}) has no value")), dimensions(unit))
            else:
                typed = Typed(F.lit(None).cast("double"), F.lit(f"input {name} ({i.source}) has no value"), dimensions(i.unit))
            if typed.dims != dimensions(i.unit):
                raise RuleError(f"{rule.output}: input {name} is {spelled(typed.dims)}, not {i.unit}")
            given[name] = typed
        return given

    def _columns(self, df: DataFrame, rules: list[Rule], sources: dict[str, tuple[Column, str]], made: dict[str, Typed]) -> DataFrame:
        for rule in rules:
            if f"rule:{rule.output}" in sources:
                column, unit = sources[f"rule:{rule.output}"]
                value = column.cast("double") * scale(unit)
                typed = Typed(value, F.when(value.isNull(), F.lit("given without a value")), dimensions(unit))
            else:
                typed = compiled(self.trees[rule.output], self._inputs(rule, sources, made))
            if typed.dims != dimensions(rule.unit):
                raise RuleError(f"{rule.output}: {spelled(typed.dims)} is not {rule.unit}")
            out, raw, why = rule.output, f"_{rule.output}", f"{rule.output}_blocked"
            df = df.withColumns({raw: typed.value / scale(rule.unit), why: typed.reason})
            df = df.withColumn(out, rounded(F.col(raw), rule))
            feeding = F.col(out).cast("double") if rule.feeds == "rounded" else F.col(raw)
            made[out] = Typed(feeding * scale(rule.unit), F.col(why), typed.dims)
        return df

    def evaluate(self, df: DataFrame, sources: dict[str, tuple[Column, str]], keys: list[str] | None = None, categories: DataFrame | None = None, category_sources: dict[str, tuple[Column, str]] | None = None, raw: bool = False) -> DataFrame:
        """``df`` with, for each rule, its rounded ``output`` and ``output_blocked`` (the reason, or null).

        ``sources`` maps source strings to columns of ``df`` and their units. Rules ``per`` a category are computed
        over ``categories``, a table with the ``keys`` of ``df`` and a row for each category; ``sum:`` adds their
        unrounded values and is blocked if a category is, or if there is none. A source may also be ``Typed``, with a
        reason of its own. With ``raw`` each output also comes unrounded, as ``output_raw``.
        """
        per = [r for r in self.rules if r.per]
        made: dict[str, Typed] = {}
        if per:
            table = self._columns(categories, per, category_sources or {}, {})
            sums = [c for r in per for c in (F.sum(f"_{r.output}").alias(f"_{r.output}_sum"), F.count(f"{r.output}_blocked").alias(f"_{r.output}_stopped"))]
            df = df.join(table.groupBy(*keys).agg(*sums), keys, "left")
            for r in per:
                reason = F.when((F.coalesce(F.col(f"_{r.output}_stopped"), F.lit(1)) > 0), F.lit("a category is blocked or none is given"))
                made[r.output] = Typed(F.when(reason.isNull(), F.col(f"_{r.output}_sum") * scale(r.unit)), reason, dimensions(r.unit))
        single = [r for r in self.rules if not r.per]
        out = self._columns(df, single, sources, made)
        if raw:
            out = out.withColumns({f"{r.output}_raw": F.col(f"_{r.output}") for r in single})
        return out.drop(*[c for c in out.columns if c.startswith("_")])
