"""The formula language, compiled to Spark columns.

A formula becomes a value column and a reason column; dimensions are checked while compiling, so no row carries units.
The value is null exactly where the reason says why: an input without a value, a division by zero, a negative root.
Values are doubles in base units; results are rounded as decimals at the end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import PURE, Exponents, RuleError, product, spelled

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[-+*/(),]))")
FUNCTIONS = ("avg", "min", "max", "sum", "ifneg", "root")


@dataclass(frozen=True)
class Node:
    kind: str  # number, name, call, or an operator; "neg" for a sign
    text: str = ""
    args: tuple[Node, ...] = ()


def parse(formula: str) -> Node:
    """A tree of numbers, names, + - * /, signs, parentheses and the functions; anything else is refused."""
    tokens, at = [], 0
    while formula[at:].strip():
        found = _TOKEN.match(formula, at)
        if not found:
            raise RuleError(f"formula: unexpected {formula[at:].strip()[:10]!r}")
        tokens.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    tokens.append(("end", ""))
    pos = 0

    def take(mark: str = "") -> tuple[str, str]:
        nonlocal pos
        if mark and tokens[pos][1] != mark:
            raise RuleError(f"formula: expected {mark!r}, found {tokens[pos][1] or 'the end'!r}")
        pos += 1
        return tokens[pos - 1]

    def atom() -> Node:
        kind, text = take()
        if kind == "number":
            return Node("number", text)
        if kind == "name" and tokens[pos][1] == "(":
            if text not in FUNCTIONS:
                raise RuleError(f"formula: no function {text}")
            take("(")
            args = [level(0)]
            while tokens[pos][1] == ",":
                take(",")
                args.append(level(0))
            take(")")
            return Node("call", text, tuple(args))
        if kind == "name":
            return Node("name", text)
        if text == "-":
            return Node("neg", "", (atom(),))
        if text == "(":
            inner = level(0)
            take(")")
            return inner
        raise RuleError(f"formula: unexpected {text or 'end'!r}")

    def level(least: int) -> Node:
        node = atom()
        while (power := {"+": 1, "-": 1, "*": 2, "/": 2}.get(tokens[pos][1], 0)) > least:
            mark = take()[1]
            node = Node(mark, "", (node, level(power)))
        return node

    tree = level(0)
    if tokens[pos][0] != "end":
        raise RuleError(f"formula: unexpected {tokens[pos][1]!r}")
    return tree


def names(tree: Node) -> set[str]:
    return {tree.text} if tree.kind == "name" else set().union(*(names(a) for a in tree.args)) if tree.args else set()


@dataclass(frozen=True)
class Typed:
    """A value in base units, why it is missing (null where it isn't), and its dimensions."""

    value: Column
    reason: Column
    dims: Exponents


def constant(number: float, dims: Exponents = PURE) -> Typed:
    return Typed(F.lit(float(number)), F.lit(None).cast("string"), dims)


def _guarded(value: Column, reason: Column, dims: Exponents) -> Typed:
    return Typed(F.when(reason.isNull(), value), reason, dims)


def compiled(tree: Node, given: dict[str, Typed]) -> Typed:
    if tree.kind == "number":
        return constant(float(tree.text))
    if tree.kind == "name":
        if tree.text not in given:
            raise RuleError(f"formula: {tree.text} is not an input")
        return given[tree.text]
    if tree.kind == "call" and tree.text == "root":
        if len(tree.args) != 2 or tree.args[1].kind != "number" or not tree.args[1].text.isdigit() or int(tree.args[1].text) == 0:
            raise RuleError("root(x, n): n must be a whole number above zero")
        x = compiled(tree.args[0], given)
        if any(x.dims):
            raise RuleError(f"root of {spelled(x.dims)}")
        return _guarded(F.pow(x.value, F.lit(1.0 / int(tree.args[1].text))), F.coalesce(x.reason, F.when(x.value < 0, F.lit("root() of a negative number"))), PURE)
    args = [compiled(a, given) for a in tree.args]
    reason = F.coalesce(*(a.reason for a in args)) if len(args) > 1 else args[0].reason
    if tree.kind == "neg":
        return Typed(-args[0].value, reason, args[0].dims)
    if tree.kind in "*/":
        a, b = args
        if tree.kind == "*":
            return _guarded(a.value * b.value, reason, product(a.dims, b.dims))
        return _guarded(F.try_divide(a.value, b.value), F.coalesce(reason, F.when(b.value == 0, F.lit("division by zero"))), product(a.dims, b.dims, -1))
    same = args[1:] if tree.kind == "call" and tree.text == "ifneg" else args
    if any(x.dims != same[0].dims for x in same):
        raise RuleError(f"{tree.text or tree.kind}: {', '.join(spelled(x.dims) for x in same)}")
    values = [a.value for a in args]
    if tree.kind in "+-":
        return _guarded(values[0] + values[1] if tree.kind == "+" else values[0] - values[1], reason, args[0].dims)
    if tree.text == "ifneg":
        if len(args) != 3:
            raise RuleError("ifneg(test, then, otherwise)")
        return _guarded(F.when(values[0] < 0, values[1]).otherwise(values[2]), reason, args[1].dims)
    total = values[0]
    for v in values[1:]:
        total = total + v
    made = {"sum": total, "avg": total / len(values), "min": F.least(*values) if len(values) > 1 else values[0], "max": F.greatest(*values) if len(values) > 1 else values[0]}[tree.text]
    return _guarded(made, reason, args[0].dims)  # least and greatest skip nulls; the reason doesn't
