"""Schedules that feed each other: order, circles, reasons, cells, periods."""

import datetime

import pytest
from pyspark.sql import functions as F

from factspring.calc.rules import Input, Rule
from factspring.calc.schedules import Cell, Feed, Schedule, evaluated, from_cells, ordered, periods
from factspring.calc.units import RuleError

UP = [Rule("x", "a / b", "number", {"a": Input("own:a", "number"), "b": Input("own:b", "number")})]
DOWN = [Rule("y", "x + 1", "number", {"x": Input("fed:x", "number")})]


def test_four_deep_with_reasons_and_unrounded_feeds(spark):
    rows = spark.createDataFrame([(1, 10.0, 3.0), (2, 1.0, 0.0), (3, None, 1.0)], "k int, a double, b double")
    more = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    plan = {f"d{i}": Schedule(DOWN, more, feeds={"fed:x": Feed(f"d{i - 1}" if i else "u", "y" if i else "x")}) for i in (2, 0, 1)}
    plan["u"] = Schedule(UP, rows, {"own:a": (F.col("a"), "number"), "own:b": (F.col("b"), "number")})
    assert ordered(plan) == ["u", "d0", "d1", "d2"]
    out = {r.k: r for r in evaluated(plan, ["k"])["d2"].collect()}
    assert float(out[1].y) == 6.33 and out[1].y_blocked is None  # 10 / 3 + 3, not 3.33 + 3
    assert {out[k].y_blocked for k in (2, 3, 4)} == {"needs y of d1, which is blocked"} and out[2].y is None
    first = {r.k: r.y_blocked for r in evaluated(plan, ["k"])["d0"].collect()}
    assert first == {1: None, 2: "needs x of u, which is blocked", 3: "needs x of u, which is blocked", 4: "u has no such key"}


def test_circles_strangers_and_columns_without_reason_are_refused(spark):
    more = spark.range(1)
    loop = {n: Schedule(DOWN, more, feeds={"fed:x": Feed(o, "y")}) for n, o in (("a", "b"), ("b", "c"), ("c", "a"))}
    with pytest.raises(RuleError, match="circle: a, b, c"):
        ordered(loop)
    with pytest.raises(RuleError, match="no schedule"):
        ordered({"a": Schedule(DOWN, more, feeds={"fed:x": Feed("z", "y")})})
    with pytest.raises(RuleError, match="computes no z"):
        ordered({"a": Schedule(DOWN, more, feeds={"fed:x": Feed("b", "z")}), "b": Schedule(UP, more)})
    columns = {"a": Schedule(DOWN, more, column=True), "b": Schedule(DOWN, more, feeds={"fed:x": Feed("a", "y")}, column=True)}
    with pytest.raises(RuleError, match="without a reason"):
        ordered(columns)


def test_cells(spark):
    cells = spark.createDataFrame([(1, "A1", 2.0), (1, "A2", None), (2, "A1", 3.0), (2, "A1", 4.0), (2, "A2", 1.0), (3, "A9", 1.0), (4, "A1", 5.0), (4, "A1", 5.0)], "k int, at string, v double")
    frame, sources = from_cells(cells, ["k"], "at", "v", {"own:a": Cell("A1", "number"), "own:b": Cell("A2", "number", "nothing yet")})
    rule = Rule("x", "a + b", "number", {"a": Input("own:a", "number"), "b": Input("own:b", "number")})
    out = {r.k: (None if r.x is None else float(r.x), r.x_blocked) for r in evaluated({"s": Schedule([rule], frame, sources)}, ["k"])["s"].collect()}
    assert out == {1: (2.0, None), 2: (None, "cell A1 has two values"), 3: (None, "cell A1 is blank"), 4: (5.0, None)}


def test_periods(spark):
    day = lambda d: datetime.date(2024, 1, d)
    rows = spark.createDataFrame([(1, day(1)), (1, day(11)), (1, day(11)), (1, day(12)), (2, day(5))], "k int, d date")
    assert sorted((r.k, r["from"], r.to, r.days) for r in periods(rows, ["k"], "d").collect()) == [(1, day(1), day(10), 10), (1, day(11), day(11), 1)]
