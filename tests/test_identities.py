"""Identities: tolerances, roll-up, conventions, hints, figures marked."""

from decimal import Decimal

from factspring.catalogue import QUERIES
from factspring.plans.identities import ROOM, SEVEN, TREE
from factspring.quality.identities import checked, tagged

SF = "/root/testdata/sf0.001"
VALUES = "g string, ref int, line string, category string, value decimal(18,4)"


def values(spark, **groups):
    rows = [(g, i, *(line if isinstance(line, tuple) else (line, None)), None if v is None else Decimal(str(v))) for g, lines in groups.items() for i, (line, v) in enumerate(lines.items())]
    return spark.createDataFrame(rows, VALUES)


def results(spark, frame, conventions=None):
    known = spark.createDataFrame([(g, *c) for g, c in (conventions or {}).items()], "g string, inside string, subsidised string, lost_on string")
    return {(r.g, r.identity): r for r in checked(frame, ["g"], TREE, SEVEN, ROOM, known).collect()}


def test_roll_up_tolerance_and_missing_lines(spark):
    frame = values(
        spark,
        exact={"total": 100, "power": 60, "staff": 30, "repairs": 12, "recovered": 2, "power_fixed": 1},
        near={"total": "100.05", "power": 60, "om": 40, "staff": 7},
        far={"total": "100.06", "power": 60, "om": 40},
        one={"total": 100, "power": 60},
        null={"total": None, "power": 60, "om": 40},
        stranger={"total": 100, "power": 60, "om": 40, "lorries": 5},
    )
    out = results(spark, frame)
    assert {g: r.holds for (g, i), r in out.items() if i == "total"} == {"exact": True, "near": True, "far": False, "stranger": True}
    assert out["exact", "total"].lines == ["power", "recovered", "repairs", "staff", "total"] and out["near", "total"].lines == ["om", "power", "total"]
    assert out["far", "total"].difference == Decimal("0.06")


def test_conventions_and_hints(spark):
    lines = {"total": 100, "power": 60, "wires": 10, "om": 40}
    energy = {"sales": 90, "interstate": 10, "loss": 20, "input": 100}
    gap = {"requirement": 100, "revenue": 70, "subsidy": 10, "gap": 20}
    frame = values(spark, open={**lines, **energy, **gap}, stated={**lines, **energy, **gap}, wrong=gap)
    out = results(spark, frame, {"stated": ("wires", "after", "within"), "wrong": (None, "before", None)})
    assert {i: (r.holds, r.hint) for (g, i), r in out.items() if g == "open" and i != "requirement"} == {"total": (False, "power holds the wires"), "input": (False, "the loss is of sales within the state"), "gap": (True, None)}
    assert all(r.holds and r.hint is None for (g, _), r in out.items() if g == "stated")
    assert (out["wrong", "gap"].holds, out["wrong", "gap"].what, out["wrong", "gap"].expected) == (False, "requirement less revenue", 30)


def test_nothing_is_divided_by_nought_and_categories_add_up(spark):
    frame = values(spark, a={"requirement": 10, "sales": 0, "unit_cost": 1, "loss": 100, "input": 5}, b={"sales": 7, ("sales", "x"): 3, ("sales", "y"): 3}, c={"requirement": 10, "sales": 100, "unit_cost": "1.01"})
    out = results(spark, frame)
    assert set(out) == {("b", "sales"), ("c", "unit_cost")}
    assert (out["b", "sales"].holds, out["b", "sales"].expected, out["c", "unit_cost"].holds) == (False, 6, True)


def test_marks_and_repeats(spark):
    frame = values(spark, b={"sales": 7, ("sales", "x"): 3, ("sales", "y"): 3, "wires": 1}, c={"requirement": 10, "sales": 100, "unit_cost": "1.1"})
    known = spark.createDataFrame([], "g string, inside string, subsidised string, lost_on string")
    twice = frame.union(frame.selectExpr("g", "ref + 10", "line", "category", "case when category is null then value + 1 else 0 end"))
    checks = checked(twice, ["g"], TREE, SEVEN, ROOM, known)
    out = {(r.g, r.line, r.category): (r.findings, r.blocking, r.tag) for r in tagged(frame, ["g"], checks).collect()}
    assert out["b", "sales", None] == out["b", "sales", "x"] == (1, 1, "identity_failure") and out["b", "wires", None] == (0, 0, None)
    assert out["c", "unit_cost", None] == out["c", "sales", None] == (1, 0, None)
    assert checked(frame.limit(0), ["g"], TREE, SEVEN, ROOM, known).count() == 0


def test_the_table_has_every_outcome(spark):
    rows = QUERIES["identity_checks"](spark, SF).groupBy("identity").agg({"holds": "count"}).collect()
    assert {r.identity for r in rows} == {i.name for i in SEVEN}
    assert QUERIES["identity_checks"](spark, SF).where("hint is not null").count() > 0
