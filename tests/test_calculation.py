import pytest
from pyspark.sql import functions as F

from factspring.calc.formula import names, parse
from factspring.calc.projection import Line, project, shift, years
from factspring.calc.rules import Input, Rule, RuleSet
from factspring.calc.units import RuleError


def run(spark, rules, rows, sources, year="FY2024-25"):
    schema = ", ".join(f"{c} double" for c in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return RuleSet(rules, year).evaluate(df, {s: (F.col(c), u) for s, (c, u) in sources.items()}).collect()


def test_crore_over_million_units_is_rupees_per_unit_without_a_factor(spark):
    rule = Rule("rate", "cost / energy", "INR_per_kWh", {"cost": Input("fact:c", "INR_crore"), "energy": Input("fact:e", "MU")})
    rows = run(spark, [rule], [{"c": 120.0, "e": 300.0}, {"c": 1.0, "e": 0.0}, {"c": 1.0, "e": None}], {"fact:c": ("c", "INR_crore"), "fact:e": ("e", "MU")})
    assert [float(r.rate) if r.rate is not None else r.rate_blocked for r in rows] == [4.0, "division by zero", "input energy (fact:e) has no value"]


@pytest.mark.parametrize("formula", ["a + b", "min(a, b)", "ifneg(a, a, b)", "root(a, 2)"])
def test_dimensions_are_checked_before_any_row(spark, formula):
    inputs = {n: Input(f"fact:{n}", u) for n, u in (("a", "INR"), ("b", "kWh")) if n in names(parse(formula))}
    with pytest.raises(RuleError):
        run(spark, [Rule("x", formula, "INR", inputs)], [{"a": 1.0, "b": 1.0}], {"fact:a": ("a", "INR"), "fact:b": ("b", "kWh")})


@pytest.mark.parametrize("formula", ["a.b", "a[0]", "a > b", "a ** 2", "a if b else c", "f(a)", "max(a", "", "a b", "sum(x=1)"])
def test_other_syntax_is_refused(formula):
    with pytest.raises(RuleError):
        parse(formula)


def test_functions_and_precedence(spark):
    given = {k: Input(f"fact:{k}", "number") for k in "ab"}
    rules = [Rule("p", "-a + b * 2 - b / 4", "number", given, places=4), Rule("q", "avg(a, b, 3) + min(a, b) - max(a, b) + sum(a, b)", "number", given, places=4), Rule("r", "root(b / a, 2) - 1", "number", given, places=4), Rule("s", "ifneg(a - b, a, b)", "number", given, places=4)]
    row = run(spark, rules, [{"a": 2.0, "b": 8.0}], {"fact:a": ("a", "number"), "fact:b": ("b", "number")})[0]
    assert [float(row[c]) for c in "pqrs"] == [12.0, 8.3333, 1.0, 2.0]


def test_selection_order_and_circles(spark):
    one = {"a": Input("fact:a", "number")}
    old, new = Rule("x", "a", "number", one, id="x", version=1), Rule("x", "a * 2", "number", one, id="x", version=2, from_fy="FY2024-25")
    sources = {"fact:a": ("a", "number")}
    assert float(run(spark, [old, new], [{"a": 3.0}], sources)[0].x) == 6
    assert float(run(spark, [old, new], [{"a": 3.0}], sources, "FY2020-21")[0].x) == 3
    with pytest.raises(RuleError, match="both apply"):
        RuleSet([old, Rule("x", "a", "number", one, id="y")], "FY2024-25")
    with pytest.raises(RuleError, match="circle"):
        RuleSet([Rule("x", "y", "number", {"y": Input("rule:y", "number")}), Rule("y", "x", "number", {"x": Input("rule:x", "number")})], "FY2024-25")


def test_blocked_propagates_and_rounding_feeds_when_asked(spark):
    rules = [Rule("x", "a / 3", "number", {"a": Input("fact:a", "number")}, feeds="rounded"), Rule("y", "x * 300", "number", {"x": Input("rule:x", "number")}, places=3)]
    rows = run(spark, rules, [{"a": 1.0}, {"a": None}], {"fact:a": ("a", "number")})
    assert float(rows[0].y) == 99.0 and rows[1].y is None and rows[1].y_blocked == "needs x, which is blocked"


def test_half_even_and_half_up(spark):
    one = {"a": Input("fact:a", "number")}
    row = run(spark, [Rule("u", "a", "number", one), Rule("e", "a", "number", one, mode="half_even")], [{"a": 2.125}], {"fact:a": ("a", "number")})[0]
    assert (float(row.u), float(row.e)) == (2.13, 2.12)


def test_years():
    assert shift("FY1999-00", 1) == "FY2000-01" and years("FY1998-99", "FY2000-01") == ["FY1999-00", "FY2000-01"]
    with pytest.raises(ValueError):
        years("FY2000-01", "FY2000-01")


def test_projection_feeds_rounded_values_and_blocks(spark):
    df = spark.createDataFrame([(100.0, 10.0), (None, 10.0)], "a double, s double")
    lines = [Line("om", "escalate", rate="r"), Line("s", "carry_forward"), Line("c", "acos", ("om", "s"))]
    rows = project(df, lines, "FY2023-24", "FY2025-26", {"om": F.col("a"), "s": F.col("s")}, {("r", ""): F.lit(3.333)}).collect()
    assert [float(rows[0][c]) for c in ("om_2024", "om_2025", "c_2025")] == [103.33, 106.77, 106.77]
    assert rows[1].om_2024_blocked == "no base figure for om" and rows[1].c_2025_blocked == "input blocked: om FY2025-26"
