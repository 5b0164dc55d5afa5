"""Schedules over the driver's tables: rows, periods, free cells, and a chain of years that they feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..calc.rules import Input, Rule
from ..calc.schedules import Cell, Feed, Schedule, against, evaluated, from_cells, periods
from ..registry import query
from ..sources.catalog import table

PURCHASE = [
    Rule("bill", "energy * rate", "INR", {"energy": Input("row:energy", "kWh"), "rate": Input("row:rate", "INR_per_kWh")}, id="bill", per="source"),
    Rule("bought", "part", "kWh", {"part": Input("row:energy", "kWh")}, id="bought", per="source"),
    Rule("purchase", "all", "INR_lakh", {"all": Input("sum:bill", "INR")}, id="purchase", places=4),
    Rule("average", "cost / energy", "INR_per_kWh", {"cost": Input("rule:purchase", "INR_lakh"), "energy": Input("sum:bought", "kWh")}, id="average", places=4),
]
INTEREST = [
    Rule("part", "sum_due * share * days / 365", "INR", {"sum_due": Input("row:due", "INR"), "share": Input("row:share", "fraction"), "days": Input("row:days", "number")}, id="part", per="period"),
    Rule("interest", "all", "INR_lakh", {"all": Input("sum:part", "INR")}, id="interest", places=4),
]
BASE_YEAR = [
    Rule("base", "avg(a, b, c)", "INR_lakh", {"a": Input("cell:a", "INR_lakh"), "b": Input("cell:b", "INR_lakh"), "c": Input("cell:c", "INR_lakh")}, id="base", places=4),
    Rule("escalated", "base * (1 + growth)", "INR_lakh", {"base": Input("rule:base", "INR_lakh"), "growth": Input("regulation", "percent", 6.5)}, id="escalated", places=4),
]
CELLS = {"cell:a": Cell("C1", "INR_lakh"), "cell:b": Cell("C2", "INR_lakh"), "cell:c": Cell("C3", "INR_lakh", "not incurred in the first year")}


def _sources(spark, sf_dir, year: int | None = None) -> DataFrame:
    """Each supplier of each nation as a source of power: what it sold, at its mean rate; the rate of one in fifty-three isn't stated."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if year is None else lines.where(F.year("l_shipdate") == year)
    each = lines.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    rows = each.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rate = F.expr("case when s_suppkey % 53 <> 7 then cast(p as double) / cast(q as double) end")
    return rows.select("s_nationkey", "s_suppkey", F.col("q").cast("double").alias("energy"), rate.alias("rate"))


def _nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))


_SOURCES = """(SELECT s_nationkey, s_suppkey, y, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS energy, CASE WHEN s_suppkey % 53 <> 7 THEN sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE END AS rate
  FROM (SELECT *, {year} AS y FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, s_suppkey, y)"""
_STOPPED = "a category is blocked or none is given"


def _purchase(spark, sf_dir, year=None) -> Schedule:
    return Schedule(PURCHASE, _nations(spark, sf_dir), {}, _sources(spark, sf_dir, year), {"row:energy": (F.col("energy"), "kWh"), "row:rate": (F.col("rate"), "INR_per_kWh")})


@query("schedule_rows", f"""WITH r AS {_SOURCES.format(year="0")}, t AS (SELECT s_nationkey, sum(energy * rate) AS cost, sum(energy) AS energy, count(*) > count(rate) AS stopped FROM r GROUP BY s_nationkey),
f AS (SELECT n_nationkey AS s_nationkey, cost, energy, CASE WHEN coalesce(stopped, true) THEN 'x' END AS why, round((cost / 1e5)::DECIMAL(38,9), 2) AS filed FROM nation LEFT JOIN t ON n_nationkey = t.s_nationkey)
SELECT s_nationkey, 'purchase' AS output, CASE WHEN why IS NULL THEN round((cost / 1e5)::DECIMAL(38,9), 4)::DECIMAL(38,6) END AS computed, filed::DECIMAL(38,6) AS filed,
  CASE WHEN why IS NOT NULL THEN 'blocked' WHEN round((cost / 1e5)::DECIMAL(38,9), 4) = filed THEN 'match' ELSE 'differs' END AS status, CASE WHEN why IS NOT NULL THEN 'needs bill, which is blocked' END AS note FROM f
UNION ALL SELECT s_nationkey, 'average', CASE WHEN why IS NULL THEN round((cost / energy)::DECIMAL(38,9), 4)::DECIMAL(38,6) END, NULL, CASE WHEN why IS NOT NULL THEN 'blocked' ELSE 'not filed' END, CASE WHEN why IS NOT NULL THEN 'needs purchase, which is blocked' END FROM f""")
def schedule_rows(spark, sf_dir) -> DataFrame:
    """A table whose rows are sources of power, summed and averaged for each nation, against what is filed to two places."""
    out = evaluated({"purchase": _purchase(spark, sf_dir)}, ["s_nationkey"])["purchase"]
    filed = _sources(spark, sf_dir).groupBy("s_nationkey").agg(F.round((F.sum(F.col("energy") * F.col("rate")) / 1e5).cast("decimal(38,9)"), 2).alias("filed")).withColumn("none", F.lit(None).cast("double"))
    return against(out, filed, ["s_nationkey"], {"purchase": "filed", "average": "none"})


def _periods(spark, sf_dir, key: str = "o_custkey") -> DataFrame:
    """Each customer's orders as periods until its next order."""
    return periods(table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("due")), ["o_custkey"], "day")


_PERIODS = """(SELECT * FROM (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS due, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) - o_orderdate::DATE AS days FROM orders GROUP BY o_custkey, o_orderdate::DATE) WHERE days IS NOT NULL)"""
_SHARE = "(8 + year({day}) % 3) / 100.0"


@query("schedule_periods", f"""WITH p AS {_PERIODS} SELECT o_custkey, round((sum(due * {_SHARE.format(day="day")}::DOUBLE * days / 365) / 1e5)::DECIMAL(38,9), 4) AS interest, NULL::VARCHAR AS interest_blocked FROM p GROUP BY o_custkey""")
def schedule_periods(spark, sf_dir) -> DataFrame:
    """Interest over periods of unlike length and rate, for each customer with two days of orders or more."""
    rows = _periods(spark, sf_dir).withColumn("share", F.expr(f"cast({_SHARE.format(day='day')} as double)")).withColumn("due", F.col("due").cast("double"))
    sources = {"row:due": (F.col("due"), "INR"), "row:share": (F.col("share"), "fraction"), "row:days": (F.col("days"), "number")}
    return evaluated({"interest": Schedule(INTEREST, rows.select("o_custkey").distinct(), {}, rows, sources)}, ["o_custkey"])["interest"]


def _cells(spark, sf_dir) -> DataFrame:
    """Each line of an order as a cell of its sheet; untaxed lines are blank."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("C"), "l_linenumber").alias("address"), F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("decimal(18,2)")).alias("value"))


_BLANKS = """(SELECT l_orderkey, min(v) FILTER (k = 1) AS a, max(v) FILTER (k = 1) AS a2, min(v) FILTER (k = 2) AS b, max(v) FILTER (k = 2) AS b2, min(v) FILTER (k = 3) AS c, max(v) FILTER (k = 3) AS c2
  FROM (SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_tax > 0 THEN l_quantity::DECIMAL(18,2)::DOUBLE END AS v FROM lineitem) GROUP BY l_orderkey)"""
_WHY = "CASE WHEN a IS NULL THEN 'cell C1 is blank' WHEN a <> a2 THEN 'cell C1 has two values' WHEN b IS NULL THEN 'cell C2 is blank' WHEN b <> b2 THEN 'cell C2 has two values' WHEN c <> c2 THEN 'cell C3 has two values' END"


@query("schedule_cells", f"""WITH s AS {_BLANKS}, t AS (SELECT l_orderkey, {_WHY} AS why, (a + b + coalesce(c, 0)) / 3 AS base FROM s)
SELECT l_orderkey, CASE WHEN why IS NULL THEN round(base::DECIMAL(38,9), 4) END AS base, why AS base_blocked, CASE WHEN why IS NULL THEN round((base * 1.065)::DECIMAL(38,9), 4) END AS escalated, CASE WHEN why IS NOT NULL THEN 'needs base, which is blocked' END AS escalated_blocked FROM t""")
def schedule_cells(spark, sf_dir) -> DataFrame:
    """A base year of free cells and its escalation, for each order's sheet: a blank cell blocks, unless it is declared to be zero."""
    frame, sources = from_cells(_cells(spark, sf_dir), ["l_orderkey"], "address", "value", CELLS)
    return evaluated({"base": Schedule(BASE_YEAR, frame, sources)}, ["l_orderkey"])["base"]


CHAIN = [
    Rule("arr", "purchase + interest", "INR_lakh", {"purchase": Input("fed:purchase", "INR_lakh"), "interest": Input("fed:interest", "INR_lakh")}, id="arr", places=4),
    Rule("gap", "arr - revenue", "INR_lakh", {"arr": Input("rule:arr", "INR_lakh"), "revenue": Input("own:revenue", "INR")}, id="gap", places=4),
    Rule("closing", "opening + gap", "INR_lakh", {"opening": Input("fed:opening", "INR_lakh"), "gap": Input("rule:gap", "INR_lakh")}, id="closing", places=4),
]
YEARS = (1996, 1997, 1998)


@query("schedule_pipeline", f"""WITH r AS {_SOURCES.format(year="year(l_shipdate)")}, t AS (SELECT s_nationkey, y, sum(energy * rate) / 1e5 AS purchase, count(*) > count(rate) AS stopped FROM r GROUP BY ALL),
p AS (SELECT c_nationkey, year(day) AS y, sum(due * {_SHARE.format(day="day")}::DOUBLE * days / 365) / 1e5 AS interest FROM {_PERIODS} JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
v AS (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1e5 AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT n_nationkey, y FROM nation, (VALUES (1996), (1997), (1998)) v(y)),
g AS (SELECT n_nationkey, k.y, purchase, interest, revenue, coalesce(stopped, true) AS no_purchase, interest IS NULL AS no_interest FROM k LEFT JOIN t ON t.s_nationkey = n_nationkey AND t.y = k.y LEFT JOIN p ON p.c_nationkey = n_nationkey AND p.y = k.y LEFT JOIN v ON v.c_nationkey = n_nationkey AND v.y = k.y),
c AS (SELECT *, no_purchase OR no_interest AS no_arr, no_purchase OR no_interest OR revenue IS NULL AS no_gap, purchase + interest AS arr, purchase + interest - revenue AS gap FROM g),
s AS (SELECT *, sum(gap) OVER w AS closing, bool_or(no_gap) OVER w AS no_closing, coalesce(bool_or(no_gap) OVER (PARTITION BY n_nationkey ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS no_opening FROM c WINDOW w AS (PARTITION BY n_nationkey ORDER BY y))
SELECT n_nationkey AS s_nationkey, y AS year, CASE WHEN NOT no_arr THEN round(arr::DECIMAL(38,9), 4) END AS arr, CASE WHEN no_purchase THEN 'needs purchase of purchase ' || y || ', which is blocked' WHEN no_interest THEN 'needs interest of interest ' || y || ', which is blocked' END AS arr_blocked,
  CASE WHEN NOT no_gap THEN round(gap::DECIMAL(38,9), 4) END AS gap, CASE WHEN no_arr THEN 'needs arr, which is blocked' WHEN no_gap THEN 'input revenue (own:revenue) has no value' END AS gap_blocked,
  CASE WHEN NOT no_closing THEN round(closing::DECIMAL(38,9), 4) END AS closing, CASE WHEN no_opening THEN 'needs closing of column ' || (y - 1) || ', which is blocked' WHEN no_gap THEN 'needs gap, which is blocked' END AS closing_blocked FROM s""")
def schedule_pipeline(spark, sf_dir) -> DataFrame:
    """Schedules of purchases and of interest feed a column for each year, whose opening is what the year before closed with."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    dues = _periods(spark, sf_dir).join(people, F.col("o_custkey") == F.col("c_custkey")).withColumn("share", F.expr(f"cast({_SHARE.format(day='day')} as double)")).withColumn("due", F.col("due").cast("double"))
    paid = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("s_nationkey", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    sources = {"row:due": (F.col("due"), "INR"), "row:share": (F.col("share"), "fraction"), "row:days": (F.col("days"), "number")}
    plan: dict[str, Schedule] = {}
    for year in YEARS:
        before = Feed(f"column {year - 1}", "closing", "a year opens with what the year before closed with")
        plan[f"purchase {year}"] = _purchase(spark, sf_dir, year)
        plan[f"interest {year}"] = Schedule(INTEREST, _nations(spark, sf_dir), {}, dues.where(F.year("day") == year), sources)
        feeds = {"fed:purchase": Feed(f"purchase {year}", "purchase"), "fed:interest": Feed(f"interest {year}", "interest")}
        frame = _nations(spark, sf_dir).join(paid.where(F.col("year") == year), "s_nationkey", "left").withColumn("nothing", F.lit(0.0))
        own = {"own:revenue": (F.col("revenue"), "INR")}
        if year == YEARS[0]:
            own["fed:opening"] = (F.col("nothing"), "INR_lakh")
        plan[f"column {year}"] = Schedule(CHAIN, frame, own, feeds=feeds | ({"fed:opening": before} if year > YEARS[0] else {}), column=True)
    made = evaluated(plan, ["s_nationkey"])
    columns = [made[f"column {y}"].withColumn("year", F.lit(y)) for y in YEARS]
    return columns[0].unionByName(columns[1]).unionByName(columns[2])
