"""Calculated figures: rules, categories, projections, identities, true-up, reproduction at printed precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..calc.projection import Line, project
from ..calc.rules import Input, Rule, RuleSet
from ..registry import query
from ..sources.catalog import table

RULES = [
    Rule("net", "gross - rebate", "INR_crore", {"gross": Input("fact:gross", "INR"), "rebate": Input("fact:rebate", "INR")}, id="net", places=6),
    Rule("working", "rate * avg(net, net / 2)", "INR_crore", {"rate": Input("regulation", "percent", 12.5), "net": Input("rule:net", "INR_crore")}, id="working", places=6),
    Rule("unit_cost", "cost / energy", "INR_per_kWh", {"cost": Input("rule:net", "INR_crore"), "energy": Input("fact:energy", "MU")}, id="unit_cost", places=6),
    Rule("carried", "ifneg(cap - cost, cap, cost)", "INR_per_kWh", {"cap": Input("regulation", "paise_per_kWh", 150000), "cost": Input("rule:unit_cost", "INR_per_kWh")}, id="carried", places=4),
]


def _nations(spark, sf_dir) -> DataFrame:
    """Gross, rebate and energy of each nation; energy is null for nations whose key is divisible by seven and zero for the next ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("g"), F.sum(F.expr("cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))")).alias("r"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    by = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("g").alias("gross"), F.sum("r").alias("rebate"), F.sum("q").alias("q"))
    return by.select("s_nationkey", F.col("gross").cast("double").alias("gross"), F.col("rebate").cast("double").alias("rebate"), F.expr("case s_nationkey % 7 when 0 then null when 1 then 0 else cast(q as double) end").alias("energy"))


_NATIONS = """n AS (SELECT s_nationkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS gross, sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DOUBLE AS rebate,
  CASE s_nationkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE sum(l_quantity::DECIMAL(18,2))::DOUBLE END AS energy FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)"""


@query("rules_eval", f"""WITH {_NATIONS}, a AS (SELECT *, gross - rebate AS net FROM n), b AS (SELECT *, 0.125::DOUBLE * (net + net / 2) / 2 AS working, CASE WHEN energy > 0 THEN net / (energy * 1e6) END AS cost,
  CASE WHEN energy IS NULL THEN 'input energy (fact:energy) has no value' WHEN energy = 0 THEN 'division by zero' END AS why FROM a)
SELECT s_nationkey, round((net / 1e7)::DECIMAL(38,9), 6) AS net, round((working / 1e7)::DECIMAL(38,9), 6) AS working, round(cost::DECIMAL(38,9), 6) AS unit_cost, why AS unit_cost_blocked,
  round((CASE WHEN 1500 - cost < 0 THEN 1500 ELSE cost END)::DECIMAL(38,9), 4) AS carried, CASE WHEN why IS NOT NULL THEN 'needs unit_cost, which is blocked' END AS carried_blocked FROM b""")
def rules_eval(spark, sf_dir) -> DataFrame:
    """Four rules over nations; where energy is missing or zero, what needs it is blocked with the reason."""
    sources = {"fact:gross": (F.col("gross"), "INR"), "fact:rebate": (F.col("rebate"), "INR"), "fact:energy": (F.col("energy"), "MU")}
    out = RuleSet(RULES, "FY2024-25").evaluate(_nations(spark, sf_dir), sources)
    return out.select("s_nationkey", "net", "working", "unit_cost", "unit_cost_blocked", "carried", "carried_blocked")


CATEGORY_RULES = [
    Rule("charge", "energy * rate", "INR", {"energy": Input("fact:energy", "kWh"), "rate": Input("fact:rate", "INR_per_kWh")}, id="charge", per="category", places=4),
    Rule("revenue", "total / 2", "INR_lakh", {"total": Input("sum:charge", "INR")}, id="revenue", places=4),
]


@query("rules_per_category", """WITH c AS (SELECT l_suppkey, l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS energy, CASE WHEN l_suppkey % 10 = 3 AND l_returnflag = 'A' THEN NULL ELSE (max(l_tax * 100)::DECIMAL(18,2))::DOUBLE END AS rate FROM lineitem GROUP BY l_suppkey, l_returnflag),
t AS (SELECT l_suppkey, sum(energy * rate) AS total, bool_or(rate IS NULL) AS stopped FROM c GROUP BY l_suppkey)
SELECT s_suppkey AS l_suppkey, CASE WHEN NOT stopped THEN round((total / 2 / 1e5)::DECIMAL(38,9), 4) END AS revenue, CASE WHEN coalesce(stopped, true) THEN 'needs charge, which is blocked' END AS revenue_blocked FROM supplier LEFT JOIN t ON l_suppkey = s_suppkey""")
def rules_per_category(spark, sf_dir) -> DataFrame:
    """A charge per category and its sum, all or blocked."""
    rate = F.expr("case when l_suppkey % 10 = 3 and l_returnflag = 'A' then null else cast(cast(max(l_tax * 100) as decimal(18,2)) as double) end")
    cats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("energy"), rate.alias("rate"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    out = RuleSet(CATEGORY_RULES, "FY2024-25").evaluate(suppliers, {}, ["l_suppkey"], cats, {"fact:energy": (F.col("energy"), "kWh"), "fact:rate": (F.col("rate"), "INR_per_kWh")})
    return out.select("l_suppkey", "revenue", "revenue_blocked")


PLAN = [Line("sales", "escalate", rate="growth"), Line("loss", "assumption", rate="loss_pct"), Line("input", "energy_input", ("sales", "loss")), Line("power", "quantity_x_rate", ("input",), "rate"), Line("om", "escalate", rate="inflation"), Line("total", "sum", ("power", "om")), Line("cost", "acos", ("total", "sales"))]


def _years_sql() -> str:
    """The plan unrolled by hand for two years."""
    r = lambda x: f"round(({x})::DECIMAL(38,9), 2)::DECIMAL(38,2)"
    out = "y0 AS (SELECT n_nationkey, count(*)::DOUBLE AS sales, CASE WHEN n_nationkey % 5 <> 0 THEN sum(c_acctbal::DECIMAL(18,2))::DOUBLE END AS om FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)"
    for i in (1, 2):
        out += f""", a{i} AS (SELECT n_nationkey, {r(f'sales::DOUBLE * (1 + 5.5::DOUBLE / 100)')} AS sales, {r(f'om::DOUBLE * (1 + {3 + i}::DOUBLE / 100)')} AS om FROM y{i - 1}),
b{i} AS (SELECT *, {r('sales::DOUBLE / (1 - 12.5::DOUBLE / 100)')} AS input FROM a{i}), c{i} AS (SELECT *, {r('input::DOUBLE * 4.25::DOUBLE / 10')} AS power FROM b{i}), d{i} AS (SELECT *, {r('power::DOUBLE + om::DOUBLE')} AS total FROM c{i}), y{i} AS (SELECT *, {r('total::DOUBLE / sales::DOUBLE * 10')} AS cost FROM d{i})"""
    return out


@query("projection", f"WITH {_years_sql()} SELECT y1.n_nationkey, y1.sales AS sales_1, y1.total AS total_1, y1.cost AS cost_1, y2.sales AS sales_2, y2.total AS total_2, y2.cost AS cost_2, CASE WHEN y2.om IS NULL THEN 'input blocked: total FY2026-27' END AS cost_2_blocked, CASE WHEN y1.om IS NULL THEN 'no base figure for om' END AS om_1_blocked FROM y1 JOIN y2 USING (n_nationkey)")
def projection(spark, sf_dir) -> DataFrame:
    """Seven plan lines over two years; rounded results feed the next year, missing base figures block what follows."""
    base = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.count("*").alias("sales"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("om"))
    given = {"sales": F.col("sales"), "om": F.expr("case when n_nationkey % 5 <> 0 then om end")}
    rates = {("growth", ""): F.lit(5.5), ("loss_pct", ""): F.lit(12.5), ("rate", ""): F.lit(4.25), ("inflation", "FY2025-26"): F.lit(4), ("inflation", "FY2026-27"): F.lit(5)}
    out = project(base, PLAN, "FY2024-25", "FY2026-27", given, rates)
    return out.select("n_nationkey", *[F.col(f"{c}_{y}").alias(f"{c}_{i}") for i, y in ((1, 2025), (2, 2026)) for c in ("sales", "total", "cost")], F.col("cost_2026_blocked").alias("cost_2_blocked"), F.col("om_2025_blocked").alias("om_1_blocked"))


@query("identities", """WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2) * (1 + l_tax::DECIMAL(4,2)) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(38,2) AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS printed, parts, n, abs(o_totalprice::DECIMAL(18,2) - parts) <= greatest(0.05::DECIMAL(4,2), 0.001::DECIMAL(6,3) * abs(parts)) AS holds FROM orders JOIN s ON o_orderkey = l_orderkey WHERE n >= 2""")
def identities(spark, sf_dir) -> DataFrame:
    """A printed total against the sum of its parts (two at least), within the larger of an absolute and a relative tolerance."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("cast(l_extendedprice as decimal(18,2)) * (1 + cast(l_tax as decimal(4,2))) * (1 - cast(l_discount as decimal(4,2)))")).cast("decimal(38,2)").alias("parts"), F.count("*").alias("n")).where("n >= 2")
    out = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("printed", F.col("o_totalprice").cast("decimal(18,2)"))
    return out.select("o_orderkey", "printed", "parts", "n", F.expr("abs(printed - parts) <= greatest(cast(0.05 as decimal(4,2)), cast(0.001 as decimal(6,3)) * abs(parts))").alias("holds"))


@query("trueup", """WITH a AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS approved, o_orderpriority AS unit FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'), b AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS actual, max(l_shipdate) AS seen FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, l_orderkey) AS line, approved, actual, CASE WHEN actual IS NULL THEN 'actual_missing' WHEN approved IS NULL THEN 'approved_missing' WHEN unit = '5-LOW' THEN 'unit_mismatch' ELSE 'complete' END AS status,
  CASE WHEN unit <> '5-LOW' THEN actual - approved END AS variance FROM a FULL JOIN b ON o_orderkey = l_orderkey""")
def trueup(spark, sf_dir) -> DataFrame:
    """Approved against actual by line; a variance only where both are there in one unit."""
    a = table(spark, sf_dir, "orders").where("o_orderpriority <> '4-NOT SPECIFIED'").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("approved"), F.col("o_orderpriority").alias("unit"))
    b = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("actual"))
    j = a.join(b, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    status = F.expr("case when actual is null then 'actual_missing' when approved is null then 'approved_missing' when unit = '5-LOW' then 'unit_mismatch' else 'complete' end")
    return j.select(F.coalesce("o_orderkey", "l_orderkey").alias("line"), "approved", "actual", status.alias("status"), F.expr("case when unit <> '5-LOW' then actual - approved end").alias("variance"))


@query("surcharge", """WITH p AS (SELECT p_partkey, p_retailprice AS t, p_size::DOUBLE AS c, (p_partkey % 40)::DOUBLE AS l, (p_partkey % 13)::DOUBLE AS d, (p_partkey % 3)::DOUBLE AS r FROM part), s AS (SELECT *, t - (c / (1 - l / 100) + d + r) AS s FROM p)
SELECT p_partkey, round(greatest(least(s, 0.2::DOUBLE * t), 0)::DECIMAL(38,9), 4) AS surcharge, s > 0.2::DOUBLE * t AS capped FROM s""")
def surcharge(spark, sf_dir) -> DataFrame:
    """A tariff less the grossed-up cost of power, wheeling and regulatory assets, within a fifth of the tariff and not under zero."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("t"), F.col("p_size").cast("double").alias("c"), *[(F.col("p_partkey") % m).cast("double").alias(k) for k, m in (("l", 40), ("d", 13), ("r", 3))])
    s = p.withColumn("s", F.expr("t - (c / (1 - l / 100) + d + r)"))
    return s.select("p_partkey", F.round(F.greatest(F.least("s", F.col("t") * 0.2), F.lit(0.0)).cast("decimal(38,9)"), 4).alias("surcharge"), F.expr("s > t * 0.2D").alias("capped"))


@query("reproduce_printed", """WITH p AS (SELECT *, round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 1)::DECIMAL(18,1) AS again FROM lineitem), q AS (SELECT *, again + CASE WHEN l_linenumber = 7 THEN 0.3 WHEN l_linenumber = 6 THEN 0.1 ELSE 0 END::DECIMAL(4,1) AS printed FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, printed::DECIMAL(18,1) AS printed, abs(again - printed) <= 0.1::DECIMAL(4,1) AS reproduced FROM q""")
def reproduce_printed(spark, sf_dir) -> DataFrame:
    """Recomputed figures compared at the printed precision, one unit in the last place allowed."""
    again = F.round(F.expr("cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))"), 1).cast("decimal(18,1)")
    lines = table(spark, sf_dir, "lineitem").withColumn("again", again).withColumn("printed", F.expr("cast(again + case l_linenumber when 7 then 0.3 when 6 then 0.1 else 0.0 end as decimal(18,1))"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "printed", F.expr("abs(again - printed) <= cast(0.1 as decimal(4,1))").alias("reproduced"))
