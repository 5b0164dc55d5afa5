"""Structure of documents and workbooks on the driver's tables: grids, outlines, candidates, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..calc.fixpoint import fill
from ..calc.reproduce import reproduce
from ..calc.rules import Input, Rule, RuleSet
from ..functions import figures, labels
from ..operators import sheets, structure
from ..operators.tables import input_hash
from ..registry import query
from ..sources.catalog import table


@query("fill_fixpoint", "SELECT l_orderkey * 8 + l_linenumber AS cell, sum(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::DECIMAL(28,2) AS value FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::DECIMAL(18,2)) AS v FROM lineitem GROUP BY ALL)")
def fill_fixpoint(spark, sf_dir) -> DataFrame:
    """Cells that read the cell before them, filled pass by pass; the chain is as long as an order has lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("v")).withColumn("cell", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    before = lines.select("l_orderkey", F.col("cell").alias("source"), F.col("l_linenumber").alias("k"))
    pairs = lines.join(before, "l_orderkey").where("k < l_linenumber").groupBy("cell").agg(F.max("source").alias("source"))
    one = F.lit(1).cast("decimal(2,0)")
    terms = lines.select("cell", (-F.col("cell")).alias("source"), one.alias("weight")).union(pairs.select("cell", "source", one))
    given = lines.select((-F.col("cell")).alias("cell"), F.col("v").cast("decimal(28,2)").alias("value"))
    return fill(given, terms)[0].where("cell > 0 or cell = 0 and value is not null")


def _grids(spark, sf_dir) -> DataFrame:
    """A grid of each order: two header rows with a merged cell, a first column whose repeats are blank."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grid"), F.year("o_orderdate").cast("string").alias("y"))
    heads = orders.select("grid", F.explode(F.expr("array(struct(0 as row, 0 as col, 'Head' as text), struct(0 as row, 1 as col, y as text), struct(0 as row, 2 as col, '' as text), struct(1 as row, 0 as col, '' as text), struct(1 as row, 1 as col, 'Claimed' as text), struct(1 as row, 2 as col, 'Approved' as text))")).alias("c")).select("grid", "c.*")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grid"), (F.col("l_linenumber") + 1).alias("row")).agg(F.min("l_returnflag").alias("f"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.max("l_partkey").alias("p"))
    cells = F.expr("array(struct(row, 0 as col, case when row % 2 = 0 then f else '' end as text), struct(row, 1 as col, cast(q as string) as text), struct(row, 2 as col, cast(p as string) as text))")
    return heads.unionByName(lines.select("grid", F.explode(cells).alias("c")).select("grid", "c.*"))


@query("grid_cells", """WITH l AS (SELECT l_orderkey AS grid, l_linenumber + 1 AS row, min(l_returnflag) AS f, sum(l_quantity::DECIMAL(18,2)) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
m AS (SELECT *, last_value(CASE WHEN row % 2 = 0 THEN f END IGNORE NULLS) OVER (PARTITION BY grid ORDER BY row ROWS UNBOUNDED PRECEDING) AS label FROM l), y AS (SELECT o_orderkey AS grid, year(o_orderdate)::VARCHAR AS y FROM orders)
SELECT grid, row, 1 AS col, q::VARCHAR AS text, y || ' / Claimed' AS header, label FROM m JOIN y USING (grid) UNION ALL SELECT grid, row, 2, p::VARCHAR, y || ' / Approved', label FROM m JOIN y USING (grid)""")
def grid_cells(spark, sf_dir) -> DataFrame:
    return structure.grid_cells(_grids(spark, sf_dir), 2)


@query("grid_agreement", """WITH a AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS v FROM lineitem GROUP BY ALL) SELECT l_orderkey AS grid, round(avg(CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS share,
CASE WHEN avg(CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) = 1 THEN 'full' WHEN avg(CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) >= 0.8 THEN 'partial' ELSE 'disagree' END AS class FROM a GROUP BY l_orderkey""")
def grid_agreement(spark, sf_dir) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grid"), F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").cast("string").alias("text")).withColumn("col", F.lit(0))
    other = cells.withColumn("text", F.when((F.col("grid") + F.col("row")) % 9 == 0, F.lit("?")).otherwise(F.concat(F.lit(" "), F.col("text"))))
    return structure.agreement(cells, other)


@query("merge_candidates", """SELECT l_partkey, l_suppkey, arg_max(l_orderkey, l_quantity * 1e9 - l_orderkey) AS l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS pages FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem) GROUP BY l_partkey, l_suppkey""")
def merge_candidates(spark, sf_dir) -> DataFrame:
    """Equal candidates as one: the best by confidence, then the earliest, with all pages as evidence."""
    c = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", F.col("l_linenumber").cast("string").alias("pages"))
    out = structure.merged(c, ["l_partkey", "l_suppkey"], [F.col("l_quantity").desc(), F.col("l_orderkey")], "pages")
    return out.select("l_partkey", "l_suppkey", "l_orderkey", F.array_join("pages", ",").alias("pages"))


@query("candidate_routing", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'expert' WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' THEN 'review' ELSE 'batch' END AS route, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS risks FROM orders")
def candidate_routing(spark, sf_dir) -> DataFrame:
    large, partial, urgent = F.col("o_totalprice") > 400000, F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"
    route = sheets.routed([("expert", large), ("review", partial | urgent)], "batch")
    return table(spark, sf_dir, "orders").select("o_orderkey", route.alias("route"), sheets.risks({"large": large, "partial": partial, "urgent": urgent}).alias("risks"))


@query("clause_outline")
def clause_outline(spark, sf_dir) -> DataFrame:
    """Numbered clauses of made-up orders, a path for each line; tested on a small text."""
    marks = F.expr("case l_linenumber % 4 when 0 then concat(l_linenumber, '. ') when 1 then concat(l_linenumber, '.1 ') when 2 then '(a) ' else '' end")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"), F.concat(marks, F.lit("The part "), F.col("l_partkey").cast("string")).alias("text"))
    return structure.outlines(lines, "l_orderkey", "place", "text")


@query("input_hashes", """SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS hash FROM part""")
def input_hashes(spark, sf_dir) -> DataFrame:
    """A computation's inputs as canonical JSON, hashed; the same inputs reproduce the hash."""
    return table(spark, sf_dir, "part").select("p_partkey", input_hash("p_name", "p_size").alias("hash"))


@query("reproduce_sheet", """WITH n AS (SELECT s_nationkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS gross, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey),
c AS (SELECT *, round((gross / 1e7)::DECIMAL(38,9), 6) AS money, round((CASE WHEN s_nationkey % 6 <> 0 THEN gross / (q * 1e6) END)::DECIMAL(38,9), 6) AS rate FROM n)
SELECT s_nationkey, 'money' AS output, (round(gross / 1e7, 1) + CASE WHEN s_nationkey % 4 = 0 THEN 0.2::DOUBLE ELSE 0 END)::DECIMAL(28,6) AS filed, round(money, 4)::DECIMAL(38,4) AS computed, CASE WHEN s_nationkey % 4 = 0 THEN 'differs' ELSE 'reproduced' END AS result FROM c
UNION ALL SELECT s_nationkey, 'rate', CASE WHEN s_nationkey % 5 <> 0 THEN round(gross / (q * 1e6), 4)::DECIMAL(28,6) END, round(rate, 4)::DECIMAL(38,4), CASE WHEN s_nationkey % 5 = 0 THEN 'not filed' WHEN s_nationkey % 6 = 0 THEN 'blocked: input e (row:energy) has no value' ELSE 'reproduced' END FROM c""")
def reproduce_sheet(spark, sf_dir) -> DataFrame:
    """A sheet of each nation: two printed figures computed again from two filed rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("g"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    n = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("g").cast("double").alias("gross"), F.sum("q").cast("double").alias("q"))
    rows = F.expr("""array(struct('gross' as row, gross as v, 2 as places), struct('energy' as row, case when s_nationkey % 6 <> 0 then q end as v, 2 as places),
      struct('money' as row, round(gross / 1e7, 1) + case when s_nationkey % 4 = 0 then 0.2D else 0D end as v, 1 as places), struct('rate' as row, case when s_nationkey % 5 <> 0 then round(gross / (q * 1e6), 4) end as v, 4 as places))""")
    cells = n.select("s_nationkey", F.explode(rows).alias("c")).select("s_nationkey", "c.row", F.col("c.v").cast("decimal(28,6)").alias("value"), "c.places")
    rules = RuleSet([Rule("money", "g", "INR_crore", {"g": Input("row:gross", "INR")}, places=6), Rule("rate", "g / e", "INR_per_kWh", {"g": Input("row:gross", "INR"), "e": Input("row:energy", "MU")}, places=6)], "FY2024-25")
    return reproduce(cells, rules, {"row:gross": ("gross", "INR"), "row:energy": ("energy", "MU")}, {"money": "money", "rate": "rate"}, ["s_nationkey"])


@query("grid_candidates", """WITH l AS (SELECT l_orderkey AS grid, l_linenumber + 1 AS row, sum(l_quantity::DECIMAL(18,2)) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL), m AS (SELECT *, CASE WHEN min(CASE WHEN row % 2 = 0 THEN row END) OVER (PARTITION BY grid) <= row THEN 'power_purchase' END AS head FROM l), y AS (SELECT o_orderkey AS grid, 'FY' || year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS fy FROM orders)
SELECT grid, row, fy AS fiscal_year, 'claimed' AS voice, head, q::DECIMAL(28,6) AS value FROM m JOIN y USING (grid) UNION ALL SELECT grid, row, fy, 'approved', head, p::DECIMAL(28,6) FROM m JOIN y USING (grid)""")
def grid_candidates(spark, sf_dir) -> DataFrame:
    """Cells of grids as candidate figures: the header names year and voice, the label the head, the text the value."""
    grids = _grids(spark, sf_dir).withColumn("text", F.when((F.col("row") == 0) & (F.col("col") == 1), F.concat("text", F.lit("-"), F.lpad(((F.col("text").cast("int") + 1) % 100).cast("string"), 2, "0"))).when((F.col("row") > 1) & (F.col("col") == 0) & (F.col("text") != ""), F.concat(F.lit("Power Purchase "), "text")).otherwise(F.col("text")))
    cells = structure.grid_cells(grids, 2)
    return cells.select("grid", "row", figures.fiscal_year(F.col("header")).alias("fiscal_year"), labels.voice_of(F.col("header")).alias("voice"), labels.head_of(F.col("label")).alias("head"), figures.figure(F.col("text")).alias("value")).where("value is not null")
