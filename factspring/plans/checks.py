"""Printed figures held against each other, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as c
from ..registry import query
from ..sources.catalog import table

_TOKENS = "list_transform(regexp_extract_all({}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda t: replace(t, ',', ''))"


@query("rows_on_page", f"""WITH p AS (SELECT page_id, list_distinct({_TOKENS.format("html")}) AS there, html FROM pages), r AS (SELECT page_id, k, CASE WHEN (page_id + k) % 3 = 0 THEN concat(substr(html, 1 + 400 * k, 300), ' 98,76,543.21') ELSE substr(html, 1 + 400 * k, 300) END AS cells FROM pages, (VALUES (0), (1), (2)) v(k))
SELECT page_id, k, len(list_filter({_TOKENS.format("cells")}, lambda t: NOT list_contains(there, t))) = 0 AS holds FROM r JOIN p USING (page_id)""")
def rows_on_page(spark, sf_dir) -> DataFrame:
    """Rows whose every number stands on their page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    rows = pages.select("page_id", "html", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    piece = F.substring("html", 1 + 400 * F.col("k"), F.lit(300))
    rows = rows.select("page_id", "k", F.when((F.col("page_id") + F.col("k")) % 3 == 0, F.concat(piece, F.lit(" 98,76,543.21"))).otherwise(piece).alias("cells"))
    return c.on_their_page(rows, ["k"], ["page_id"], F.col("cells"), pages, "html")


@query("amounts_hold", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END::DECIMAL(12,2) AS mu, round(l_extendedprice / l_quantity / 100, 2)::DECIMAL(12,2) AS rate, round(l_extendedprice / 1000 + CASE WHEN l_linenumber = 2 THEN 0.5 ELSE 0 END, 2)::DECIMAL(12,2) AS amount FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN mu <> 0 THEN CASE WHEN abs(mu * rate / 10 - amount) <= abs(mu) * 0.0005 + abs(rate) * 0.0005 + 0.005 THEN 'match' ELSE 'differs' END END AS result FROM r""")
def amounts_hold(spark, sf_dir) -> DataFrame:
    """Amounts against quantity x rate within the rounding of what is printed."""
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "mu": F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity")).cast("decimal(12,2)"), "rate": F.round(F.col("l_extendedprice") / F.col("l_quantity") / 100, 2).cast("decimal(12,2)"),
        "amount": F.round(F.col("l_extendedprice") / 1000 + F.when(F.col("l_linenumber") == 2, 0.5).otherwise(0.0), 2).cast("decimal(12,2)"),
    })
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", c.amount_check(F.col("mu"), F.col("rate"), F.col("amount")).alias("result"))


@query("subtotals_hold", """WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber <> 4 THEN l_extendedprice::DECIMAL(14,2) END) AS computed, sum(l_extendedprice::DECIMAL(14,2)) AS whole FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, (whole + CASE WHEN l_orderkey % 5 = 0 THEN 0.02 ELSE 0 END)::DECIMAL(18,2) AS printed, computed, (whole + CASE WHEN l_orderkey % 5 = 0 THEN 0.02 ELSE 0 END - computed)::DECIMAL(18,2) AS difference, CASE WHEN abs(whole + CASE WHEN l_orderkey % 5 = 0 THEN 0.02 ELSE 0 END - computed) <= 0.02 THEN 'match' ELSE 'differs' END AS result FROM s WHERE computed IS NOT NULL""")
def subtotals_hold(spark, sf_dir) -> DataFrame:
    """Printed totals against the sum of their parts, within two units of the last place."""
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice").cast("decimal(14,2)"))
    totals = lines.groupBy("l_orderkey").agg((F.sum("v") + F.when(F.col("l_orderkey") % 5 == 0, F.lit("0.02").cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))).cast("decimal(18,2)").alias("total"))
    out = c.subtotal_checks(lines.withColumn("v", F.when(F.col("l_linenumber") != 4, F.col("v"))), totals, ["l_orderkey"], "v", "total")
    return out.withColumn("difference", F.col("difference").cast("decimal(18,2)"))


@query("block_reproduction", """WITH b AS (SELECT year(o_orderdate) AS y, o_custkey % 20 AS cat, sum(o_totalprice::DECIMAL(14,2)) AS opening, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(14,2) END) AS additions, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT *, opening + additions AS closing, CASE WHEN n % 4 > 0 THEN opening + additions + CASE WHEN n % 4 = 1 THEN 0.01 ELSE 0 END END AS filed_closing, (opening * 2 + additions) / 2 AS average, (opening * 2 + additions) / 2 AS filed_average FROM b),
t AS (SELECT y, sum(closing) AS closing, sum(opening + coalesce(additions, 0)) + CASE WHEN y % 2 = 0 THEN 1 ELSE 0 END AS filed FROM w GROUP BY y)
SELECT y, cat::VARCHAR AS cat, 'average' AS output, CASE WHEN filed_average IS NULL THEN 'no_filed_value' ELSE 'match' END AS result FROM w
UNION ALL SELECT y, cat::VARCHAR, 'closing', CASE WHEN filed_closing IS NULL THEN 'no_filed_value' WHEN closing IS NULL THEN 'blocked' WHEN round(closing, 2) = round(filed_closing, 2) THEN 'match' ELSE 'differs' END FROM w
UNION ALL SELECT y, 'TOTAL', 'closing', CASE WHEN filed IS NULL THEN 'no_filed_value' WHEN closing IS NULL THEN 'blocked' WHEN round(closing, 2) = round(filed, 2) THEN 'match' ELSE 'differs' END FROM t""")
def block_reproduction(spark, sf_dir) -> DataFrame:
    """Year blocks computed again, category by category, and their totals."""
    money = F.col("o_totalprice").cast("decimal(14,2)")
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), (F.col("o_custkey") % 20).cast("string").alias("cat")).agg(F.sum(money).alias("opening"), F.sum(F.when(F.col("o_orderstatus") == "O", money)).alias("additions"), F.count("*").alias("n"))
    closing, average = F.col("opening") + F.col("additions"), (F.col("opening") * 2 + F.col("additions")) / 2
    filed = rows.withColumn("closing", F.when(F.col("n") % 4 > 0, closing + F.when(F.col("n") % 4 == 1, F.lit("0.01")).otherwise("0").cast("decimal(4,2)"))).withColumn("average", average)
    parts = c.filed_checks(filed, ["y", "cat"], {"closing": (closing, "closing"), "average": (average, "average")}, 2)
    totals = rows.groupBy("y").agg(F.sum(closing).alias("made"), (F.sum(F.col("opening") + F.coalesce("additions", F.lit(0))) + F.col("y") % 2 * -1 + 1).alias("closing")).withColumn("cat", F.lit("TOTAL"))
    return parts.unionByName(c.filed_checks(totals, ["y", "cat"], {"closing": (F.col("made"), "closing")}, 2)).select("y", "cat", "output", "result")


@query("ledger_reconciled", """WITH g AS (SELECT l_suppkey % 40 AS grp, sum(l_extendedprice::DECIMAL(14,2)) AS s, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT DISTINCT p_partkey % 12 AS comparison, p_partkey % 50 AS grp FROM part WHERE p_partkey < 150),
f AS (SELECT comparison, sum(s) AS s, sum(n)::BIGINT AS n FROM k JOIN g USING (grp) GROUP BY comparison)
SELECT i AS comparison, coalesce(n, 0) AS accounts, CASE WHEN s IS NULL THEN 'blocked' WHEN i % 4 = 3 THEN 'no_filed_value' WHEN i % 4 = 1 THEN 'differs' ELSE 'match' END AS result, round(s * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END / 100000, 2)::DECIMAL(20,2) AS computed
FROM range(14) t(i) LEFT JOIN f ON comparison = i""")
def ledger_reconciled(spark, sf_dir) -> DataFrame:
    """A trial balance, by groups of accounts, beside what is claimed."""
    ledger = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("grp"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"))
    groups = table(spark, sf_dir, "part").where("p_partkey < 150").select((F.col("p_partkey") % 12).alias("comparison"), (F.col("p_partkey") % 50).alias("grp"))
    claims = groups.distinct().join(ledger.groupBy("grp").agg(F.sum("amount").alias("s")), "grp").groupBy("comparison").agg((F.sum("s") / 100000).alias("true"))
    comparisons = spark.range(14).select(F.col("id").alias("comparison"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("sign"), F.lit("0.00001").cast("decimal(6,5)").alias("factor")).join(claims, "comparison", "left")
    claimed = F.when(F.col("comparison") % 4 != 3, F.coalesce(F.col("true"), F.lit(1)) * F.col("sign") + F.when(F.col("comparison") % 4 == 1, F.lit("0.02")).otherwise("0").cast("decimal(4,2)"))
    out = c.ledger_checks(ledger, "grp", "amount", comparisons.withColumn("claimed", claimed), groups, 2)
    return out.select("comparison", "accounts", "result", F.col("computed").cast("decimal(20,2)").alias("computed"))


@query("checklist_results", """WITH e AS (SELECT l_suppkey AS item, l_returnflag = 'N' AND l_quantity > 10 AS outside, l_quantity > 25 AS found, l_tax < 0.01 AS mention FROM lineitem WHERE l_quantity < 4 OR l_quantity > 49)
SELECT item, CASE WHEN count(*) FILTER (NOT outside) = 0 THEN 'outside_package' WHEN count(*) FILTER (NOT outside AND found) = 0 THEN 'not_found' WHEN count(*) FILTER (NOT outside AND found AND NOT mention) = 0 THEN 'mentioned' WHEN count(*) FILTER (NOT outside AND (mention OR NOT found)) = 0 THEN 'evidenced' ELSE 'partly' END AS result FROM e GROUP BY item""")
def checklist_results(spark, sf_dir) -> DataFrame:
    """What a filing holds of each item of a checklist."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity < 4 or l_quantity > 49")
    kind = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 10), "outside").otherwise("document")
    evidence = lines.select(F.col("l_suppkey").alias("item"), kind.alias("kind"), (F.col("l_quantity") > 25).alias("found"), F.when(F.col("l_tax") < 0.01, "mention").alias("weight"))
    return c.checklist(evidence, ["item"], "kind", "found", "weight")


@query("case_readiness", """WITH n AS (SELECT c_custkey, y FROM customer, (VALUES (1995), (1996), (1997), (1998)) v(y)), p AS (SELECT DISTINCT o_custkey AS c_custkey, year(o_orderdate) AS y FROM orders)
SELECT c_custkey, count(*) AS needed, count(*) FILTER (p.y IS NULL) AS missing, count(*) FILTER (p.y IS NULL) = 0 AS ready FROM n LEFT JOIN p USING (c_custkey, y) GROUP BY c_custkey""")
def case_readiness(spark, sf_dir) -> DataFrame:
    """What each case lacks before anything is computed."""
    needed = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, (1995, 1996, 1997, 1998)))).alias("y"))
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    return c.readiness(needed, present, ["c_custkey"], ["y"])


@query("figure_traces", "SELECT l_orderkey, l_linenumber, l_partkey, 'net' AS output, 'quantity' AS name, l_quantity::DECIMAL(12,2)::VARCHAR AS input, 'MU' AS unit, (l_quantity::DECIMAL(12,2) * 3)::DECIMAL(12,2)::VARCHAR AS value, round(l_quantity::DECIMAL(12,2) * 3, 1)::DECIMAL(12,1)::VARCHAR AS rounded FROM lineitem")
def figure_traces(spark, sf_dir) -> DataFrame:
    """How each figure came about: inputs with units, value, rounded value."""
    quantity = F.col("l_quantity").cast("decimal(12,2)")
    t = c.trace("net", "three times", "quantity * 3", {"quantity": (quantity, "MU")}, (quantity * 3).cast("decimal(12,2)"), 1, "MU")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "t.output", F.lit("quantity").alias("name"), F.col("t.inputs")["quantity"]["value"].alias("input"), F.col("t.inputs")["quantity"]["unit"].alias("unit"), "t.value", "t.rounded")


@query("convention_questions", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'loss_basis' WHEN l_returnflag = 'R' THEN 'total_includes:' || (l_suppkey % 5) WHEN l_linenumber = 3 THEN 'gap_convention' END AS key FROM lineitem),
q AS (SELECT key, count(*) AS asked, list_sort(list(id ORDER BY id)[1:8]) AS evidence FROM f WHERE key IS NOT NULL GROUP BY key), d(key, decision) AS (VALUES ('loss_basis', 'state'), ('total_includes:9', 'yes'))
SELECT coalesce(q.key, d.key) AS key, coalesce(asked, 0) AS asked, array_to_string(coalesce(evidence, []), ' ') AS evidence, decision FROM q FULL JOIN d ON q.key = d.key""")
def convention_questions(spark, sf_dir) -> DataFrame:
    """Questions of convention that findings pose, with the first of their evidence and the decision."""
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    key = F.when(F.col("l_linenumber") == 1, "loss_basis").when(F.col("l_returnflag") == "R", F.concat(F.lit("total_includes:"), (F.col("l_suppkey") % 5).cast("string"))).when(F.col("l_linenumber") == 3, "gap_convention")
    decided = spark.createDataFrame([("loss_basis", "state"), ("total_includes:9", "yes")], "key string, decision string")
    return c.questions(rows, key, "id", decided).withColumn("evidence", F.concat_ws(" ", F.col("evidence").cast("array<string>")))


@query("readings_deduplicated", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS key, l_suppkey, CASE WHEN l_linenumber < 7 THEN l_quantity END AS value, l_returnflag <> 'A' AS lone, l_linestatus FROM lineitem)
SELECT key, l_suppkey, CASE WHEN value IS NULL THEN key ELSE first_value(key) OVER (PARTITION BY l_suppkey, value ORDER BY lone, l_linestatus, key) END AS survivor FROM r""")
def readings_deduplicated(spark, sf_dir) -> DataFrame:
    """Readings of one printed fact, and the one that stands for them."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_suppkey", F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("value"), (F.col("l_returnflag") != "A").alias("lone"), "l_linestatus")
    return c.deduplicated(rows, ["l_suppkey", "value"], [F.col("lone"), F.col("l_linestatus")], "key").select("key", "l_suppkey", "survivor")


@query("table_values", """SELECT l_orderkey, l_partkey, l_extendedprice AS value, CASE WHEN l_quantity > 40 THEN 'FY2020-21' ELSE 'FY202' || l_linenumber || '-2' || (l_linenumber + 1) END AS fiscal_year, CASE WHEN l_returnflag = 'R' THEN 'actual' WHEN l_linenumber % 2 = 1 THEN 'approved' ELSE 'claimed' END AS voice,
 CASE WHEN l_orderkey % 3 > 0 THEN round(l_extendedprice * CASE l_orderkey % 3 WHEN 1 THEN 0.01 ELSE 1 END, 4) END AS value_crore, CASE WHEN l_quantity > 40 THEN 'row label' ELSE 'column' END AS year_from FROM lineitem WHERE l_linenumber < 6""")
def table_values(spark, sf_dir) -> DataFrame:
    """Values of nested tables as rows."""
    lines = table(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("column"), F.col("l_partkey").cast("string").alias("label"), F.when(F.col("l_quantity") > 40, "FY2020-21").alias("row_year"), F.when(F.col("l_returnflag") == "R", "actual").alias("row_voice"), F.col("l_extendedprice").alias("value"))
    columns = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(f"FY202{i}-2{i + 1}").alias("fiscal_year"), F.lit("approved" if i % 2 else "claimed").alias("voice"), F.lit(f"column {i}").alias("header")) for i in range(1, 6)])
    factor = F.when(F.col("l_orderkey") % 3 == 1, 0.01).when(F.col("l_orderkey") % 3 == 2, 1.0)
    nested = lines.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines")).withColumn("columns", columns).withColumn("factor", factor)
    return c.value_rows(nested, ["l_orderkey"]).select("l_orderkey", F.col("label").cast("long").alias("l_partkey"), "value", "fiscal_year", "voice", "value_crore", "year_from")


#: The columns of each grid, by the number of its supplier: text in row 0 (the heading), then in rows 1 and 2.
GRIDS = [["H:", ":1", "H:", ":1"], ["H:", ":12", ":", "H:1"], ["H:1", ":2", "H:12", ":"], ["H:", ":", ":2", "H:12"]]
_LOGICAL = [[0, 0, 2, 2], [0, 0, 0, 3], [0, 1, 2, 3], [0, 0, 0, 3]]


@query("logical_columns", f"SELECT s_suppkey, k AS col, logical FROM supplier JOIN (VALUES {', '.join(f'({i}, {k}, {v})' for i, row in enumerate(_LOGICAL) for k, v in enumerate(row))}) v(i, k, logical) ON i = s_suppkey % {len(GRIDS)}")
def logical_columns(spark, sf_dir) -> DataFrame:
    """Columns of a grid that are one column drawn as several."""
    shapes = F.array(*[F.array(*map(F.lit, g)) for g in GRIDS])
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.get(shapes, (F.col("s_suppkey") % len(GRIDS)).cast("int"))).alias("col", "shape"))
    cells = cells.select("s_suppkey", "col", "shape", F.explode(F.array(*map(F.lit, range(3)))).alias("row"))
    text = F.when(F.when(F.col("row") == 0, F.col("shape").startswith("H")).otherwise(F.contains(F.split_part("shape", F.lit(":"), F.lit(2)), F.col("row").cast("string"))), "x").otherwise("")
    return c.logical_columns(cells.withColumn("text", text), ["s_suppkey"], "row", "col", "text")
