"""Picks, pairings, roll-ups and checks that reading a document needs, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.latest import latest, top_in_group
from ..operators.pairing import best_boxes, ordered_headings, staged_pairs
from ..registry import query
from ..sources.catalog import table


@query("headline_pick", "SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END, l_linenumber DESC, l_partkey DESC, l_suppkey) AS rn FROM lineitem WHERE l_returnflag IN ('R', 'A')) WHERE rn = 1")
def headline_pick(spark, sf_dir) -> DataFrame:
    """An order's bottom line: the last row of the first kind that it has."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    order = [F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.col("l_linenumber").desc(), F.col("l_partkey").desc(), F.col("l_suppkey")]
    return latest(rows, ["l_orderkey"], order).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


_UNIT_SQL = """WITH f AS (SELECT DISTINCT l_orderkey AS tab, nullif(o_orderpriority, '5-LOW') AS unit, (l_partkey * 100 + l_quantity)::BIGINT AS figure FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT * FROM f WHERE abs(figure) >= 10000 AND figure % 100 <> 0)
SELECT a.tab, min(b.unit) AS unit, count(DISTINCT a.figure) AS shared FROM g a JOIN g b ON a.figure = b.figure WHERE a.unit IS NULL AND b.unit IS NOT NULL GROUP BY a.tab HAVING count(DISTINCT b.unit) = 1 AND count(DISTINCT a.figure) >= 3"""


@query("unit_inference", _UNIT_SQL)
@query("unit_evidence", _UNIT_SQL)
def unit_evidence(spark, sf_dir) -> DataFrame:
    """A table without a unit takes that of tables which print three or more of its distinctive figures (in hundredths: at least 100, not whole), if they name one unit only. A figure meets others as its least and greatest unit, so none makes pairs, however many tables have it."""
    units = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("unit"))
    return borrowed_units(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tab"), F.expr("cast(l_partkey * 100 + l_quantity as long)").alias("figure")).join(units, F.col("tab") == F.col("o_orderkey")))


def borrowed_units(f: DataFrame) -> DataFrame:
    """``tab, unit, shared`` of the tables without a unit among the lines ``tab, unit, figure`` (hundredths) that may borrow one."""
    f = f.where("abs(figure) >= 10000 and figure % 100 <> 0")
    known = f.where("unit is not null").groupBy("figure").agg(F.min("unit").alias("least"), F.max("unit").alias("most"))
    hits = f.where("unit is null").select("tab", "figure").distinct().join(known, "figure").groupBy("tab").agg(F.min("least").alias("unit"), F.max("most").alias("most"), F.count("*").alias("shared"))
    return hits.where("unit = most and shared >= 3").select("tab", "unit", "shared")


_LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'Power Purchase Cost' WHEN 1 THEN 'O & M Expenses' WHEN 2 THEN 'Net Revenue Requirement' WHEN 3 THEN 'Interest on loan' WHEN 4 THEN 'Depreciation' ELSE p_name END"


@query("label_heads", f"SELECT p_partkey, {_LABEL} AS label, CASE p_partkey % 6 WHEN 0 THEN 'power_purchase' WHEN 1 THEN 'om' WHEN 2 THEN 'net_arr' WHEN 3 THEN 'interest' WHEN 4 THEN 'depreciation' END AS head FROM part")
def label_heads(spark, sf_dir) -> DataFrame:
    out = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL).alias("label"))
    return out.withColumn("head", labels.head_of(F.col("label")))


@query("canonical_codes", "SELECT p_partkey, upper(replace(p_brand, '#', '')) || '-' || p_size AS code FROM part")
def canonical_codes(spark, sf_dir) -> DataFrame:
    written = F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.when(F.col("p_partkey") % 2 == 0, F.lit(" – ")).otherwise(F.lit("-")), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.code(written).alias("code"))


@query("page_label_runs", """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, (event_id // 700 + row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS label FROM events)
SELECT user_id, label - page AS offset_, min(page) AS first_page, max(page) AS last_page FROM p GROUP BY user_id, label - page HAVING count(*) >= 2""")
def page_label_runs(spark, sf_dir) -> DataFrame:
    """Segments of pages whose printed label lies at one offset, two pages at least."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = table(spark, sf_dir, "events").withColumn("page", F.row_number().over(w)).withColumn("offset_", F.expr("event_id div 700"))
    return p.groupBy("user_id", "offset_").agg(F.min("page").cast("long").alias("first_page"), F.max("page").cast("long").alias("last_page"), F.count("*").alias("n")).where("n >= 2").drop("n")


@query("ledger_totals", """WITH r(grp, kind, codes) AS (VALUES ('open', 'equals', ['O']), ('closed', 'in', ['F', 'P']), ('not open', 'not', ['O'])) SELECT grp, sum(o_totalprice::DECIMAL(18,2)) AS total, count(*) AS n FROM orders, r WHERE CASE kind WHEN 'not' THEN NOT list_contains(codes, o_orderstatus) ELSE list_contains(codes, o_orderstatus) END GROUP BY grp""")
def ledger_totals(spark, sf_dir) -> DataFrame:
    """Account groups by rules (equals, in a list, not in it): accounts are summed first, so the rules meet few rows."""
    rules = {"open": ("equals", ["O"]), "closed": ("in", ["F", "P"]), "not open": ("not", ["O"])}
    by = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"), F.count("*").alias("c"))
    holds = lambda kind, codes: ~F.col("o_orderstatus").isin(codes) if kind == "not" else F.col("o_orderstatus").isin(codes)
    groups = F.filter(F.array(*[F.when(holds(*r), F.lit(g)) for g, r in rules.items()]), lambda x: x.isNotNull())
    return by.withColumn("grp", F.explode(groups)).groupBy("grp").agg(F.sum("t").alias("total"), F.sum("c").alias("n"))


@query("status_rollup", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'approved' WHEN bool_and(o_orderstatus = 'O') THEN 'not_started' WHEN bool_or(o_orderstatus = 'P') THEN 'in_progress' ELSE 'mixed' END AS status, bool_or(o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def status_rollup(spark, sf_dir) -> DataFrame:
    status = F.expr("case when bool_and(o_orderstatus = 'F') then 'approved' when bool_and(o_orderstatus = 'O') then 'not_started' when bool_or(o_orderstatus = 'P') then 'in_progress' else 'mixed' end")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(status.alias("status"), F.expr("bool_or(o_orderpriority = '1-URGENT')").alias("urgent"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("release_preview", """WITH b AS (SELECT p_brand, p_partkey // 1000 AS block, count(*) AS n, count(*) FILTER (p_size < 10) AS g, sha256(string_agg(p_partkey || ':' || p_size, ',' ORDER BY p_partkey)) AS h FROM part GROUP BY ALL)
SELECT p_brand, sum(n)::BIGINT AS facts, sum(g)::BIGINT AS gaps, sha256(string_agg(block || ':' || h, ',' ORDER BY block)) AS token FROM b GROUP BY p_brand""")
def release_preview(spark, sf_dir) -> DataFrame:
    """What a release would hold, with a token of exactly its content: blocks of keys are hashed first, then their hashes, so no group is gathered whole."""
    listed = lambda a, b: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda r: F.concat(r[a], F.lit(":"), r[b])), ","), 256)
    blocks = table(spark, sf_dir, "part").groupBy("p_brand", F.expr("p_partkey div 1000").alias("block")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") < 10).alias("g"), listed("p_partkey", "p_size").alias("h"))
    return blocks.groupBy("p_brand").agg(F.sum("n").alias("facts"), F.sum("g").alias("gaps"), listed("block", "h").alias("token"))


@query("printed_lookup", """WITH c AS (SELECT p_partkey, round(p_retailprice::DECIMAL(18,2), 1)::DECIMAL(18,1) AS cell FROM part), q AS (SELECT DISTINCT round(l_extendedprice::DECIMAL(18,2) / l_quantity::INTEGER, 1)::DECIMAL(18,1) AS printed FROM lineitem)
SELECT printed, count(*) FILTER (cell = printed) AS exact, count(*) FILTER (cell <> printed) AS near FROM q JOIN c ON abs(cell - printed) <= 0.1::DECIMAL(4,1) GROUP BY printed""")
def printed_lookup(spark, sf_dir) -> DataFrame:
    """Printed figures found among cells at their precision, one unit in the last place either way: an equi join on integers, three probes each."""
    cells = table(spark, sf_dir, "part").select((F.round(F.col("p_retailprice").cast("decimal(18,2)"), 1) * 10).cast("long").alias("cell"))
    asked = table(spark, sf_dir, "lineitem").select(F.expr("round(cast(cast(l_extendedprice as decimal(18,2)) / cast(l_quantity as int) as double), 1)").cast("decimal(18,1)").alias("printed")).distinct()
    probes = asked.withColumn("at", (F.col("printed") * 10).cast("long")).withColumn("slack", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    found = probes.join(cells, F.col("cell") == F.col("at") + F.col("slack"))
    return found.groupBy("printed").agg(F.count_if(F.col("slack") == 0).alias("exact"), F.count_if(F.col("slack") != 0).alias("near"))


@query("three_pass_pairs")
def three_pass_pairs(spark, sf_dir) -> DataFrame:
    """Lines of two channels paired by the whole key, then without the date, then by part alone; tested on small cases."""
    lines = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax").alias("id"), "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    other = lines.select(F.xxhash64("id").alias("other"), F.when(F.col("id") % 3 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("l_orderkey"), "l_partkey", "l_suppkey", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("l_shipdate")).alias("l_shipdate"))
    return staged_pairs(lines, other, "id", "other", [["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"], ["l_orderkey", "l_partkey"], ["l_partkey", "l_suppkey"]])


@query("box_pairs")
def box_pairs(spark, sf_dir) -> DataFrame:
    """Two readers' boxes on each page, paired by overlap."""
    parts = table(spark, sf_dir, "part")
    box = lambda shift: parts.select((F.col("p_partkey") % 100).alias("page"), F.col("p_partkey").alias("id"), *[(F.col("p_size") * k + (F.col("p_partkey") % 7) * shift + d).cast("double").alias(c) for c, k, d in (("x0", 3, 0), ("y0", 5, 0), ("x1", 3, 40), ("y1", 5, 25))])
    return best_boxes(box(0), box(1), "page")


@query("heading_order")
def heading_order(spark, sf_dir) -> DataFrame:
    """The heaviest rising run of each order's lines."""
    h = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("place"), F.col("l_quantity").alias("number"), F.lit(1.0).alias("weight"))
    return ordered_headings(h, "l_orderkey", "place", "number", "weight")


@query("reading_level", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN f = n THEN 'published' WHEN f > 0 THEN 'reviewed' WHEN p > 0 THEN 'read' ELSE 'located' END AS level FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def reading_level(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    level = F.expr("case when n is null then 'missing' when f = n then 'published' when f > 0 then 'reviewed' when p > 0 then 'read' else 'located' end")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", level.alias("level"))


@query("coverage_matrix", "SELECT r_name, count(DISTINCT o_custkey) FILTER (y = 1997) AS y1997, count(DISTINCT o_custkey) FILTER (y = 1998) AS y1998, count(DISTINCT o_custkey) FILTER (y = 1999) AS y1999 FROM (SELECT *, year(o_orderdate) AS y FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def coverage_matrix(spark, sf_dir) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    where = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    return seen.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(*[F.count_if(F.col("y") == y).alias(f"y{y}") for y in (1997, 1998, 1999)])


@query("applicable_rules", "WITH r AS (SELECT p_partkey, p_brand, 1995 + p_size % 5 AS a, CASE WHEN p_size % 3 > 0 THEN 1998 + p_size % 4 END AS b FROM part) SELECT p_brand, count(*) AS rules, arg_max(p_partkey, p_partkey) AS newest FROM r WHERE a <= 1998 AND coalesce(b, 9999) >= 1998 GROUP BY p_brand")
def applicable_rules(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("1995 + p_size % 5").alias("a"), F.expr("case when p_size % 3 > 0 then 1998 + p_size % 4 end").alias("b"))
    return r.where("a <= 1998 and coalesce(b, 9999) >= 1998").groupBy("p_brand").agg(F.count("*").alias("rules"), F.max("p_partkey").alias("newest"))


@query("source_decisions", """WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity::DECIMAL(18,2)) AS units, sum(l_extendedprice::DECIMAL(18,2)) AS claimed, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2))) AS approved FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, approved - claimed AS effect, round((approved / nullif(units, 0))::DOUBLE, 4) AS rate, (approved - claimed) / sum(approved - claimed) OVER (PARTITION BY l_suppkey) > 0.3 AS main FROM s WHERE approved <> claimed""")
def source_decisions(spark, sf_dir) -> DataFrame:
    """What each decision changed, at which rate, and whether it makes over three tenths of its supplier's change."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("units"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("claimed"), F.sum(F.expr("cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))")).alias("approved")).where("approved <> claimed")
    s = s.withColumn("effect", F.col("approved") - F.col("claimed"))
    net = F.sum("effect").over(Window.partitionBy("l_suppkey"))
    return s.select("l_suppkey", "l_returnflag", "effect", F.round(F.try_divide(F.col("approved").cast("double"), F.col("units").cast("double")), 4).alias("rate"), (F.col("effect").cast("double") / net.cast("double") > 0.3).alias("main"))


@query("completeness", "SELECT b.p_brand, t.p_type FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type FROM part) t WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_brand = b.p_brand AND x.p_type = t.p_type AND x.p_size > 45)")
def completeness(spark, sf_dir) -> DataFrame:
    """Members of a fixed family that a group lacks."""
    parts = table(spark, sf_dir, "part")
    expected = parts.groupBy("p_brand").agg(F.lit(1).alias("one")).crossJoin(F.broadcast(parts.select("p_type").distinct())).drop("one")  # the family is a closed list
    return expected.join(parts.where("p_size > 45"), ["p_brand", "p_type"], "left_anti")


@query("reading_order", "SELECT user_id, round(avg(CASE WHEN value >= before THEN 1.0::DOUBLE ELSE 0 END), 6) AS forward FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY user_id")
def reading_order(spark, sf_dir) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "value", before.alias("before")).where("before is not null").groupBy("user_id").agg(F.round(F.avg((F.col("value") >= F.col("before")).cast("double")), 6).alias("forward"))


@query("clause_pages", """WITH s AS (SELECT doc_id, source, len(regexp_extract_all(lower(text), 'tion')) + 5 * len(regexp_extract_all(text, '[0-9]{3,}')) AS score FROM documents) SELECT source, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS place FROM s WHERE score > 0) WHERE place <= 3""")
def clause_pages(spark, sf_dir) -> DataFrame:
    """The three pages of each source that speak most of a clause: words count 1, values 5."""
    score = (F.regexp_count(F.lower("text"), F.lit("tion")) + 5 * F.regexp_count("text", F.lit("[0-9]{3,}"))).cast("long")
    scored = table(spark, sf_dir, "documents").select("source", "doc_id", score.alias("score")).where("score > 0")
    return top_in_group(scored, ["source"], [F.col("score").desc(), F.col("doc_id")], 3)


@query("page_classes", """WITH s AS (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS lines, length(regexp_replace(text, '[^0-9#*$%&|<>]', '', 'g')) AS marks FROM documents) SELECT doc_id, CASE WHEN n < 40 THEN 'blank' WHEN marks > 0.05::DOUBLE * n THEN 'garbled' WHEN n / lines < 40 THEN 'table' WHEN lines > 20 THEN 'long text' ELSE 'text' END AS class FROM s""")
def page_classes(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.size(F.split("text", "\n", -1)).alias("lines"), F.length(F.regexp_replace("text", "[^0-9#*$%&|<>]", "")).alias("marks"))
    return s.select("doc_id", F.expr("case when n < 40 then 'blank' when marks > 0.05D * n then 'garbled' when n / lines < 40 then 'table' when lines > 20 then 'long text' else 'text' end").alias("class"))


@query("citations", "SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || strftime(o_orderdate, '%Y-%m-%d') || '), p. ' || (o_custkey % 90 + 1) AS citation FROM orders")
def citations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("Order %d (%s), p. %d", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey") % 90 + 1).alias("citation"))


@query("indian_grouping", "SELECT o_orderkey, regexp_replace(reverse(regexp_replace(reverse(substr(w, 1, greatest(length(w) - 3, 0))), '([0-9]{2})', '\\1,', 'g')) || ',' || right(w, 3), '^,+', '') || '.' || split_part(v, '.', 2) AS printed FROM (SELECT o_orderkey, (o_totalprice * 100)::DECIMAL(18,2)::VARCHAR AS v, split_part((o_totalprice * 100)::DECIMAL(18,2)::VARCHAR, '.', 1) AS w FROM orders)")
def indian_grouping(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.indian(F.expr("cast(o_totalprice * 100 as decimal(18,2))")).alias("printed"))
