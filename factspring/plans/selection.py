"""What is taken, linked or let through, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import amended
from ..operators import selection as s
from ..registry import query
from ..sources.catalog import FACTS_SQL, facts, table

_PAGES = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, event_type = 'purchase' AS tabled, event_type <> 'error' AS readable FROM events)"


@query("chosen_pages", f"""WITH {_PAGES},
n AS (SELECT a.user_id, a.page, min(abs(a.page - t.page) * 1000000 + t.page * 2 + CASE WHEN a.page > t.page THEN 1 ELSE 0 END) AS k, min(abs(a.page - t.page)) AS d FROM p a JOIN p t ON a.user_id = t.user_id AND t.tabled AND abs(a.page - t.page) <= 1 WHERE a.readable GROUP BY ALL)
SELECT user_id, page, CASE d WHEN 0 THEN 'table' ELSE 'beside a table' END AS why FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) <= 12
UNION ALL SELECT user_id, page, 'no text' FROM p WHERE NOT readable QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY page) <= 3""")
def chosen_pages(spark, sf_dir) -> DataFrame:
    """Pages to convert under a cap: tables, their neighbours, some pages without text."""
    pages = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("page"))
    return s.chosen_pages(pages, ["user_id"], "page", F.col("event_type") == "purchase", F.col("event_type") != "error", 12, 3)


@query("profiles_detected", """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN a > r THEN 'lettered' WHEN r > a THEN 'numbered' END AS profile, CASE WHEN greatest(a, r) = 0 THEN 'no headings of a known kind' WHEN a = r THEN 'a tie of lettered, numbered' ELSE greatest(a, r) || ' headings' END AS why FROM c""")
def profiles_detected(spark, sf_dir) -> DataFrame:
    """The reading profile that a document's headings name."""
    return s.profile(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), ["l_suppkey"], "l_returnflag", {"A": "lettered", "R": "numbered"})


@query("budget_refusals", """WITH e AS (SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 300 WHEN 'click' THEN 500 END AS cap, value::DECIMAL(10,2) AS est,
 coalesce(sum(value::DECIMAL(10,2)) OVER (PARTITION BY ts::DATE ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total, coalesce(sum(value::DECIMAL(10,2)) OVER (PARTITION BY ts::DATE, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mine FROM events)
SELECT event_id, CASE WHEN total + est > 2000 THEN 'over the daily cap' WHEN mine + est > cap THEN 'over its own cap' END AS refused FROM e""")
def budget_refusals(spark, sf_dir) -> DataFrame:
    """Requests that would pass a day's budget or that of their agent (Q11)."""
    cost = F.col("value").cast("decimal(10,2)")
    requests = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return s.budgeted(requests, ["day"], "event_type", ["event_id"], cost, cost, 2000, {"signup": 300, "click": 500}).select("event_id", "refused")


@query("fenced_writes", "SELECT l_orderkey, l_linenumber, coalesce(l_linenumber % 3 = o_custkey % 3, false) AS accepted FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O'")
def fenced_writes(spark, sf_dir) -> DataFrame:
    """Writes of runs that still hold their job (Q3)."""
    writes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).cast("long").alias("run"))
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 3).alias("run"))
    return s.fenced(writes, jobs, "l_orderkey", "run").select("l_orderkey", "l_linenumber", "accepted")


_CHAIN = ["signup", "view", "click", "purchase"]


@query("stage_chaining", "SELECT user_id, CASE max(list_position(['signup', 'view', 'click', 'purchase'], event_type)) WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'purchase' END AS event_type FROM events WHERE event_id % 37 = 0 AND event_type <> 'error' GROUP BY user_id HAVING max(list_position(['signup', 'view', 'click', 'purchase'], event_type)) < 4")
def stage_chaining(spark, sf_dir) -> DataFrame:
    """The stage that each document's furthest stage enqueues (Q8)."""
    return s.next_stages(table(spark, sf_dir, "events").where("event_id % 37 = 0"), ["user_id"], "event_type", _CHAIN)


@query("envelope_limits", "SELECT lang, source, count(*) AS rows, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, CASE WHEN count(*) > 20 OR sum(octet_length(encode(coalesce(text, '')))) > 60000 THEN 413 ELSE 200 END AS status FROM documents GROUP BY lang, source")
def envelope_limits(spark, sf_dir) -> DataFrame:
    """Batches with too many rows or bytes."""
    return s.enveloped(table(spark, sf_dir, "documents"), ["lang", "source"], F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), 20, 60000)


@query("library_slots", """WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
h AS (SELECT o_custkey, year(o_orderdate) AS y, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS holder FROM orders WHERE o_orderpriority < '3' GROUP BY ALL), f AS (SELECT o_custkey, y, min(o_orderkey) AS first FROM s GROUP BY ALL)
SELECT o_custkey, y, o_orderkey, CASE WHEN holder = o_orderkey THEN 'already' WHEN holder IS NOT NULL OR first <> o_orderkey THEN 'held by another' WHEN h.o_custkey IS NOT NULL THEN 'linked' ELSE 'created' END AS state FROM s JOIN f USING (o_custkey, y) LEFT JOIN h USING (o_custkey, y)""")
def library_slots(spark, sf_dir) -> DataFrame:
    """Sources and the slots that expect them."""
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    slots = orders.where("o_orderpriority < '3'").select("o_custkey", "y", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("o_orderkey"))
    return s.reconciled(orders.where("o_orderstatus <> 'P'").select("o_custkey", "y", "o_orderkey"), slots, ["o_custkey", "y"], "o_orderkey")


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9%.:]+', ' ', 'g'))"


@query("unlinked_conditions", f"""WITH k AS (SELECT DISTINCT {_PLAIN.format("text")} AS t FROM benchmark UNION SELECT p_name FROM part WHERE p_partkey % 11 = 0),
c AS (SELECT p_partkey, {_PLAIN.format("CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN concat(substr(text, 5, 20), 'q', p_partkey) ELSE substr(text, (1 + p_partkey % 60)::INTEGER, (4 + p_partkey % 40)::INTEGER) END")} AS condition FROM part JOIN benchmark ON item_id = p_partkey % 20)
SELECT p_partkey, condition FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE t = condition OR (length(condition) >= 12 AND contains(t, condition)))""")
def unlinked_conditions(spark, sf_dir) -> DataFrame:
    """Conditions that no recorded text holds."""
    told, part = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "part")
    known = told.select(amended(F.col("text")).alias("t")).union(part.where("p_partkey % 11 = 0").select("p_name"))
    cited = F.expr("case when p_partkey % 4 = 0 then p_name when p_partkey % 7 = 0 then concat(substr(text, 5, 20), 'q', p_partkey) else substr(text, int(1 + p_partkey % 60), int(4 + p_partkey % 40)) end")
    conditions = part.join(told, told.item_id == part.p_partkey % 20).select("p_partkey", amended(cited).alias("condition"))
    return s.unlinked(conditions, "condition", known, "t")


@query("publication_scope", """SELECT l_orderkey, l_linenumber, (l_returnflag = 'A') OR CASE WHEN l_linestatus = 'O' THEN coalesce(CASE WHEN l_linenumber < 6 THEN 'LMV-' || l_linenumber END, '') IN ('LMV-1', 'LMV-3') ELSE l_linenumber % 2 = 0 END AS included,
 l_tax < 0.05 AND l_discount < 0.05 AS publishable FROM lineitem""")
def publication_scope(spark, sf_dir) -> DataFrame:
    """Candidates within what is published, and those that may be (P20)."""
    family = F.when(F.col("l_linestatus") == "O", "retail_tariff").when(F.col("l_linenumber") % 2 == 0, "wheeling_charge").otherwise("oa_loss")
    category = F.when(F.col("l_linenumber") < 6, F.concat(F.lit("LMV-"), "l_linenumber"))
    scope = F.when(F.col("l_returnflag") == "A", "whole_schedule").otherwise("items")
    may = s.publishable(F.when(F.col("l_tax") < 0.05, "approved").otherwise("open"), F.when(F.col("l_discount") < 0.05, "done").otherwise("pending"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.in_scope(scope, family, category, ["LMV-1", "LMV-3"], ["wheeling_charge"]).alias("included"), may.alias("publishable"))


@query("included_regions", "WITH n AS (SELECT l_orderkey, arg_max(l_returnflag = 'R', l_linenumber * 2 + (l_returnflag = 'R')::INTEGER) AS gone FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE NOT coalesce(gone, false)")
def included_regions(spark, sf_dir) -> DataFrame:
    """Regions that their reviewer's last note doesn't exclude."""
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_returnflag") == "R").alias("excluded"))
    return s.included(table(spark, sf_dir, "orders").select("o_orderkey"), notes, "o_orderkey", "l_linenumber", "excluded")


@query("document_order", """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 10 ELSE 50 END, l_orderkey % 9, l_linenumber, coalesce(CASE WHEN l_linestatus = 'O' THEN 'LMV-1' END, ''), CASE WHEN l_tax > 0.04 THEN 0 ELSE 2 END, l_quantity::INTEGER, l_orderkey) AS place FROM lineitem""")
def document_order(spark, sf_dir) -> DataFrame:
    """Candidates of a source in the order of its pages (T4)."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "retail_tariff").when(F.col("l_returnflag") == "N", "wheeling_charge").otherwise("none").alias("family"), (F.col("l_orderkey") % 9).alias("page"),
        F.when(F.col("l_linestatus") == "O", "LMV-1").alias("category"), F.when(F.col("l_tax") > 0.04, "fixed").otherwise("energy").alias("component"), F.col("l_quantity").cast("int").alias("row"), F.lit(None).cast("int").alias("none"),
    )
    keys = s.document_keys("family", "page", "l_linenumber", "category", "component", "row", "none", "none", "l_orderkey")
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)).cast("long").alias("place"))


@query("findings_by_severity", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts::DATE DESC, event_id DESC) AS place FROM events")
def findings_by_severity(spark, sf_dir) -> DataFrame:
    """Findings of each agent, those that block first (T5)."""
    severity = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "click", "warn").otherwise("info")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", severity.alias("severity"), F.to_date("ts").alias("raised"))
    return rows.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*s.severity_keys("severity", "raised", "event_id"))).cast("long").alias("place"))


@query("label_search", f"""WITH {FACTS_SQL}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> '') AS l, list_filter(regexp_split_to_array(lower(concat_ws(' ', label, head, voice)), '[^a-z0-9]+'), lambda x: x <> '') AS a FROM facts)
SELECT fact_id, len(list_filter(l, lambda x: x IN ('high', 'power')))::DOUBLE / greatest(len(l), 1) AS score FROM w WHERE list_contains(a, 'high') AND list_contains(a, 'power') ORDER BY score DESC, order_year DESC, fact_id DESC LIMIT 40""")
def label_search(spark, sf_dir) -> DataFrame:
    """The forty facts whose labels answer a question best, the latest orders first (V3)."""
    rows = facts(spark, sf_dir).withColumn("head", F.regexp_replace("head", "_", " ")).withColumn("voice", F.regexp_replace("voice", "_", " "))
    return s.found_by_words(rows, ["high", "power"], ["label", "head", "voice"], ["label"], [F.col("order_year").desc(), F.col("fact_id").desc()], 40).select("fact_id", "score")


@query("search_modes", "SELECT count(*) AS total, count(*) FILTER (label > 100000) AS embedded, 'full_text' AS mode, 'no chunk has an embedding yet' AS why FROM embeddings UNION ALL SELECT count(*), count(*), 'hybrid', NULL FROM embeddings UNION ALL SELECT 0, 0, 'full_text', 'nothing has been indexed yet'")
def search_modes(spark, sf_dir) -> DataFrame:
    """How a search runs, and why not better (V4): no embeddings, all, no chunks."""
    chunks = table(spark, sf_dir, "embeddings")
    return s.search_mode(chunks, F.col("label") > 100000).unionByName(s.search_mode(chunks, F.col("embedding").isNotNull())).unionByName(s.search_mode(chunks.where("vec_id < -1"), F.lit(True)))
