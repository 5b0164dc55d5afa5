"""Work, decisions, drafts and twins, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import work
from ..registry import query
from ..sources.catalog import table
from .forms import _sql

_STATE = (
    "c_custkey", "c_custkey % 11 > 0 AS fetched", "c_custkey % 7 > 0 AS textlayer", "c_custkey % 3 > 0 AS layout", "c_custkey % 5 = 0 AS cloud", "c_custkey % 4 = 0 AS llm", "c_custkey % 6 > 1 AS verified", "c_custkey % 13 = 0 AS stale",
    "c_custkey % 8 > 0 AS indexed", "c_nationkey % 4 AS tables", "c_nationkey % 3 AS blank_pages", "c_nationkey AS shared", "c_custkey % 9 AS disagree",
)


@query("work_planned", f"""WITH s AS (SELECT {", ".join(_STATE)} FROM customer), r AS (SELECT * FROM s WHERE fetched AND textlayer),
w AS (SELECT c_custkey, 'fetch' AS kind, 'its pages were never fetched' AS reason FROM s WHERE NOT fetched UNION ALL SELECT c_custkey, 'parse:textlayer', 'its text layer was never read' FROM s WHERE fetched AND NOT textlayer
UNION ALL SELECT c_custkey, 'parse:layout', CASE WHEN tables = 0 THEN 'no table found by its text layer' ELSE 'blank pages in its text layer' END FROM r WHERE NOT layout AND (tables = 0 OR blank_pages > 0)
UNION ALL SELECT c_custkey, 'parse:cloud', 'readers differ on a fifth of shared figures' FROM r WHERE verified AND layout AND NOT cloud AND shared > 0 AND disagree > 0.2 * shared UNION ALL SELECT c_custkey, 'extract', 'its tables wait for extraction' FROM r WHERE NOT llm AND tables > 0
UNION ALL SELECT c_custkey, 'verify', CASE WHEN verified THEN 'read again since it was verified' ELSE 'never verified' END FROM r WHERE NOT verified OR stale UNION ALL SELECT c_custkey, 'index', 'never indexed' FROM r WHERE NOT indexed)
SELECT *, CASE WHEN kind = 'parse:cloud' AND row_number() OVER (PARTITION BY kind ORDER BY c_custkey) > 16 THEN 'budget' WHEN kind = 'extract' THEN 'no key' END AS blocked FROM w""")
def work_planned(spark, sf_dir) -> DataFrame:
    """What each document needs next, and what a key or the budget holds up."""
    return work.planned(table(spark, sf_dir, "customer").selectExpr(*_STATE), "c_custkey", {"parse:cloud": 0.6, "extract": 0.5}, {"parse:cloud": 10.0, "extract": 5.0}, ["parse:cloud"])


@query("review_decisions", """WITH d AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'approve' WHEN 'click' THEN 'correct' WHEN 'signup' THEN 'reject' ELSE 'leave' END AS outcome, 'r' || (event_id % 3) AS reviewer, value > 20 AS second FROM events),
l AS (SELECT *, sum(CASE outcome WHEN 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS level FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM l a WHERE outcome <> 'undo' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.level < a.level)),
f AS (SELECT *, CASE WHEN outcome IN ('approve', 'correct') AND second THEN reviewer END AS waiting FROM s WHERE n = 1),
g AS (SELECT s.user_id, arg_min(s.outcome, s.event_id) AS outcome, arg_min(s.reviewer, s.event_id) AS reviewer FROM s JOIN f USING (user_id) WHERE s.n > 1 AND s.reviewer <> f.waiting GROUP BY s.user_id)
SELECT user_id, CASE WHEN f.user_id IS NULL THEN 'open' WHEN g.user_id IS NULL AND waiting IS NOT NULL THEN 'awaiting_second_review' ELSE CASE coalesce(g.outcome, f.outcome) WHEN 'approve' THEN 'approved' WHEN 'correct' THEN 'corrected' WHEN 'reject' THEN 'rejected' ELSE 'unresolved' END END AS status, coalesce(g.reviewer, f.reviewer) AS reviewed_by
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN f USING (user_id) LEFT JOIN g USING (user_id)""")
def review_decisions(spark, sf_dir) -> DataFrame:
    """Candidates after decisions, second reviews and undos."""
    outcome = F.expr("case event_type when 'error' then 'undo' when 'view' then 'approve' when 'click' then 'correct' when 'signup' then 'reject' else 'leave' end")
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("reviewer"), "value")
    return work.decided(steps, ["user_id"], "event_id", "outcome", "reviewer", F.col("value") > 20)


@query("mapping_drafts", """WITH m AS (SELECT s_nationkey, s_name AS label, 'alias' AS kind, 'C.' || (s_suppkey % 5) AS code, NULL::VARCHAR AS note FROM supplier WHERE s_suppkey % 3 > 0),
d AS (SELECT s_nationkey, s_name AS label, CASE WHEN s_suppkey % 4 = 0 THEN 'not_a_line' ELSE 'alias' END AS kind, CASE WHEN s_suppkey % 4 > 0 THEN 'D.' || (s_suppkey % 7) END AS code, 'decided by ' || (s_suppkey % 2) || CASE WHEN s_suppkey % 5 = 0 THEN ': seen' ELSE '' END AS note FROM supplier WHERE s_suppkey % 2 = 0)
SELECT * FROM d UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.s_nationkey = m.s_nationkey AND d.label = m.label)""")
def mapping_drafts(spark, sf_dir) -> DataFrame:
    """The next version of each mapping, its decisions written in."""
    s = table(spark, sf_dir, "supplier")
    current = s.where("s_suppkey % 3 > 0").selectExpr("s_nationkey", "s_name as label", "'alias' as kind", "concat('C.', s_suppkey % 5) as code", "cast(null as string) as note")
    decisions = s.where("s_suppkey % 2 = 0").selectExpr("s_nationkey", "s_name as label", "case when s_suppkey % 4 = 0 then 'not_a_line' else 'alias' end as kind", "concat('D.', s_suppkey % 7) as code", "cast(s_suppkey % 2 as string) as decided_by", "case when s_suppkey % 5 = 0 then 'seen' end as note")
    return work.mapping_draft(current, decisions, ["s_nationkey"])


_BOX = "l_orderkey % 50 AS page, l_orderkey * 8 + l_linenumber AS id, (l_partkey * 13 % 400)::DOUBLE AS x0, (l_suppkey * 7 % 600)::DOUBLE AS y0, (l_partkey * 13 % 400 + 40 + l_linenumber * 10)::DOUBLE AS x1, (l_suppkey * 7 % 600 + 30 + l_quantity)::DOUBLE AS y1"


@query("strict_twins", f"""WITH a AS (SELECT DISTINCT {_BOX} FROM lineitem WHERE l_orderkey % 20 = 0 AND l_returnflag <> 'R'), b AS (SELECT DISTINCT {_BOX.replace("l_partkey * 13 % 400", "l_partkey * 13 % 400 + 6")} FROM lineitem WHERE l_orderkey % 20 = 0 AND l_linestatus = 'O'),
m AS (SELECT a.page, a.id, b.id AS other, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS area FROM a JOIN b ON a.page = b.page),
t AS (SELECT page, id, arg_max(other, common / (area - common) * 1e9 - other / 1e6) AS chosen FROM m WHERE common / (area - common) >= 0.5 GROUP BY page, id)
SELECT page, id, chosen FROM (SELECT page, id FROM a) LEFT JOIN t USING (page, id)""")
def strict_twins(spark, sf_dir) -> DataFrame:
    """Tables of a loose reading and the strict reading's tables that stand for them."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 20 = 0")
    box = lambda df, shift: df.selectExpr("l_orderkey % 50 as page", "l_orderkey * 8 + l_linenumber as id", f"double(l_partkey * 13 % 400 + {shift}) as x0", "double(l_suppkey * 7 % 600) as y0", f"double(l_partkey * 13 % 400 + {shift} + 40 + l_linenumber * 10) as x1", "double(l_suppkey * 7 % 600 + 30 + l_quantity) as y1").distinct()
    return work.twins(box(lines.where("l_returnflag <> 'R'"), 0), box(lines.where("l_linestatus = 'O'"), 6), ["page"], ["x0", "y0", "x1", "y1"], "id")


@query("worked_examples", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 5 THEN 'gives nothing' WHEN l_linenumber = 4 THEN 'expects nothing' WHEN l_linenumber = 3 THEN 'gives ' || round(l_quantity * 2, 2)::DECIMAL(12,2) END AS problem FROM lineitem""")
def worked_examples(spark, sf_dir) -> DataFrame:
    """Rules against their worked examples."""
    rows = table(spark, sf_dir, "lineitem").withColumn("expected", F.when(F.col("l_linenumber") != 4, (F.col("l_quantity") * 2 + F.when(F.col("l_linenumber") == 3, 0.01).otherwise(0.0)).cast("decimal(12,4)")))
    made = F.when(F.col("l_linenumber") != 5, (F.col("l_quantity") * 2).cast("decimal(12,4)"))
    return work.worked_examples(rows, made, "expected", 2).select("l_orderkey", "l_linenumber", "l_partkey", "problem")


@query("leases_extended", """WITH j AS (SELECT o_orderkey, o_custkey % 3 AS run, CASE WHEN o_orderstatus = 'O' THEN 'leased' ELSE 'queued' END AS status, o_custkey % 100 AS lease_expires FROM orders), b AS (SELECT l_orderkey, l_suppkey % 3 AS run, max(l_partkey % 200) AS beat FROM lineitem GROUP BY ALL)
SELECT o_orderkey, CASE WHEN status = 'leased' THEN greatest(lease_expires, coalesce(beat + 60, lease_expires)) ELSE lease_expires END AS lease_expires FROM j LEFT JOIN b ON l_orderkey = o_orderkey AND b.run = j.run""")
def leases_extended(spark, sf_dir) -> DataFrame:
    """Leases after the heartbeats of the runs that hold them (Q4)."""
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 3 as run", "case when o_orderstatus = 'O' then 'leased' else 'queued' end as status", "o_custkey % 100 as lease_expires")
    beats = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_suppkey % 3 as run", "l_partkey % 200 as at")
    return work.extended(jobs, beats, "o_orderkey", "run", "at", 60).select("o_orderkey", "lease_expires")


_FINAL = "l_returnflag <> 'R' AND l_linenumber < 6"


@query("releases_made", f"""WITH c AS (SELECT l_suppkey, {_FINAL} AS final, l_returnflag = 'A' AND l_quantity > 49 AND l_suppkey % 4 = 0 AS blocked FROM lineitem), s AS (SELECT l_suppkey, count(*) FILTER (final) AS n FROM c GROUP BY l_suppkey HAVING count(*) FILTER (final) > 0 AND count(*) FILTER (final AND blocked) = 0),
r AS (SELECT s_suppkey, k, CASE WHEN k < s_suppkey % 3 THEN k + 1 END AS superseded_by FROM supplier, (VALUES (1), (2)) v(k) WHERE k <= s_suppkey % 3)
SELECT s_suppkey AS l_suppkey, k AS release, CASE WHEN k = s_suppkey % 3 AND s_suppkey IN (SELECT l_suppkey FROM s) THEN k + 1 ELSE superseded_by END AS superseded_by, NULL::BIGINT AS facts FROM r UNION ALL SELECT l_suppkey, l_suppkey % 3 + 1, NULL, n FROM s""")
def releases_made(spark, sf_dir) -> DataFrame:
    """New releases of sources with nothing in the way, and those that they supersede."""
    lines = table(spark, sf_dir, "lineitem")
    final = F.expr(_FINAL)
    state = work.release_state(lines, ["l_suppkey"], final, F.col("l_returnflag") == "R", (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49) & (F.col("l_suppkey") % 4 == 0))
    had = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.expr("array(1L, 2L)")).alias("release")).where("release <= l_suppkey % 3").withColumn("superseded_by", F.expr("case when release < l_suppkey % 3 then release + 1 end"))
    facts, releases = work.released(lines, state, had, ["l_suppkey"], final)
    return releases.join(facts.groupBy("l_suppkey", "release").agg(F.count("*").alias("facts")), ["l_suppkey", "release"], "left")


#: line: (number, categories) of each provision in it
PROVISIONS = {
    "3. The rates of LMV - 2 and HV-1 apply to all supply": [("3", "HV-1 LMV-2")],
    "As in 20(f) The regulatory discount shall not apply": [("20(f)", "")],
    "4) (Applies) with 5(a) Consumers of LT shall pay the minimum": [("4", "LT"), ("5(a)", "LT")],
    "3. lower case is prose and no provision": [],
    "2. Short": [],
    "Rate of LMV-1": [],
}
_LINES = ", ".join(f"({i}, {_sql(number)}, {_sql(codes)})" for i, found in enumerate(PROVISIONS.values()) for number, codes in found)


@query("conditions_extracted", f"""WITH f AS (SELECT p_size, min(p_partkey % 10) AS first FROM part WHERE p_brand = 'Brand#4' GROUP BY p_size)
SELECT p_partkey, number, categories FROM part JOIN (VALUES {_LINES}) v(i, number, categories) ON i = p_partkey % {len(PROVISIONS)} LEFT JOIN f USING (p_size) WHERE first IS NULL OR p_partkey % 10 <= first""")
def conditions_extracted(spark, sf_dir) -> DataFrame:
    """Provisions before a document's first schedule, with the categories that they name (X18; footnotes and clauses are other queries')."""
    text = F.get(F.array(*map(F.lit, PROVISIONS)), (F.col("p_partkey") % len(PROVISIONS)).cast("int"))
    lines = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 10).alias("page"), "p_partkey", "p_brand", text.alias("text"))
    out = work.conditions(lines, ["p_size"], "page", "p_partkey", "text", lines.where("p_brand = 'Brand#4'"))
    return out.select("p_partkey", "number", F.concat_ws(" ", "categories").alias("categories"))
