"""Contracts, replay, queues, validators and the small readings of headings and lines, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import review
from ..operators.latest import top_in_group
from ..operators.review import Field
from ..quality import findings as v
from ..registry import query
from ..sources.catalog import table
from .forms import _values

ORDER_CONTRACT = [Field("o_custkey"), Field("o_orderstatus", among=("O", "F")), Field("o_totalprice", low=20000, high=300000), Field("o_orderpriority", like="^[1-4]-")]


@query("contract_rejects", """SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'o_custkey: missing' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus: not one of O, F' WHEN o_totalprice < 20000 THEN 'o_totalprice: under 20000' WHEN o_totalprice > 300000 THEN 'o_totalprice: over 300000' WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o_orderpriority: malformed' END AS reason FROM orders""")
def contract_rejects(spark, sf_dir) -> DataFrame:
    """Rows against a contract of fields: the first fault of each."""
    return table(spark, sf_dir, "orders").select("o_orderkey", review.reject_reason(ORDER_CONTRACT).alias("reason"))


@query("replay_marked", """WITH m AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS since FROM events GROUP BY user_id)
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events JOIN m USING (user_id) WHERE since IS NULL OR event_id >= since GROUP BY user_id, event_type""")
def replay_marked(spark, sf_dir) -> DataFrame:
    """Rows of each user from the last marker on, the last of each kind."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return review.replayed(rows, ["user_id"], ["user_id", "event_type"], "event_id", F.col("event_type") == "error")


_JOBS = """j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'leased' ELSE 'done' END AS status, o_orderkey % 4 AS attempts, 3 AS max_attempts, o_orderpriority AS priority, o_orderdate AS created,
  CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE o_orderkey % 200 END AS run_after, o_custkey % 200 AS lease_expires, o_orderkey % 5 <> 0 AS retryable FROM orders)"""


def _jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs; times are whole numbers here."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case o_orderstatus when 'O' then 'queued' when 'P' then 'leased' else 'done' end as status", "o_orderkey % 4 as attempts", "3 as max_attempts", "o_orderpriority as priority", "o_orderdate as created",
        "case when o_orderkey % 3 = 0 then 100 else o_orderkey % 200 end as run_after", "o_custkey % 200 as lease_expires", "o_orderkey % 5 <> 0 as retryable",
    )


@query("queue_claim", f"WITH {_JOBS} SELECT id, CASE WHEN attempts + 1 > max_attempts THEN 'retries_exhausted' WHEN status = 'leased' THEN 'lease_expired_reclaimed' ELSE 'claimed' END AS event FROM j WHERE (status = 'queued' AND run_after <= 100) OR (status = 'leased' AND lease_expires < 100) ORDER BY priority, created, id LIMIT 200")
def queue_claim(spark, sf_dir) -> DataFrame:
    """The next 200 jobs: queued ones whose time has come and leased ones whose lease ran out."""
    return review.claim(_jobs(spark, sf_dir), F.lit(100), 200)


@query("queue_retry", f"WITH {_JOBS} SELECT id, CASE WHEN retryable AND attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status, CASE WHEN retryable AND attempts < max_attempts THEN TIMESTAMP '2024-04-01 00:00:00' + to_seconds(least(200, 60 * pow(2, attempts))::BIGINT) END AS run_after FROM j")
def queue_retry(spark, sf_dir) -> DataFrame:
    """Every job after a failure: queued again after a growing delay, or failed."""
    return review.failed(_jobs(spark, sf_dir), F.lit("2024-04-01 00:00:00").cast("timestamp"), 60, 200)


@query("stage_invalidation", "WITH r AS (SELECT l_orderkey, min(l_linenumber) AS since FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) SELECT l_orderkey, l_linenumber, coalesce(l_linenumber > since, false) AS stale FROM lineitem LEFT JOIN r USING (l_orderkey)")
def stage_invalidation(spark, sf_dir) -> DataFrame:
    """Stages of a document that come after one that runs again."""
    states = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return review.invalidated(states, ["l_orderkey"], "l_linenumber", states.where("l_returnflag = 'R'")).select("l_orderkey", "l_linenumber", "stale")


@query("review_queue", "SELECT l_suppkey, count(*) AS n, bool_or(l_linestatus = 'O') AS fixture, count(*) FILTER (l_returnflag = 'A') AS route_a, count(*) FILTER (l_returnflag = 'N') AS route_n, count(*) FILTER (l_returnflag = 'R') AS route_r, count(DISTINCT l_linenumber) AS categories FROM lineitem GROUP BY l_suppkey")
def review_queue(spark, sf_dir) -> DataFrame:
    return review.queue_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_linestatus") == "O", "l_returnflag", ["A", "N", "R"], "l_linenumber")


_CANDIDATES = """c AS (SELECT l_suppkey, l_linenumber % 3 AS blocking, l_linenumber AS findings, l_returnflag = 'R' AS disagree, CASE WHEN l_tax > 0.04 THEN ['tax', 'late'] WHEN l_tax > 0.02 THEN ['tax'] ELSE []::VARCHAR[] END AS tags, l_linestatus = 'O' AS unapproved,
  CASE WHEN l_discount > 0.06 THEN 'low' WHEN l_discount > 0.03 THEN 'high' END AS confidence, l_returnflag AS family, NULL::VARCHAR AS category, lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber AS key, CASE WHEN l_quantity > 10 THEN l_linenumber END AS evidence FROM lineitem)"""


def _candidates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey", "l_linenumber % 3 as blocking", "l_linenumber as findings", "l_returnflag = 'R' as disagree", "case when l_tax > 0.04D then array('tax', 'late') when l_tax > 0.02D then array('tax') else cast(array() as array<string>) end as tags",
        "l_linestatus = 'O' as unapproved", "case when l_discount > 0.06D then 'low' when l_discount > 0.03D then 'high' end as confidence", "l_returnflag as family", "cast(null as string) as category", "concat(lpad(l_orderkey, 12, '0'), '-', l_linenumber) as key", "case when l_quantity > 10 then l_linenumber end as evidence",
    )


@query("risk_queue", f"""WITH {_CANDIDATES} SELECT l_suppkey, key, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY blocking DESC, findings DESC, CASE WHEN disagree THEN 0 ELSE 1 END, len(tags) DESC, CASE WHEN unapproved THEN 0 ELSE 1 END, CASE confidence WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END, family, coalesce(category, ''), key)::INTEGER AS place FROM c) WHERE place <= 5""")
def risk_queue(spark, sf_dir) -> DataFrame:
    """The five riskiest candidates of each source by nine keys."""
    keys = review.risk_keys("blocking", "findings", F.col("disagree"), F.col("tags"), F.col("unapproved"), F.col("confidence"), "family", "category", "key")
    return top_in_group(_candidates(spark, sf_dir), ["l_suppkey"], keys, 5).select("l_suppkey", "key", "place")


@query("batch_eligible", f"WITH {_CANDIDATES} SELECT key, CASE WHEN blocking > 0 THEN blocking || ' blocking findings' WHEN coalesce(confidence, '') <> 'high' THEN 'confidence is not high' WHEN disagree THEN 'the channels disagree' WHEN coalesce(evidence, 0) = 0 THEN 'no evidence' END AS refusal FROM c")
def batch_eligible(spark, sf_dir) -> DataFrame:
    """Why a candidate may not be approved in a batch."""
    return _candidates(spark, sf_dir).select("key", review.batch_refusal("blocking", "confidence", F.col("disagree"), "evidence").alias("refusal"))


@query("grid_continues", """WITH g AS (SELECT l_suppkey AS doc, l_orderkey // 4 AS page, l_orderkey * 10 + l_linenumber AS ordinal, l_linenumber % 3 AS cols, bool_or(l_returnflag = 'R') AS headed FROM lineitem GROUP BY ALL), b AS (SELECT *, lag(page) OVER w AS p, lag(cols) OVER w AS c FROM g WINDOW w AS (PARTITION BY doc ORDER BY page, ordinal))
SELECT doc, ordinal, coalesce(page = p + 1 AND NOT headed AND cols = c, false) AS continues FROM b""")
def grid_continues(spark, sf_dir) -> DataFrame:
    """Grids without a header that go on where the page before ended."""
    grids = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as doc", "l_orderkey div 4 as page", "l_orderkey * 10 + l_linenumber as ordinal", "l_linenumber % 3 as cols", "l_returnflag = 'R' as headed").groupBy("doc", "page", "ordinal", "cols").agg(F.bool_or("headed").alias("headed"))
    return review.continued(grids, ["doc"], "page", "ordinal", "cols", "headed").select("doc", "ordinal", "continues")


@query("applied_norms", "SELECT l_suppkey, l_linenumber, year, voice, value FROM (SELECT l_suppkey, l_linenumber, year(l_shipdate)::INTEGER AS year, l_returnflag AS voice, l_extendedprice::DECIMAL(18,2) AS value, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY year(l_shipdate) DESC, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END, l_extendedprice DESC) AS rn FROM lineitem WHERE l_returnflag IN ('A', 'R')) WHERE rn = 1")
def applied_norms(spark, sf_dir) -> DataFrame:
    """Of each licensee and line the norm of the latest year, in it the strongest voice's."""
    norms = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("voice"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return review.applied_norms(norms, ["l_suppkey", "l_linenumber"], "year", "voice", ["A", "R"], "value")


@query("word_columns", """WITH w AS (SELECT user_id, event_id, value::DOUBLE AS x FROM events), n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 5 THEN 1 ELSE 0 END AS new FROM w)
SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS "column" FROM n WHERE x IS NOT NULL""")
def word_columns(spark, sf_dir) -> DataFrame:
    """Words of a page put in columns by gaps between their edges."""
    words = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").cast("double").alias("x")).where("x is not null")
    return review.by_gaps(words, ["user_id"], "x", 5).select("user_id", "event_id", "column")


@query("cross_representation", """WITH s AS (SELECT o_orderkey AS k, round(o_totalprice::DECIMAL(18,2) / 4, 0) AS v FROM orders), d AS (SELECT l_orderkey AS k, min(round(l_extendedprice::DECIMAL(18,2), 0)) AS lo, max(round(l_extendedprice::DECIMAL(18,2), 0)) AS hi FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag <> 'R' GROUP BY l_orderkey)
SELECT k, CASE WHEN lo IS NULL THEN 'not there' WHEN lo <> hi THEN 'several' WHEN abs(v - lo) <= 4000 THEN 'agrees' ELSE 'differs' END AS state FROM s LEFT JOIN d USING (k)""")
def cross_representation(spark, sf_dir) -> DataFrame:
    """A summary's figures against the schedule's of the same keys."""
    summary = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice").cast("decimal(18,2)") / 4, 0).alias("v"))
    schedule = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), F.round(F.col("l_extendedprice").cast("decimal(18,2)"), 0).alias("v"))
    return review.cross_checked(summary, schedule, ["k"], "v", 4000).select("k", "state")


_PRICED = {"A": ("kWh", "kVAh"), "R": ("kW", "kVA")}


@query("validators_more", """WITH l AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'kWh' WHEN 1 THEN 'kVAh' WHEN 2 THEN 'kW' ELSE 'kVA' END AS per FROM lineitem)
SELECT 'option_groups' AS validator, CASE WHEN count(DISTINCT p_size) < 2 THEN 'blocking' ELSE 'info' END AS severity, p_brand AS key, count(DISTINCT p_size) || ' alternatives' AS message FROM part WHERE p_size > 40 GROUP BY p_brand
UNION ALL SELECT 'role_separation', 'blocking', l_orderkey || '|' || l_suppkey, count(DISTINCT l_returnflag) || ' roles' FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT 'component_units', 'blocking', l_orderkey || '|' || l_linenumber, l_returnflag || ' priced per ' || per FROM l WHERE (l_returnflag = 'A' AND per IN ('kW', 'kVA')) OR (l_returnflag = 'R' AND per IN ('kWh', 'kVAh'))
UNION ALL SELECT 'derivation', CASE WHEN l_quantity > 45 THEN 'warning' ELSE 'blocking' END, l_orderkey || '|' || l_linenumber, CASE WHEN l_quantity > 45 THEN 'inputs incomplete' ELSE 'the inputs give another figure' END FROM lineitem WHERE l_quantity > 45 OR l_linenumber = 7
UNION ALL SELECT 'completeness', 'blocking', s_suppkey || '|' || f, 'no candidate and no disposition' FROM (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem), (VALUES ('A'), ('N'), ('R'), ('Z')) x(f) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = f) AND NOT (f = 'Z' AND s_suppkey % 2 = 0)""")
def validators_more(spark, sf_dir) -> DataFrame:
    """Option groups, separate roles, units of components, recomputed derivations and required families."""
    lines = table(spark, sf_dir, "lineitem").withColumn("per", F.expr("case l_linenumber % 4 when 0 then 'kWh' when 1 then 'kVAh' when 2 then 'kW' else 'kVA' end"))
    line = F.concat_ws("|", "l_orderkey", "l_linenumber")
    derived = lines.withColumn("printed", F.expr("l_extendedprice + case when l_linenumber = 7 then 5 else 0 end"))
    families = lines.select("l_suppkey", F.col("l_returnflag").alias("family"))
    disposed = lines.where("l_suppkey % 2 = 0").select("l_suppkey", F.lit("Z").alias("family")).distinct()
    return v.together([
        v.option_groups(table(spark, sf_dir, "part").withColumn("option", F.expr("case when p_size > 40 then p_size end")), "p_brand", "option"), v.roles_apart(lines, ["l_orderkey", "l_suppkey"], "l_returnflag"), v.priced_per(lines, line, "l_returnflag", "per", _PRICED),
        v.recomputed(derived, line, "printed", F.expr("case when l_quantity <= 45 then l_extendedprice / l_quantity * l_quantity end"), 2), v.families_complete(families, "l_suppkey", "family", ["A", "N", "R", "Z"], disposed),
    ])


@query("schedule_matrix", "SELECT p_size, count(*) FILTER (p_brand = 'Brand#11') AS \"Brand#11\", count(*) FILTER (p_brand = 'Brand#12') AS \"Brand#12\", count(*) FILTER (p_brand = 'Brand#13') AS \"Brand#13\" FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY p_size")
def schedule_matrix(spark, sf_dir) -> DataFrame:
    """Rules of each schedule side by side across commissions."""
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).groupBy("p_size").pivot("p_brand", ["Brand#11", "Brand#12", "Brand#13"]).agg(F.count("p_partkey")).na.fill(0)


@query("document_inventory", "SELECT source, count(*) AS pages, count(*) FILTER (coalesce(trim(text), '') <> '') AS with_text, count(DISTINCT lang) AS languages, max(n_chars) AS longest FROM documents GROUP BY source")
def document_inventory(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("with_text"), F.count_distinct("lang").alias("languages"), F.max("n_chars").alias("longest"))


@query("flag_counts", "SELECT flag, count(*) AS grids FROM (SELECT unnest([CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_discount = 0 THEN 'no discount' END, l_returnflag]) AS flag FROM lineitem) WHERE flag IS NOT NULL GROUP BY flag")
def flag_counts(spark, sf_dir) -> DataFrame:
    """Grids by flag, a grid under each that it has."""
    flags = F.array(F.expr("case when l_tax > 0.05D then 'tax' end"), F.expr("case when l_discount = 0 then 'no discount' end"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.explode(flags).alias("flag")).where("flag is not null").groupBy("flag").agg(F.count("*").alias("grids"))


@query("agreement_flags", "SELECT o_custkey, max(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 1 ELSE 0 END)::INTEGER AS agrees FROM orders GROUP BY o_custkey")
def agreement_flags(spark, sf_dir) -> DataFrame:
    """Whether any order of a group has an agreeing line."""
    agreeing = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return table(spark, sf_dir, "orders").join(agreeing, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.max(F.col("l_orderkey").isNotNull().cast("int")).alias("agrees"))


@query("call_costs", "SELECT user_id, round(sum(round((event_id::DECIMAL(20,0) * 3.0::DECIMAL(12,6) + (event_id % 7)::DECIMAL(20,0) * 15.0::DECIMAL(12,6)) / 1000000, 6)), 6)::DOUBLE AS dollars FROM events GROUP BY user_id")
def call_costs(spark, sf_dir) -> DataFrame:
    """Spend by user at prices for a million tokens."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(texts.token_cost(F.col("event_id"), F.col("event_id") % 7, 3.0, 15.0)), 6).cast("double").alias("dollars"))


#: text: unit of a label, voltage key, block letter, start and end of a time band
LINES = {
    "Power cost (Rs. Crore)": ("rs. crore", "power cost (rs. crore)", None, None, None),
    "Sales [in MU]": ("mu", "sales [in mu]", None, None, None),
    "(B) 11 KV supply": (None, "(b) 11kv supply", "B", None, None),
    "Block C": (None, "block c", "C", None, None),
    "at 33-kV.": (None, "at 33kv", None, None, None),
    "22:00 to 06:00 hrs": (None, "22:00 to 06:00 hrs", None, 1320, 360),
    "6 am - 10 pm": (None, "6 am - 10 pm", None, 360, 1320),
    "12 am to 5.30 am": (None, "12 am to 5.30 am", None, 0, 330),
    "Tariff (paise per unit)": ("paise per unit", "tariff (paise per unit)", None, None, None),
    "": (None, "", None, None, None),
}


@query("line_forms", f"SELECT p_partkey, unit, voltage, letter, start, until FROM part JOIN (VALUES {_values(LINES.values())}) v(i, unit, voltage, letter, start, until) ON i = p_partkey % {len(LINES)}")
def line_forms(spark, sf_dir) -> DataFrame:
    """Units of labels, voltage keys, block letters and time bands, on a form of each kind."""
    said = F.get(F.array(*map(F.lit, LINES)), (F.col("p_partkey") % len(LINES)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("said")).withColumn("band", texts.time_band(F.col("said")))
    return rows.select("p_partkey", texts.label_unit(F.col("said")).alias("unit"), texts.voltage_key(F.col("said")).alias("voltage"), texts.block_letter(F.col("said")).alias("letter"), F.col("band.start").alias("start"), F.col("band.end").alias("until"))


@query("fact_stages", "SELECT o_orderkey, CASE WHEN year(l) = year(o) THEN 'ARR' WHEN year(l) = year(o) - 1 THEN 'APR' WHEN year(l) < year(o) - 1 THEN 'True-up' ELSE 'MYT projection' END AS stage FROM (SELECT o_orderkey, o_orderdate AS o, o_orderdate + to_days(((o_orderkey % 5) * 366 - 900)::INTEGER) AS l FROM orders)")
def fact_stages(spark, sf_dir) -> DataFrame:
    """The stage at which an order speaks of a year."""
    named = lambda d: F.concat(F.lit("FY"), F.year(d).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr("date_add(o_orderdate, cast(o_orderkey % 5 * 366 - 900 as int))").alias("other"))
    return rows.select("o_orderkey", texts.stage_of(named("other"), named("o_orderdate")).alias("stage"))


@query("tall_rows", """SELECT s_suppkey, i, CASE s_suppkey % 3 WHEN 0 THEN ['a' || i, 'x'] WHEN 1 THEN ['p', 'q'] ELSE ['a' || chr(10) || 'b', 'x' || chr(10) || 'y' || chr(10) || 'z'] END AS cells FROM supplier, (VALUES (0), (1)) v(i) WHERE i = 0 OR s_suppkey % 3 = 0""")
def tall_rows(spark, sf_dir) -> DataFrame:
    """Rows whose cells hold several lines, as rows of one line each."""
    cells = F.expr("case s_suppkey % 3 when 0 then array('a0\\na1', 'x') when 1 then array('p', 'q') else array('a\\nb', 'x\\ny\\nz') end")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(texts.tall_rows(cells)).alias("i", "cells"))


@query("salvaged_json", "SELECT event_id, (event_id % 3 + 1)::BIGINT AS n, (event_id % 3)::INTEGER AS last FROM events")
def salvaged_json(spark, sf_dir) -> DataFrame:
    """The whole objects at the head of an array that breaks off."""
    cut = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda i: F.concat(F.lit('{"a": '), i.cast("string"), F.lit("}"))), ", "), F.lit(', {"a": 9'))
    rows = table(spark, sf_dir, "events").select("event_id", texts.whole_objects(cut, "a int").alias("o"))
    return rows.select("event_id", F.size("o").cast("long").alias("n"), F.element_at("o", -1)["a"].alias("last"))


@query("pipe_tables", "SELECT s_suppkey, row, cells FROM supplier, (VALUES (1, ['Head', 'Crore']), (3, ['Power', '12.5']), (4, ['Other', ''])) v(row, cells)")
def pipe_tables(spark, sf_dir) -> DataFrame:
    """Rows of a table drawn with pipes."""
    page = F.concat(F.lit("Costs\n| Head | Crore |\n|---|:-:|\n| Power | 12.5 |\n| Other | |\nof "), F.col("s_suppkey").cast("string"))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.split(page, "\n")).alias("row", "line"))
    return lines.select("s_suppkey", "row", texts.pipe_cells(F.col("line")).alias("cells")).where("cells is not null")


@query("contents_pages", r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(right(rtrim(l), 8), '(\.{3}|\s{3})\s?[0-9]{1,4}$') AND regexp_matches(l, '^\s*[^\s.0-9]'))) >= 5 AS contents FROM documents")
def contents_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.contents_page(F.coalesce("text", F.lit(""))).alias("contents"))


