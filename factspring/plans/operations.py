"""Questions asked in plain words, validators, consensus, table upkeep, queues and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ask.spec import answer, translate
from ..operators import tables
from ..quality.consensus import consensus
from ..quality.findings import conflicting_duplicates, day_covered, exists_in, one_unit, plausible, together, types_hold
from ..registry import query
from ..sources.catalog import FACTS_SQL, facts, table
from ..streaming.events import first_seen, sessions, windowed

_PICK = "(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY order_year DESC NULLS LAST, fact_id DESC) AS rn FROM facts WHERE {where})"


def _asked(name: str, question: str, sql: str):
    @query(name, f"WITH {FACTS_SQL} {sql}")
    def run(spark, sf_dir) -> DataFrame:
        return answer(translate(question, 1999), facts(spark, sf_dir))

    run.__doc__ = question


_asked("ask_rank", "Which are the top 7 utilities by approved power purchase cost in 1998-99?", f"SELECT utility, commission, fiscal_year, label, value, fact_id FROM {_PICK.format(keys='utility, commission, fiscal_year, voice', where="fy_start = 1998 AND voice = 'approved' AND head = 'power_purchase'")} WHERE rn = 1 ORDER BY value DESC, utility, fact_id LIMIT 7")
_asked("ask_list", "List the actual O&M of every utility", f"SELECT utility, commission, fiscal_year, label, value, fact_id FROM {_PICK.format(keys='utility, commission, fiscal_year, voice, label', where="fy_start = 1999 AND voice = 'actual' AND head = 'om'")} WHERE rn = 1")
_asked("ask_aggregate", "What is the total approved ARR by year?", f"SELECT fiscal_year, round(sum(value), 2) AS sum, count(*) AS counted FROM {_PICK.format(keys='utility, commission, fiscal_year, voice, label', where="voice = 'approved' AND head = 'arr'")} WHERE rn = 1 GROUP BY fiscal_year")
_asked("ask_share", "What share of the total is power purchase in 1997-98?", f"SELECT * FROM (SELECT utility, fiscal_year, sum(value) FILTER (WHERE head = 'power_purchase') AS part, sum(value) AS whole, round(100 * (sum(value) FILTER (WHERE head = 'power_purchase'))::DOUBLE / sum(value)::DOUBLE, 1) AS percent FROM {_PICK.format(keys='utility, commission, fiscal_year, voice, head', where="fy_start = 1997 AND voice = 'approved'")} WHERE rn = 1 GROUP BY utility, fiscal_year) WHERE part IS NOT NULL AND whole > 0")
_asked("ask_compare", "Compare claimed and approved ARR in 1998-99", f"SELECT utility, fiscal_year, head, claimed, approved, round(claimed - approved, 2) AS disallowed, round(100 * (claimed - approved)::DOUBLE / claimed::DOUBLE, 1) AS disallowed_pct FROM (SELECT utility, fiscal_year, head, max(value) FILTER (WHERE voice = 'claimed') AS claimed, max(value) FILTER (WHERE voice = 'approved') AS approved FROM {_PICK.format(keys='utility, commission, fiscal_year, voice, head', where="fy_start = 1998 AND voice IN ('claimed', 'approved') AND head = 'arr'")} WHERE rn = 1 GROUP BY utility, fiscal_year, head) WHERE claimed IS NOT NULL AND approved IS NOT NULL")


@query("validator_findings", """SELECT 'types' AS validator, 'error' AS severity, l_orderkey::VARCHAR AS key, r AS message FROM (SELECT l_orderkey, unnest([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END]) AS r FROM lineitem) WHERE r IS NOT NULL
UNION ALL SELECT 'unit_consistency', 'warning', p_brand || '|' || p_type, count(DISTINCT p_size)::VARCHAR || ' units' FROM part GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1
UNION ALL SELECT 'conflicting_duplicates', 'error', l_orderkey || '|' || l_linenumber, count(DISTINCT l_extendedprice)::VARCHAR || ' values' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_extendedprice) > 1
UNION ALL SELECT 'plausibility', 'warning', o_orderkey::VARCHAR, 'outside the plausible range' FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 450000
UNION ALL SELECT 'time_bands', 'error', p_brand, s::VARCHAR || ' of 1440 minutes' FROM (SELECT p_brand, sum(CASE WHEN a = b THEN 1440 ELSE (b - a + 1440) % 1440 END)::BIGINT AS s FROM (SELECT p_brand, (p_partkey * 37) % 1440 AS a, (p_partkey * 91) % 1440 AS b FROM part) GROUP BY p_brand) WHERE s <> 1440
UNION ALL SELECT 'evidence', 'error', o_orderkey::VARCHAR, 'no such line' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def validator_findings(spark, sf_dir) -> DataFrame:
    """Six validators over the driver's tables, one frame."""
    lines, parts, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    bands = parts.select("p_brand", (F.col("p_partkey") * 37 % 1440).alias("a"), (F.col("p_partkey") * 91 % 1440).alias("b"))
    return together([
        types_hold(lines, "l_orderkey", {"quantity": "l_quantity <= 45", "discount": "l_discount < 0.1D"}),
        one_unit(parts, ["p_brand", "p_type"], "p_size"),
        conflicting_duplicates(lines, ["l_orderkey", "l_linenumber"], "l_extendedprice"),
        plausible(orders, "o_orderkey", "o_totalprice", 5000, 450000),
        day_covered(bands, "p_brand", "a", "b"),
        exists_in(orders, "o_orderkey", lines, "l_orderkey", "line"),
    ])


@query("consensus")
def consensus_facts(spark, sf_dir) -> DataFrame:
    """Three readers' figures of each supplier's lines, clustered; tested on small cases."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("utility"), F.concat(F.lit("FY"), F.year("l_shipdate").cast("string")).alias("fiscal_year"), F.col("l_returnflag").alias("voice"), F.col("l_linestatus").alias("head"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("label"), F.col("l_linenumber").alias("page"), F.col("l_extendedprice").alias("value"), "l_orderkey")
    readers = F.explode(F.filter(F.array(F.lit("textlayer"), F.when(F.col("l_orderkey") % 3 > 0, F.lit("docling")), F.when(F.col("l_orderkey") % 5 == 0, F.lit("llm"))), lambda r: r.isNotNull()))
    read = lines.withColumn("reader", readers).withColumn("value", F.when((F.col("reader") == "docling") & (F.col("l_orderkey") % 11 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return consensus(read.withColumn("label_key", F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "")).drop("l_orderkey"))


@query("upsert_facts", "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.bal ELSE a.bal END AS bal, coalesce(a.segment, b.segment) AS segment FROM (SELECT c_custkey, c_acctbal AS bal, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey, c_acctbal * 2 AS bal, 'NEW' AS segment FROM customer WHERE c_acctbal > 5000) b ON a.c_custkey = b.c_custkey")
def upsert_facts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    current = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_acctbal").alias("bal"), F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("segment"))
    incoming = c.where("c_acctbal > 5000").select("c_custkey", (F.col("c_acctbal") * 2).alias("bal"), F.lit("NEW").alias("segment"))
    return tables.upsert(current, incoming, ["c_custkey"], preserve=["segment"])


@query("replace_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 1 AS l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <= 2 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = 'A' AND m.l_linenumber <= 2)")
def replace_order(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    came = lines.where("l_returnflag = 'A' and l_linenumber <= 2")
    lines, came = (x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity") for x in (lines, came))
    return tables.replace_groups(lines, came.withColumn("l_quantity", F.col("l_quantity") + 1), ["l_orderkey"])


@query("quarantine_rows", "SELECT event_id, CASE WHEN value < 1 THEN 'value under 1' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'error of an even user' END AS reason FROM events WHERE reason IS NOT NULL")
def quarantine_rows(spark, sf_dir) -> DataFrame:
    reason = F.expr("case when value < 1 then 'value under 1' when event_type = 'error' and user_id % 2 = 0 then 'error of an even user' end")
    return tables.quarantine(table(spark, sf_dir, "events"), reason)[1].select("event_id", "reason")


@query("replay_last", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def replay_last(spark, sf_dir) -> DataFrame:
    return tables.replay(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("ingest_batches", "SELECT source, doc_id, (sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(text) - 1) // 8192 AS batch FROM documents")
def ingest_batches(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.octet_length("text") + 1).alias("size"))
    return tables.batches(d, "source", ["doc_id"], "size", 8192).drop("size")


@query("queue_state", "SELECT event_type AS kind, CASE WHEN value < 10 THEN 'queued' WHEN value < 30 THEN 'running' ELSE 'done' END AS state, count(*) AS n, min(ts) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY ALL")
def queue_state(spark, sf_dir) -> DataFrame:
    """The last three jobs of each user and kind, counted by state."""
    last = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.col("event_id").desc()))).where("rn <= 3")
    state = F.expr("case when value < 10 then 'queued' when value < 30 then 'running' else 'done' end")
    return last.groupBy(F.col("event_type").alias("kind"), state.alias("state")).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2)) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"))


@query("stream_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf_dir) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


@query("stream_first_seen", "SELECT DISTINCT event_id FROM events")
def stream_first_seen(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return first_seen(e.unionByName(e)).select("event_id")


@query("as_of_latest", "SELECT e.event_id, (SELECT max(f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts < e.ts) AS before FROM events e WHERE e.event_type = 'click'")
def as_of_latest(spark, sf_dir) -> DataFrame:
    """The latest error before each click: a running last over one ordering, no range join."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("before", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w)).where("event_type = 'click'").select("event_id", "before")
