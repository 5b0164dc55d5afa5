"""Relational questions over the fact model: picks, comparisons, shares, coverage, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sheets
from ..operators.latest import latest, newest_ties, top_in_group
from ..registry import query
from ..sources.catalog import FACTS_SQL, facts, table



def newest() -> list:
    return [F.col("order_year").desc_nulls_last(), F.col("fact_id").desc()]


KEYS = ["utility", "commission", "fiscal_year", "voice"]
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY order_year DESC NULLS LAST, fact_id DESC) AS rn FROM {source}) WHERE rn = 1"
_WORD = _LATEST.format(keys="utility, commission, fiscal_year, voice", source="facts")


@query("facts_wide", f"WITH {FACTS_SQL} SELECT f.*, n_name, r_name, c_name FROM facts f JOIN customer ON utility = c_custkey JOIN nation ON commission = n_nationkey LEFT JOIN region ON state = r_regionkey")
def facts_wide(spark, sf_dir) -> DataFrame:
    """Facts beside the names of their dimensions."""
    f = facts(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    regions = table(spark, sf_dir, "region")
    return f.join(names, F.col("utility") == F.col("c_custkey")).join(regions, F.col("state") == F.col("r_regionkey"), "left").select(*f.columns, "n_name", "r_name", "c_name")


@query("latest_word", f"WITH {FACTS_SQL} SELECT utility, commission, fiscal_year, voice, fact_id, value FROM ({_WORD})")
def latest_word(spark, sf_dir) -> DataFrame:
    """The newest decision's figure of each utility, year and voice."""
    return latest(facts(spark, sf_dir), KEYS, newest()).select(*KEYS, "fact_id", "value")


@query("latest_word_ties", f"WITH {FACTS_SQL} SELECT utility, fiscal_year, fact_id, value FROM facts f WHERE voice = 'approved' AND order_year = (SELECT max(order_year) FROM facts g WHERE g.utility = f.utility AND g.fiscal_year = f.fiscal_year AND g.voice = 'approved')")
def latest_word_ties(spark, sf_dir) -> DataFrame:
    approved = facts(spark, sf_dir).where("voice = 'approved'")
    return newest_ties(approved, ["utility", "fiscal_year"], "order_year").select("utility", "fiscal_year", "fact_id", "value")


@query("first_approval", f"WITH {FACTS_SQL} SELECT utility, fiscal_year, fact_id, value FROM (SELECT *, row_number() OVER (PARTITION BY utility, fiscal_year ORDER BY order_year, fact_id) AS rn FROM facts WHERE voice = 'approved') WHERE rn = 1")
def first_approval(spark, sf_dir) -> DataFrame:
    approved = facts(spark, sf_dir).where("voice = 'approved'")
    return latest(approved, ["utility", "fiscal_year"], [F.col("order_year").asc(), F.col("fact_id").asc()]).select("utility", "fiscal_year", "fact_id", "value")


@query("rank_topk", f"WITH {FACTS_SQL}, l AS ({_WORD}) SELECT n_name, sum(value) AS total FROM l JOIN nation ON commission = n_nationkey WHERE voice = 'approved' GROUP BY n_name ORDER BY total DESC, n_name LIMIT 5")
def rank_topk(spark, sf_dir) -> DataFrame:
    """The five commissions with the largest latest approved totals."""
    word = latest(facts(spark, sf_dir).where("voice = 'approved'"), KEYS, newest())  # voice is a key, so the filter may come first
    named = word.join(table(spark, sf_dir, "nation"), F.col("commission") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.sum("value").alias("total")).orderBy(F.col("total").desc(), "n_name").limit(5)


@query("agg_sum_members", f"WITH {FACTS_SQL}, l AS ({_WORD}) SELECT fiscal_year, head, round(sum(value), 2) AS total, count(*) AS counted, string_agg(DISTINCT state::VARCHAR, ',' ORDER BY state::VARCHAR) AS members FROM l WHERE voice = 'approved' GROUP BY fiscal_year, head")
def agg_sum_members(spark, sf_dir) -> DataFrame:
    """Totals with how many figures they count and the states among them."""
    word = latest(facts(spark, sf_dir).where("voice = 'approved'"), KEYS, newest())
    return word.groupBy("fiscal_year", "head").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("counted"), F.array_join(F.array_sort(F.collect_set(F.col("state").cast("string"))), ",").alias("members"))


@query("agg_average", f"WITH {FACTS_SQL} SELECT fiscal_year, round(sum(value) / count(value), 2)::DOUBLE AS mean, min(value) AS least, max(value) AS most FROM facts WHERE voice IN ('approved', 'actual') AND fy_start BETWEEN 1996 AND 1999 GROUP BY fiscal_year")
def agg_average(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir).where(F.col("voice").isin("approved", "actual") & F.col("fy_start").between(1996, 1999))
    return f.groupBy("fiscal_year").agg(F.round(F.sum("value").cast("double") / F.count("value"), 2).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


_LINES = "SELECT l_orderkey, sum((l_extendedprice::DECIMAL(18,2))) AS claimed, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2))) AS approved FROM lineitem GROUP BY l_orderkey"


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("claimed"), F.sum(F.expr("cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))")).alias("approved"))


@query("share_same_order", "WITH t AS (SELECT l_orderkey, l_returnflag, sum(l_extendedprice::DECIMAL(18,2)) AS part FROM lineitem GROUP BY ALL), w AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS whole FROM lineitem GROUP BY l_orderkey) SELECT t.l_orderkey, l_returnflag, part, whole, round(100.0 * part::DOUBLE / whole::DOUBLE, 1) AS percent FROM t JOIN w USING (l_orderkey) WHERE whole > 0")
def share_same_order(spark, sf_dir) -> DataFrame:
    """Each head's share of its own order's total; both sides are grouped by the order, which shuffles once."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("part"))
    whole = F.sum("part").over(Window.partitionBy("l_orderkey"))
    out = parts.withColumn("whole", whole.cast("decimal(38,2)")).where("whole > 0")
    return out.withColumn("percent", F.round(100.0 * F.col("part").cast("double") / F.col("whole").cast("double"), 1))


@query("claimed_vs_approved", f"WITH l AS ({_LINES}) SELECT l_orderkey, claimed, approved, claimed - approved AS disallowed, round(100 * (claimed - approved)::DOUBLE / nullif(claimed, 0)::DOUBLE, 1) AS disallowed_pct FROM l WHERE claimed <> approved")
def claimed_vs_approved(spark, sf_dir) -> DataFrame:
    """What each order disallowed of what was claimed in the same order."""
    out = _lines(spark, sf_dir).where("claimed <> approved").withColumn("disallowed", F.col("claimed") - F.col("approved"))
    return out.withColumn("disallowed_pct", F.round(F.try_divide(100 * F.col("disallowed").cast("double"), F.nullif(F.col("claimed"), F.lit(0)).cast("double")), 1))


@query("timeline", f"WITH {FACTS_SQL}, l AS ({_WORD}), y AS (SELECT DISTINCT fy_start, fiscal_year FROM facts), v AS (SELECT fiscal_year, voice, sum(value) AS total FROM l GROUP BY ALL) SELECT y.fy_start, y.fiscal_year, a.total AS claimed, b.total AS approved, c.total AS approved_earlier, d.total AS actual FROM y LEFT JOIN v a ON a.fiscal_year = y.fiscal_year AND a.voice = 'claimed' LEFT JOIN v b ON b.fiscal_year = y.fiscal_year AND b.voice = 'approved' LEFT JOIN v c ON c.fiscal_year = y.fiscal_year AND c.voice = 'approved_earlier' LEFT JOIN v d ON d.fiscal_year = y.fiscal_year AND d.voice = 'actual'")
def timeline(spark, sf_dir) -> DataFrame:
    """All voices of each year side by side: one aggregation with a pivot of known voices instead of four joins."""
    word = latest(facts(spark, sf_dir), KEYS, newest())
    return word.groupBy("fy_start", "fiscal_year").pivot("voice", ["claimed", "approved", "approved_earlier", "actual"]).agg(F.sum("value"))


@query("coverage", f"WITH {FACTS_SQL} SELECT n_name, count(DISTINCT c_custkey) AS utilities, count(DISTINCT c_custkey) FILTER (WHERE fact_id IS NOT NULL) AS covered, count(fact_id) AS figures, max(fiscal_year) AS last_year FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN facts ON utility = c_custkey GROUP BY n_name")
def coverage(spark, sf_dir) -> DataFrame:
    """How many utilities of each commission have figures; counted per utility first, so no distinct sets are built."""
    each = facts(spark, sf_dir).groupBy("utility").agg(F.count("*").alias("n"), F.max("fiscal_year").alias("last"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(each, F.col("c_custkey") == F.col("utility"), "left")
    return people.groupBy("n_name").agg(F.count("*").alias("utilities"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("figures"), F.max("last").alias("last_year"))


@query("semi_anti", "SELECT c_custkey, 'has' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') UNION SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, sf_dir) -> DataFrame:
    people, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    has = people.join(orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").withColumn("kind", F.lit("has"))
    none = people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("kind", F.lit("none"))
    return has.union(none).distinct()


@query("set_operations", "SELECT o_custkey AS utility, 'both' AS kind FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'open only' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_operations(spark, sf_dir) -> DataFrame:
    of = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("utility"))
    return of("O").intersect(of("P")).withColumn("kind", F.lit("both")).unionByName(of("O").subtract(of("P")).withColumn("kind", F.lit("open only")))


@query("theta_later", f"WITH {FACTS_SQL} SELECT a.fact_id, count(*) AS later, sum(CASE WHEN abs(a.value - b.value) < 5000 THEN 1 ELSE 0 END)::BIGINT AS near FROM facts a JOIN facts b ON a.utility = b.utility AND a.head = b.head AND b.order_year > a.order_year GROUP BY a.fact_id")
def theta_later(spark, sf_dir) -> DataFrame:
    """How often a decision is followed by later ones on the same head, and by near ones: the former are counted by a window over years, only near values (of neighbouring bins) meet as pairs."""
    width = 5000
    f = facts(spark, sf_dir).select("fact_id", "utility", "head", "order_year", "value").withColumn("bin", F.floor(F.col("value") / width).cast("long"))
    after = Window.partitionBy("utility", "head").orderBy("order_year").rangeBetween(1, Window.unboundedFollowing)
    counted = f.select("fact_id", F.count("*").over(after).alias("later")).where("later > 0")
    probes = f.withColumn("bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    pairs = probes.alias("a").join(f.alias("b"), F.expr(f"a.utility = b.utility and a.head = b.head and a.bin = b.bin and b.order_year > a.order_year and abs(a.value - b.value) < {width}"))
    near = pairs.groupBy(F.col("a.fact_id").alias("fact_id")).agg(F.count("*").alias("near"))
    return counted.join(near, "fact_id", "left").select("fact_id", "later", F.coalesce("near", F.lit(0)).cast("long").alias("near"))


@query("tolerance_join", "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, count(*) AS matches FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND abs(a.v - b.v) < 900 AND a.l_orderkey <> b.l_orderkey GROUP BY ALL")
def tolerance_join(spark, sf_dir) -> DataFrame:
    """Lines that another order's line of the part matches within 900: counts of a range of values less those of the line's own order, one shuffle and no pairs."""
    reach = 900 * 100 - 1  # hundredths
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long").alias("v"))
    inside = lambda *keys: F.count("*").over(Window.partitionBy(*keys).orderBy("v").rangeBetween(-reach, reach))
    counted = lines.select("l_orderkey", "l_linenumber", (inside("l_partkey") - inside("l_partkey", "l_orderkey")).alias("matches"))
    return counted.groupBy("l_orderkey", "l_linenumber").agg(F.sum("matches").alias("matches")).where("matches > 0")


@query("lateral_rows", "SELECT doc_id, i AS line, trim(lines[i]) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(lines[i]) <> ''")
def lateral_rows(spark, sf_dir) -> DataFrame:
    """Lines with their number from 1."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "said"))
    return lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.trim("said").alias("said")).where("said <> ''")


@query("json_props", "SELECT event_type, json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("lateral_first", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def lateral_first(spark, sf_dir) -> DataFrame:
    """One order of each customer: picked before the join, not by a correlated query."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("null_safe_match", "WITH a AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag, l_quantity FROM lineitem) SELECT flag, count(*) AS n FROM (SELECT a.l_orderkey, a.flag FROM a SEMI JOIN (SELECT DISTINCT flag FROM a WHERE l_quantity > 49) b ON a.flag IS NOT DISTINCT FROM b.flag) GROUP BY flag")
def null_safe_match(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    b = a.where("l_quantity > 49").select(F.col("flag").alias("other")).distinct()
    return a.join(b, F.col("flag").eqNullSafe(F.col("other")), "left_semi").groupBy("flag").agg(F.count("*").alias("n"))


@query("pivot_sections", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) AS all_events FROM events GROUP BY user_id")
def pivot_sections(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view", "error")], F.count("*").alias("all_events"))


@query("totals", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(DISTINCT o_custkey) FROM orders) AS utilities, (SELECT sum(o_totalprice::DECIMAL(18,2)) FROM orders) AS money")
def totals(spark, sf_dir) -> DataFrame:
    """A dashboard's one row."""
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("utilities"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("money"))
    lines = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("lines"))
    return orders.crossJoin(lines).select("orders", "lines", "utilities", "money")  # one row each


@query("spend_by_day", "SELECT ts::DATE AS day, coalesce(nullif(event_type, 'view'), 'local') AS provider, count(*) AS n, sum(value::DECIMAL(18,2)) AS spent FROM events GROUP BY ALL ORDER BY day DESC, provider LIMIT 120")
def spend_by_day(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.expr("coalesce(nullif(event_type, 'view'), 'local')").alias("provider"), F.col("value").cast("decimal(18,2)").alias("value"))
    return e.groupBy("day", "provider").agg(F.count("*").alias("n"), F.sum("value").alias("spent")).orderBy(F.col("day").desc(), "provider").limit(120)


@query("best_order_of_year", f"WITH {FACTS_SQL}, g AS (SELECT utility, fiscal_year, order_year, count(DISTINCT head) AS heads, max(fact_id) AS fact_id FROM facts GROUP BY ALL) SELECT utility, fiscal_year, order_year, heads, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY utility, fiscal_year ORDER BY heads >= 3 DESC, order_year DESC, fact_id DESC) AS rn FROM g) WHERE rn = 1")
def best_order_of_year(spark, sf_dir) -> DataFrame:
    """The order to read a year from: one with three heads first, then the newest."""
    g = facts(spark, sf_dir).groupBy("utility", "fiscal_year", "order_year").agg(F.count_distinct("head").alias("heads"), F.max("fact_id").alias("fact_id"))
    return latest(g, ["utility", "fiscal_year"], [(F.col("heads") >= 3).desc(), F.col("order_year").desc(), F.col("fact_id").desc()])


@query("heads_in_year", f"WITH {FACTS_SQL} SELECT fact_id, fiscal_year, head, count(*) OVER (PARTITION BY utility, fiscal_year, head) AS same_head, value FROM facts WHERE voice = 'approved'")
def heads_in_year(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir).where("voice = 'approved'")
    return f.select("fact_id", "fiscal_year", "head", F.count("*").over(Window.partitionBy("utility", "fiscal_year", "head")).alias("same_head"), "value")


@query("outlier_set_aside", """WITH m AS (SELECT o_custkey, median(o_totalprice::DECIMAL(18,2)::DOUBLE) AS middle, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey)
SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS value, middle, CASE WHEN middle IS NULL THEN NULL WHEN o_totalprice <= 0 THEN 'not above zero' WHEN o_totalprice::DECIMAL(18,2)::DOUBLE < middle / 5 THEN 'under a fifth of the median' WHEN o_totalprice::DECIMAL(18,2)::DOUBLE > middle * 5 THEN 'over five times the median' END AS set_aside FROM orders LEFT JOIN (SELECT * FROM m WHERE n >= 3) m USING (o_custkey)""")
def outlier_set_aside(spark, sf_dir) -> DataFrame:
    """Figures far from their group's median (of positive ones, three at least), with the reason; those of smaller groups are kept and never set aside. Aggregated, then joined back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    return sheets.set_aside(o, ["o_custkey"], "value", F.lit(True)).select("o_orderkey", "value", "middle", "set_aside")


@query("main_table", "SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, sum(l_quantity) DESC, l_suppkey) AS rn FROM lineitem GROUP BY l_orderkey, l_suppkey) WHERE rn = 1")
def main_table(spark, sf_dir) -> DataFrame:
    """Of each order the supplier with the greatest score tuple: aggregates twice, with no window."""
    scored = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return scored.groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("n", "q", (-F.col("l_suppkey")).alias("less"))).alias("l_suppkey"))


@query("benchmarks_rank", """WITH r AS (SELECT s_suppkey, s_nationkey, sum((l_extendedprice * l_discount)::DECIMAL(18,4)) AS top, sum(l_extendedprice::DECIMAL(18,2)) AS bottom FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_suppkey % 7 <> 0) ON l_suppkey = s_suppkey GROUP BY ALL),
q AS (SELECT *, round(100 * top::DOUBLE / nullif(bottom, 0)::DOUBLE, 3) AS ratio FROM r)
SELECT s_suppkey, ratio, CASE WHEN ratio IS NOT NULL THEN rank() OVER (ORDER BY ratio NULLS LAST)::INTEGER END AS place, median(ratio) OVER (PARTITION BY s_nationkey) AS middle, count(ratio) OVER (PARTITION BY s_nationkey) AS n,
  CASE WHEN top IS NULL THEN 'no lines' WHEN bottom = 0 THEN 'the denominator is zero' END AS reason FROM q""")
def benchmarks_rank(spark, sf_dir) -> DataFrame:
    """A ratio of each supplier, its place (1 + how many are smaller) and its nation's median; a supplier without a ratio is kept, with the reason.

    A seventh of the suppliers' lines are left out here, so that some have none. The place counts smaller ratios by a running sum over the few distinct ratios' counts.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0").groupBy("l_suppkey").agg(F.sum(F.expr("cast(l_extendedprice * l_discount as decimal(18,4))")).alias("top"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("bottom"))
    q = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("ratio", F.round(F.try_divide(100 * F.col("top").cast("double"), F.col("bottom").cast("double")), 3)).withColumn("reason", F.expr("case when top is null then 'no lines' when bottom = 0 then 'the denominator is zero' end"))
    nations = q.groupBy("s_nationkey").agg(F.median("ratio").alias("middle"), F.count("ratio").alias("n"))
    places = q.where("ratio is not null").groupBy("ratio").agg(F.count("*").alias("c"))  # ratios have three places, so there are few
    places = places.select("ratio", (F.sum("c").over(Window.orderBy("ratio")) - F.col("c") + 1).cast("int").alias("place"))
    return q.join(nations, "s_nationkey").join(places, "ratio", "left").select("s_suppkey", "ratio", "place", "middle", "n", "reason")


@query("rollup_tree", "SELECT r_name, n_name, sum(o_totalprice::DECIMAL(18,2)) AS total, grouping(r_name, n_name)::BIGINT AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_tree(spark, sf_dir) -> DataFrame:
    """Totals of nations, regions and all; orders are summed by customer before the dimensions are joined."""
    paid = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    tree = paid.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree.rollup("r_name", "n_name").agg(F.sum("value").alias("total"), F.grouping_id().alias("level"))


@query("accuracy_metrics", "SELECT source, count(*) AS measured, count(*) FILTER (WHERE (n_chars >= 200) = (quality = 1)) AS found, count(*) FILTER (WHERE toxic = 1) AS toxic, round(100.0::DOUBLE * count(*) FILTER (WHERE (n_chars >= 200) = (quality = 1)) / count(*), 1) AS percent FROM labels JOIN documents USING (doc_id) GROUP BY source")
def accuracy_metrics(spark, sf_dir) -> DataFrame:
    """A reader's accuracy against hand-made labels, by source."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    right = F.count_if((F.col("n_chars") >= 200) == (F.col("quality") == 1))
    return j.groupBy("source").agg(F.count("*").alias("measured"), right.alias("found"), F.count_if(F.col("toxic") == 1).alias("toxic")).withColumn("percent", F.round(100.0 * F.col("found") / F.col("measured"), 1))


@query("telemetry_tags", "SELECT tag, count(*) AS n, avg(value) FILTER (WHERE event_type <> 'error') AS mean_ms, max(value) AS max_ms FROM (SELECT unnest([event_type, 'user' || (user_id % 5)::VARCHAR]) AS tag, event_type, value FROM events) GROUP BY tag")
def telemetry_tags(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.explode(F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 5).cast("string")))).alias("tag"), "event_type", "value")
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("mean_ms"), F.max("value").alias("max_ms"))


@query("slabs", """WITH s AS (SELECT p_brand, p_size AS upper, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT *, lag(upper) OVER (PARTITION BY p_brand ORDER BY upper) AS below, sum(n) OVER (PARTITION BY p_brand ORDER BY upper ROWS UNBOUNDED PRECEDING) AS cumulative FROM s)
SELECT p_brand, upper, below, cumulative::BIGINT AS cumulative, CASE WHEN below IS NULL THEN 'first' WHEN upper > below + 1 THEN 'gap' ELSE 'adjacent' END AS state FROM a""")
def slabs(spark, sf_dir) -> DataFrame:
    """Slab bounds in order: gaps (only where a bound lies over the previous one plus 1) and running counts."""
    s = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("upper")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand").orderBy("upper")
    a = s.withColumn("below", F.lag("upper").over(w)).withColumn("cumulative", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return a.select("p_brand", "upper", "below", "cumulative", F.expr("case when below is null then 'first' when upper > below + 1 then 'gap' else 'adjacent' end").alias("state"))


@query("islands", """WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS run FROM a GROUP BY user_id, event_type, g HAVING count(*) >= 2""")
def islands(spark, sf_dir) -> DataFrame:
    """Runs of one kind of event, two at least."""
    by_user, by_kind = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", "event_type").orderBy("event_id")
    a = table(spark, sf_dir, "events").withColumn("g", F.row_number().over(by_user) - F.row_number().over(by_kind))
    return a.groupBy("user_id", "event_type", "g").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("run")).where("run >= 2").drop("g")


@query("dedupe_consecutive", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def dedupe_consecutive(spark, sf_dir) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("carry_forward", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def carry_forward(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w).alias("last_error"))


@query("serial_columns", "SELECT l_orderkey, bool_and(l_linenumber - rn = 0) AS serial, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) GROUP BY l_orderkey HAVING count(*) >= 3")
def serial_columns(spark, sf_dir) -> DataFrame:
    """Columns that count 1, 2, 3: n distinct numbers from 1 to n, which needs no order."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count_distinct("l_linenumber").alias("d")).where("n >= 3")
    return g.select("l_orderkey", F.expr("lo = 1 and hi = n and d = n").alias("serial"), "n")


@query("offset_reference", "SELECT l_orderkey, l_linenumber, value, lag(value, 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value) AS two_left FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2) AS value FROM lineitem)")
def offset_reference(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return lines.withColumn("two_left", F.lag("value", 2).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "value")))


@query("top_in_group", "SELECT p_brand, p_partkey, p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS place FROM part) WHERE place <= 3")
def top_three(spark, sf_dir) -> DataFrame:
    return top_in_group(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice", "place")


@query("risk_order", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END, o_orderstatus <> 'O', o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders ORDER BY place LIMIT 200")
def risk_order(spark, sf_dir) -> DataFrame:
    """The first 200 of a review queue by several computed keys."""
    keys = [F.expr("case when o_orderpriority = '1-URGENT' then 0 when o_orderpriority = '2-HIGH' then 1 else 2 end"), F.expr("o_orderstatus <> 'O'"), F.col("o_totalprice").desc(), F.col("o_orderkey")]
    first = table(spark, sf_dir, "orders").orderBy(*keys).limit(200)  # a top-k, before anything is numbered
    return first.withColumn("place", F.row_number().over(Window.orderBy(*keys))).select("o_orderkey", "place")


@query("paging", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def paging(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(100).limit(50)


@query("optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_totalprice BETWEEN 1000 AND 200000")
def optional_filters(spark, sf_dir) -> DataFrame:
    """Only the filters that are given are applied, so each reaches the scan."""
    given = {"status": "O", "since": "1997-01-01", "priority": None, "between": (1000, 200000)}
    out = table(spark, sf_dir, "orders")
    for name, value in given.items():
        if value is not None:
            out = out.where({"status": lambda v: F.col("o_orderstatus") == v, "since": lambda v: F.col("o_orderdate") >= F.lit(v).cast("timestamp"), "priority": lambda v: F.col("o_orderpriority") == v, "between": lambda v: F.col("o_totalprice").between(*v)}[name](value))
    return out.select("o_orderkey")


@query("inventory_gaps", "SELECT p_partkey, 'never ordered' AS finding FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) UNION ALL SELECT DISTINCT l_partkey, 'not in the inventory' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE l_partkey = p_partkey AND p_size > 10)")
def inventory_gaps(spark, sf_dir) -> DataFrame:
    """Reconciliation both ways."""
    parts, used = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    never = parts.join(used, "p_partkey", "left_anti").select("p_partkey", F.lit("never ordered").alias("finding"))
    return never.union(used.join(parts.where("p_size > 10"), "p_partkey", "left_anti").select("p_partkey", F.lit("not in the inventory")))


@query("history_grid", f"WITH {FACTS_SQL}, l AS ({_WORD}) SELECT utility, fiscal_year, head, max(value) FILTER (WHERE voice = 'claimed') AS claimed, max(value) FILTER (WHERE voice = 'approved') AS approved, max(value) FILTER (WHERE voice = 'claimed') - max(value) FILTER (WHERE voice = 'approved') AS disallowed FROM l GROUP BY ALL")
def history_grid(spark, sf_dir) -> DataFrame:
    word = latest(facts(spark, sf_dir), KEYS, newest()).groupBy("utility", "fiscal_year", "head").agg(*[F.max(F.when(F.col("voice") == v, F.col("value"))).alias(v) for v in ("claimed", "approved")])
    return word.withColumn("disallowed", F.col("claimed") - F.col("approved"))


@query("cube_sections", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sections(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("ranks", "SELECT c_custkey, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, lead(c_custkey) OVER w AS next_one FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)")
def ranks(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.lead("c_custkey").over(w).alias("next_one"))
