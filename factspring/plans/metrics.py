"""Measures of a corpus and of what was read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import figures, labels
from ..operators.hierarchy import roll_up
from ..operators.passage_search import best_of
from ..registry import query
from ..sources.catalog import FACTS_SQL, facts, table


@query("metric_suite", f"""WITH {FACTS_SQL} SELECT 'voice share' AS name, voice AS scope, count(*) AS numerator, (SELECT count(*) FROM facts) AS denominator FROM facts GROUP BY voice
UNION ALL SELECT 'utilities with figures', state::VARCHAR, count(DISTINCT utility), (SELECT count(*) FROM customer) FROM facts GROUP BY state UNION ALL SELECT 'labelled good', 'documents', count(*) FILTER (quality = 1), count(*) FROM labels""")
def metric_suite(spark, sf_dir) -> DataFrame:
    """Numerators over denominators, one row for each measure and scope."""
    f = facts(spark, sf_dir)
    total = f.agg(F.count("*").alias("denominator"))
    voices = f.groupBy("voice").agg(F.count("*").alias("numerator")).crossJoin(F.broadcast(total)).select(F.lit("voice share").alias("name"), F.col("voice").alias("scope"), "numerator", "denominator")
    people = table(spark, sf_dir, "customer").agg(F.count("*").alias("denominator"))
    covered = f.groupBy("state").agg(F.count_distinct("utility").alias("numerator")).crossJoin(F.broadcast(people)).select(F.lit("utilities with figures").alias("name"), F.col("state").cast("string").alias("scope"), "numerator", "denominator")
    good = table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("numerator"), F.count("*").alias("denominator")).select(F.lit("labelled good").alias("name"), F.lit("documents").alias("scope"), "numerator", "denominator")
    return reduce(DataFrame.unionByName, [voices, covered, good])


@query("rollup_override", """WITH c AS (SELECT 'c' || c_custkey AS code, c_nationkey, sum(o_totalprice::DECIMAL(18,2)) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey, n_regionkey, 'n' || n_nationkey AS code, CASE WHEN n_name LIKE '%3' THEN 1000.00::DECIMAL(38,2) END AS printed, sum(CASE WHEN c_nationkey IS NOT NULL THEN v END) AS s FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT 'r' || r_regionkey AS code, sum(coalesce(printed, s) * CASE WHEN n_name LIKE '%1' THEN -1 ELSE 1 END) AS v FROM region LEFT JOIN (SELECT n.*, n_name FROM n JOIN nation USING (n_nationkey)) x ON x.n_regionkey = r_regionkey GROUP BY r_regionkey)
SELECT code, v::DECIMAL(38,2) AS value, CASE WHEN v IS NULL THEN 'missing' ELSE 'printed' END AS how FROM c UNION ALL SELECT code, coalesce(printed, s)::DECIMAL(38,2), CASE WHEN printed IS NOT NULL THEN 'printed' WHEN s IS NULL THEN 'missing' ELSE 'summed' END FROM n UNION ALL SELECT code, v::DECIMAL(38,2), CASE WHEN v IS NULL THEN 'missing' ELSE 'summed' END FROM r""")
def rollup_override(spark, sf_dir) -> DataFrame:
    """Customers under nations under regions; some nations print a total of their own, some are subtracted."""
    paid = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    node = lambda df, code, parent, level, sign, printed: df.select(F.expr(code).alias("code"), F.expr(parent).alias("parent"), F.lit(level).alias("level"), F.expr(sign).alias("sign"), F.expr(printed).cast("decimal(38,2)").alias("printed"))
    customers = node(table(spark, sf_dir, "customer").join(paid, F.col("c_custkey") == F.col("o_custkey"), "left"), "concat('c', c_custkey)", "concat('n', c_nationkey)", 2, "1", "v")
    nations = node(table(spark, sf_dir, "nation"), "concat('n', n_nationkey)", "concat('r', n_regionkey)", 1, "case when n_name like '%1' then -1 else 1 end", "case when n_name like '%3' then 1000.00 end")
    regions = node(table(spark, sf_dir, "region"), "concat('r', r_regionkey)", "null", 0, "1", "null")
    return roll_up(customers.unionByName(nations).unionByName(regions), 2)


@query("unplaced_labels", "SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, count(*) AS seen, min(p_name) AS example, count(DISTINCT p_brand) AS pages FROM part GROUP BY 1")
def unplaced_labels(spark, sf_dir) -> DataFrame:
    """Labels that no head claims, by key, with an example and how many pages have them."""
    parts = table(spark, sf_dir, "part").where(labels.head_of(F.col("p_name")).isNull())
    return parts.groupBy(figures.label_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("seen"), F.min("p_name").alias("example"), F.count_distinct("p_brand").alias("pages"))


@query("heading_inventory", "SELECT p_type, count(*) AS headings, count(DISTINCT p_brand || p_size) AS codes, (SELECT count(*) FROM (SELECT 1 FROM part y WHERE y.p_type = part.p_type GROUP BY p_brand || p_size HAVING count(*) > 1)) AS repeated FROM part GROUP BY p_type")
def heading_inventory(spark, sf_dir) -> DataFrame:
    """Headings of each kind, their distinct codes, and the codes that recur: counted by code first."""
    codes = table(spark, sf_dir, "part").groupBy("p_type", F.concat("p_brand", F.col("p_size").cast("string")).alias("code")).agg(F.count("*").alias("n"))
    return codes.groupBy("p_type").agg(F.sum("n").alias("headings"), F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("narrative_reconcile", """WITH p AS (SELECT DISTINCT l_suppkey, (l_extendedprice * 100)::BIGINT AS v FROM lineitem), q AS (SELECT l_suppkey, (l_extendedprice * 100)::BIGINT + CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN -2 * (l_extendedprice * 100)::BIGINT ELSE 7 END AS v FROM lineitem),
r AS (SELECT l_suppkey, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = q.l_suppkey AND p.v = q.v) THEN 'traced' WHEN EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = q.l_suppkey AND p.v IN (q.v - 1, q.v + 1)) THEN 'near' WHEN EXISTS (SELECT 1 FROM p WHERE p.l_suppkey = q.l_suppkey AND p.v = -q.v) THEN 'opposite' ELSE 'untraced' END AS result FROM q)
SELECT l_suppkey, count(*) FILTER (result = 'traced') AS traced, count(*) FILTER (result = 'near') AS near, count(*) FILTER (result = 'opposite') AS opposite, count(*) FILTER (result = 'untraced') AS untraced FROM r GROUP BY l_suppkey""")
def narrative_reconcile(spark, sf_dir) -> DataFrame:
    """Figures of a narrative traced to a sheet's cells: equal, one unit off, of opposite sign, or not at all. Four probes of an equi join each, the best counts."""
    lines = table(spark, sf_dir, "lineitem").withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("long"))
    cells = lines.select(F.col("l_suppkey").alias("sheet"), F.col("c").alias("cell")).distinct()
    said = lines.select("l_suppkey", F.monotonically_increasing_id().alias("at"), F.expr("c + case l_linenumber when 1 then 0 when 2 then 1 when 3 then -2 * c else 7 end").alias("v"))
    probes = F.explode(F.array(*[F.struct(F.lit(rank).alias("rank"), probe.alias("probe")) for rank, probe in ((1, F.col("v")), (2, F.col("v") - 1), (2, F.col("v") + 1), (3, -F.col("v")))]))
    found = said.select("l_suppkey", "at", probes.alias("p")).join(cells, (F.col("l_suppkey") == F.col("sheet")) & (F.col("p.probe") == F.col("cell")), "left")
    best = found.groupBy("l_suppkey", "at").agg(F.min(F.when(F.col("cell").isNotNull(), F.col("p.rank"))).alias("rank"))
    return best.groupBy("l_suppkey").agg(*[F.count_if(F.coalesce(F.col("rank"), F.lit(4)) == i).alias(n) for i, n in enumerate(("traced", "near", "opposite", "untraced"), 1)])


@query("section_spans", """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS hit, event_type = 'error' AS stop FROM events), g AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part FROM e),
f AS (SELECT *, min(CASE WHEN hit THEN event_id END) OVER (PARTITION BY user_id, part) AS first_hit FROM g)
SELECT user_id, part::BIGINT AS part, first_hit, max(event_id) AS last_page, count(*) AS pages FROM f WHERE event_id >= first_hit AND NOT stop GROUP BY user_id, part, first_hit""")
def section_spans(spark, sf_dir) -> DataFrame:
    """Spans of pages from a first hit to before the next stop page."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    g = table(spark, sf_dir, "events").withColumn("part", F.count_if(F.col("event_type") == "error").over(w))
    first = F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id", "part"))
    f = g.withColumn("first_hit", first).where("event_id >= first_hit and event_type <> 'error'")
    return f.groupBy("user_id", "part", "first_hit").agg(F.max("event_id").alias("last_page"), F.count("*").alias("pages"))


_PASSAGE = 500  # characters after which a passage ends at its line's end


def _cut(text):
    """Passages: lines, trimmed and joined by spaces, to an empty line or until they are longer than ``_PASSAGE``."""

    def add(x, line):
        line = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
        buf = F.when(line == "", x["buf"]).when(x["buf"] == "", line).otherwise(F.concat(x["buf"], F.lit(" "), line))
        ends = (buf != "") & ((line == "") | (F.length(buf) > _PASSAGE))
        return F.struct(F.when(ends, F.concat(x["done"], F.array(buf))).otherwise(x["done"]).alias("done"), F.when(ends, F.lit("")).otherwise(buf).alias("buf"))

    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))
    return F.aggregate(F.split(text, "\n", -1), empty, add, lambda x: F.when(x["buf"] == "", x["done"]).otherwise(F.concat(x["done"], F.array(x["buf"]))))


def best_passages(docs: DataFrame, items: DataFrame, k: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``item_id, doc_id, passage, score, place``: the ``k`` passages of highest BM25 score over all distinct words of each item; a passage that recurs in a row counts once."""
    split = docs.select("doc_id", _cut(F.col("text")).alias("all"))
    split = split.select("doc_id", "all", F.explode(F.array_distinct("all")).alias("t"))
    split = split.select("doc_id", F.array_position("all", F.col("t")).cast("int").alias("passage"), figures.words(F.col("t")).alias("w"))
    return best_of(split, items, k, k1, b)


_GROWN = "CASE WHEN l.buf = '' THEN x.buf WHEN x.buf = '' THEN l.buf ELSE x.buf || ' ' || l.buf END"
_ENDS = f"{_GROWN} <> '' AND (l.buf = '' OR length({_GROWN}) > {_PASSAGE})"


_BM25_SQL = f"""WITH c AS (SELECT row_number() OVER () AS r, doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda l: {{'done': []::VARCHAR[], 'buf': trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13))}}),
  lambda x, l: {{'done': CASE WHEN {_ENDS} THEN list_append(x.done, {_GROWN}) ELSE x.done END, 'buf': CASE WHEN {_ENDS} THEN '' ELSE {_GROWN} END}}, {{'done': []::VARCHAR[], 'buf': ''}}) AS x FROM documents WHERE text IS NOT NULL),
a AS (SELECT r, doc_id, CASE WHEN x.buf = '' THEN x.done ELSE list_append(x.done, x.buf) END AS ps FROM c), u AS (SELECT r, doc_id, unnest(ps) AS t, unnest(range(1, len(ps) + 1)) AS i FROM a),
p AS (SELECT doc_id, min(i)::INTEGER AS passage, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM u GROUP BY r, doc_id, t), s AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM p),
h AS (SELECT doc_id, passage, len, w, count(*) AS tf FROM (SELECT doc_id, passage, len(ws) AS len, unnest(ws) AS w FROM p) GROUP BY ALL), k AS (SELECT w, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, mean FROM h, s GROUP BY w, n, mean),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM benchmark),
b AS (SELECT item_id, doc_id, passage, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score FROM h JOIN k USING (w) JOIN q USING (w) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, passage)::INTEGER AS place FROM b) WHERE place <= 4"""


@query("passages_per_item", _BM25_SQL)
@query("passages_bm25", _BM25_SQL)
def passages_bm25(spark, sf_dir) -> DataFrame:
    """The four passages of highest BM25 score for each item, over all its words; no word is left out for being common."""
    return best_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
