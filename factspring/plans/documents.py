"""Questions over documents, pages and vectors: reading, evidence, quality of text, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures, passages
from ..operators.chapters import FURNITURE_PAGES, bare
from ..operators.retrieval import LIST, bm25, fuse, nearest, ranked
from ..registry import query
from ..sources.catalog import table

TERMS = ["the", "tion", "on", "ver"]
_PRINTED = "CASE o_orderkey % 8 WHEN 0 THEN 'Nil' WHEN 1 THEN '-' WHEN 2 THEN '(' || {p} || ')' WHEN 3 THEN 'Rs. ' || {p} WHEN 4 THEN {p} || ' %' WHEN 5 THEN '' WHEN 6 THEN 'as per order' ELSE {p} END"


@query("normalise_values", f"""WITH t AS (SELECT o_orderkey, {_PRINTED.format(p="o_totalprice::DECIMAL(18,2)::VARCHAR")} AS printed FROM orders)
SELECT o_orderkey, printed, CASE o_orderkey % 8 WHEN 0 THEN 'zero' WHEN 1 THEN 'not_applicable' WHEN 5 THEN 'unknown' WHEN 6 THEN 'text' ELSE 'value' END AS state,
  CASE WHEN o_orderkey % 8 IN (3, 4, 7) THEN regexp_extract(printed, '[0-9]+[.][0-9]+')::DECIMAL(28,6) WHEN o_orderkey % 8 = 2 THEN -(regexp_extract(printed, '[0-9]+[.][0-9]+')::DECIMAL(28,6)) END AS value FROM t""")
def normalise_values(spark, sf_dir) -> DataFrame:
    """Printed cells as a state and a value; states that are no number never become 0."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PRINTED.format(p="cast(cast(o_totalprice as decimal(18,2)) as string)")).alias("printed"))
    return t.select("o_orderkey", "printed", figures.value_state(F.col("printed")).alias("state"), figures.figure(F.col("printed")).alias("value"))


_TITLE = "'Tariff order for ' || CASE o_orderkey % 4 WHEN 0 THEN 'FY ' || y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') WHEN 1 THEN y || '-' || (y + 1) WHEN 2 THEN y || '/' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') ELSE 'FY ' || y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') || ' and ' || (y + 1) || '-' || (y + 2) END"


@query("fiscal_years", f"WITH o AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders) SELECT o_orderkey, {_TITLE} AS title, CASE WHEN o_orderkey % 4 <> 3 THEN 'FY' || y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') END AS fiscal_year FROM o")
def fiscal_years(spark, sf_dir) -> DataFrame:
    """The year that a title decides, in three spellings; two years are ambiguous and give none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    title = F.expr(_TITLE.replace("::VARCHAR", "").replace("((y + 1) % 100)", "cast((y + 1) % 100 as string)"))
    return o.select("o_orderkey", title.alias("title")).withColumn("fiscal_year", figures.fiscal_year(F.col("title")))


@query("slab_labels", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'up to ' || p_size || ' units' WHEN 1 THEN p_size || ' - ' || (p_size + 50) || ' units' ELSE 'Above ' || p_size || ' units' END AS label,
  CASE p_partkey % 3 WHEN 0 THEN 0 ELSE p_size END AS lower, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 50 END AS upper FROM part""")
def slab_labels(spark, sf_dir) -> DataFrame:
    label = F.expr("case p_partkey % 3 when 0 then 'up to ' || p_size || ' units' when 1 then p_size || ' - ' || (p_size + 50) || ' units' else 'Above ' || p_size || ' units' end")
    out = table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("s", figures.slab(F.col("label")))
    return out.select("p_partkey", "label", "s.lower", "s.upper")


@query("evidence_check", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(18,2)::VARCHAR AS printed FROM lineitem), p AS (SELECT l_orderkey, list(DISTINCT printed) AS page FROM r WHERE l_linenumber <> 7 GROUP BY l_orderkey)
SELECT r.l_orderkey, l_linenumber, l_partkey, CASE WHEN p.page IS NULL THEN 'no such page' WHEN NOT list_contains(p.page, printed) THEN 'the number is not on the page' END AS reason FROM r LEFT JOIN p USING (l_orderkey)""")
def evidence_check(spark, sf_dir) -> DataFrame:
    """Each printed figure must stand on its page; a reason, or null where it does."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("printed"))
    page = r.where("l_linenumber <> 7").groupBy("l_orderkey").agg(F.collect_set("printed").alias("page"))
    reason = F.when(F.col("page").isNull(), F.lit("no such page")).when(~F.array_contains("page", F.col("printed")), F.lit("the number is not on the page"))
    return r.join(page, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@query("text_quality", """SELECT doc_id, round(1.0::DOUBLE * length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) / greatest(length(text), 1), 6) AS glyphs, round(1.0::DOUBLE * len(regexp_extract_all(text, '[A-Za-z]{2,}')) / greatest(len(regexp_extract_all(text, '[^ \\n]+')), 1), 6) AS wordlike FROM documents""")
def text_quality(spark, sf_dir) -> DataFrame:
    """Shares of plain characters and of word-like runs."""
    d = table(spark, sf_dir, "documents")
    glyphs = F.length(F.regexp_replace("text", r"[^\x20-\x7E]", "")) / F.greatest(F.length("text"), F.lit(1))
    wordlike = F.regexp_count("text", F.lit("[A-Za-z]{2,}")) / F.greatest(F.regexp_count("text", F.lit("[^ \n]+")), F.lit(1))
    return d.select("doc_id", F.round(glyphs, 6).alias("glyphs"), F.round(wordlike, 6).alias("wordlike"))


@query("furniture", """WITH l AS (SELECT doc_id, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
e AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(line)), '\\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS line FROM l WHERE (i <= 3 OR i > n - 3))
SELECT line, count(DISTINCT doc_id) AS pages FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 5""")
def furniture(spark, sf_dir) -> DataFrame:
    """Lines that stand in the first or last three of five or more pages, numbers alike. A page's own repeats go inside its row."""
    lines = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    ends = F.array_distinct(F.transform(F.concat(F.slice("lines", 1, 3), F.slice(F.reverse("lines"), 1, 3)), bare))
    return d.select(F.explode(ends).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("pages")).where(F.col("pages") >= FURNITURE_PAGES)


@query("html_links", """SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)""")
def html_links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("html_titles", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def html_titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query("dedup_hash", "SELECT sha256(text) AS sha256, min(doc_id) AS first_listed, count(*) AS copies FROM documents GROUP BY 1")
def dedup_hash(spark, sf_dir) -> DataFrame:
    """The first listed of each content hash."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_listed"), F.count("*").alias("copies"))


@query("label_keys", "SELECT p_partkey, regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '', 'g') AS key FROM part")
def label_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", figures.label_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("key"))


@query("label_suggestions", """WITH k AS (SELECT DISTINCT p_name FROM part), a AS (SELECT p_name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM k), b AS (SELECT DISTINCT p_type || ' ' || p_name AS label FROM part), c AS (SELECT label, list_distinct(string_split(lower(label), ' ')) AS w FROM b),
s AS (SELECT label, p_name, 1.0::DOUBLE * len(list_intersect(a.w, c.w)) / len(list_distinct(list_concat(a.w, c.w))) AS score FROM a JOIN c ON len(list_intersect(a.w, c.w)) > 0)
SELECT label, p_name, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, p_name)::INTEGER AS place FROM s) WHERE place <= 3""")
def label_suggestions(spark, sf_dir) -> DataFrame:
    """The three known labels with the largest word overlap; candidates meet by a shared word, not by a cross join."""
    from ..operators.latest import top_in_group

    parts = table(spark, sf_dir, "part")
    known = parts.select("p_name").distinct().withColumn("a", F.array_distinct(figures.words(F.col("p_name"))))
    asked = parts.select(F.concat_ws(" ", "p_type", "p_name").alias("label")).distinct().withColumn("c", F.array_distinct(figures.words(F.col("label"))))
    pairs = known.withColumn("word", F.explode("a")).join(asked.withColumn("word", F.explode("c")), "word").select("label", "p_name", "a", "c").distinct()
    scored = pairs.select("label", "p_name", F.round(figures.jaccard(F.col("a"), F.col("c")), 6).alias("score"))
    return top_in_group(scored, ["label"], [F.col("score").desc(), F.col("p_name")], 3)


@query("paragraph_kinds")
def paragraph_kinds(spark, sf_dir) -> DataFrame:
    """Paragraphs of every page, tested against a plain reading of small pages."""
    return passages.split_paragraphs(table(spark, sf_dir, "documents"))


@query("page_chunks")
def page_chunks(spark, sf_dir) -> DataFrame:
    return passages.chunk_pages(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS len, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))} FROM w),
s AS (SELECT count(*) AS n, avg(len) AS mean, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c),
b AS (SELECT doc_id, round({' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))' for i in range(len(TERMS)))}, 9) AS score FROM c, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))})"""


@query("bm25", f"WITH {_BM25} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def bm25_top(spark, sf_dir) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.col("score").desc(), "doc_id").limit(10)


def _asked(spark, sf_dir) -> list[float]:
    """The vector that stands for the question: that of vec_id 0."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_NEAR = "v AS (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS distance FROM embeddings)"


@query("vector_topk", f"WITH {_NEAR} SELECT vec_id, distance FROM v ORDER BY distance, vec_id LIMIT 50")
def vector_topk(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir))


@query("hybrid_rrf", f"WITH {_BM25}, {_NEAR}, f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 50), g AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM v QUALIFY rank <= 50) SELECT id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY id ORDER BY score DESC, id LIMIT 30")
def hybrid_rrf(spark, sf_dir) -> DataFrame:
    """Both lists are cut to their top before they are ranked and fused."""
    text = bm25(table(spark, sf_dir, "documents"), TERMS).orderBy(F.col("score").desc(), "doc_id").limit(LIST)
    near = nearest(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir))
    return fuse([ranked(text, "doc_id", F.col("score").desc(), F.col("doc_id")), ranked(near, "vec_id", F.col("distance"), F.col("vec_id"))])
