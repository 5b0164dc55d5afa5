"""Small functions on whole tables: roman numbers, quotes on their page, numbers without a source, snippets, voices in context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.texts import snippet
from ..registry import query
from ..sources.catalog import table

_HUNDREDS = "['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm']"


@query("roman_numbers", f"""SELECT p_partkey, CASE WHEN n > 0 THEN ['', 'm', 'mm', 'mmm'][n // 1000 + 1] || {_HUNDREDS}[n // 100 % 10 + 1] || translate({_HUNDREDS}[n // 10 % 10 + 1], 'cdm', 'xlc') || translate({_HUNDREDS}[n % 10 + 1], 'cdm', 'ivx') END AS roman, CASE WHEN n > 0 THEN n END AS number FROM (SELECT *, (p_partkey * 7 % 4000)::INTEGER AS n FROM part)""")
def roman_numbers(spark, sf_dir) -> DataFrame:
    """Numbers of the parts in roman digits, and read back from them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", labels.to_roman((F.col("p_partkey") * 7 % 4000).cast("int")).alias("roman"))
    return parts.select("p_partkey", "roman", labels.roman(F.col("roman")).alias("number"))


# A quote from each text with other blanks, of one in five with a word that the text hasn't; short texts give quotes too short to tell.
_QUOTE = "CASE WHEN text IS NULL THEN NULL WHEN doc_id % 5 = 0 THEN concat('qqzz', substr(text, 30, 40)) ELSE replace(substr(text, CAST(1 + doc_id % 50 AS INTEGER), 40), ' ', '   ') END"


@query("quotes_grounded", rf"""WITH q AS (SELECT *, regexp_replace(lower({_QUOTE}), '\s+', '', 'g') AS q, regexp_replace(lower(text), '\s+', '', 'g') AS p FROM documents),
n AS (SELECT *, list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS said, regexp_extract_all(concat(source, ' ', doc_id), '\d+(?:\.\d+)?') AS known FROM q)
SELECT doc_id, length(q) >= 8 AND contains(p, q) AS grounded, len(list_filter(said, lambda x: NOT list_contains(known, x))) AS unsupported FROM n""")
def quotes_grounded(spark, sf_dir) -> DataFrame:
    """Whether a quote stands on its page, white space aside, and how many numbers of a text neither its source nor its id has."""
    docs = table(spark, sf_dir, "documents")
    unsupported = labels.unsupported_numbers(F.col("text"), F.concat_ws(" ", "source", "doc_id"))
    return docs.select("doc_id", labels.grounded(F.expr(_QUOTE), F.col("text")).alias("grounded"), F.size(unsupported).cast("long").alias("unsupported"))


@query("snippets", r"""SELECT doc_id, place, trim(regexp_replace(substr(text, greatest(0, place - 30) + 1, 60), '\s+', ' ', 'g')) AS snippet FROM (SELECT doc_id, text, length(regexp_extract(text, '^[^0-9]*'))::INTEGER AS place FROM documents WHERE regexp_matches(text, '[0-9]'))""")
def snippets(spark, sf_dir) -> DataFrame:
    """Sixty characters around the first figure of each document that has one."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).withColumn("place", F.length(F.regexp_extract("text", "^[^0-9]*", 0)))
    return docs.select("doc_id", "place", snippet(F.col("text"), F.col("place"), 60).alias("snippet"))


_HEADER = "CASE o_orderpriority WHEN '1-URGENT' THEN concat('Approved ', o_orderstatus) WHEN '2-HIGH' THEN 'Rs crore' WHEN '3-MEDIUM' THEN 'As approved in the Tariff Order' ELSE NULL END"
_PART = "CASE WHEN o_custkey % 3 = 0 THEN 'Audited figures' WHEN o_custkey % 3 = 1 THEN 'Part B' ELSE NULL END"
_CAPTION = "CASE WHEN o_orderstatus = 'F' THEN concat('Table ', CAST(o_custkey AS VARCHAR(12)), ': costs claimed') ELSE 'Table of costs' END"


@query("voices_in_context", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'approved' WHEN o_orderpriority = '3-MEDIUM' THEN 'approved_earlier' WHEN o_custkey % 3 = 0 THEN 'actual' WHEN o_orderstatus = 'F' THEN 'claimed' END AS voice FROM orders""")
def voices_in_context(spark, sf_dir) -> DataFrame:
    """The voice of a figure from its column's header, else its part of the table, else the caption."""
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.voice_in_context(F.expr(_HEADER), F.expr(_PART), F.expr(_CAPTION)).alias("voice"))
