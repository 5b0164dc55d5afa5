"""Chapters proposed over documents of many pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chapters import proposed
from ..registry import query
from ..sources.catalog import table

CUES = [("sales", "energy sales"), ("losses", "distribution loss"), ("purchase", "power purchase"), ("purchase", "power purchase cost"), ("capital", "interest"), ("arr", "revenue requirement")]
PAGES, LONG, TAIL = 60, 4, 9
_NAMES = ["Energy Sales", "Distribution Losses", "Power Purchase Cost", "Interest on Loans", "Aggregate Revenue Requirement", "Public Hearing"]


def pages(spark, sf_dir) -> DataFrame:
    """Sixty documents in a row are the pages of one: a running header, a numbered heading that names a word of the text, on pages chosen by their length (now and then out of order, or three levels deep), the text's lines, a page number."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / PAGES).alias("book"), (F.col("doc_id") % PAGES).cast("int").alias("page"), "text", F.coalesce("n_chars", F.lit(0)).alias("n"))
    name = F.concat(F.get(F.array(*map(F.lit, _NAMES)), (F.col("n") % len(_NAMES)).cast("int")), F.lit(", "), F.regexp_extract(F.coalesce("text", F.lit("")), r"\p{L}{5,}", 0))
    top = (F.when(F.col("n") % 11 == 0, 99 - F.col("page")).otherwise(F.floor(F.col("page") / 4) + 1)).cast("string")
    heading = F.when(F.col("n") % 3 == 0, F.concat(top, F.lit(". "), name)).when(F.col("n") % 3 == 1, F.concat(top, F.lit("."), (F.col("page") % 4 + 1).cast("string"), F.lit(".1 "), name)).otherwise(F.lit(""))
    lines = F.concat(F.array(F.concat(F.lit("ORDER OF BOOK "), F.col("book").cast("string")), heading), F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.concat(F.lit("Page "), F.col("page").cast("string"))))
    return d.select("book", "page", F.posexplode(lines).alias("line_no", "text"))


@query("chapters_proposed")
def chapters_proposed(spark, sf_dir) -> DataFrame:
    """The chapters of each book of sixty pages (X32), long ones split at deeper headings."""
    return proposed(pages(spark, sf_dir), "book", CUES, TAIL, LONG)
