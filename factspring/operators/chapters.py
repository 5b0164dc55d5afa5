"""Chapters of paged documents: headings, cues, the heaviest rising run of section numbers, spans, and long chapters split again.

Lines stay rows all the way; only the headings of a document, a few of its lines, meet for the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import HEADING_NUMBER, LEADER, chapters
from ..sources.shared import stage
from .pairing import ordered_headings

FURNITURE_PAGES = 5  # pages of a document that a running header or footer stands on at least
EDGE = 3  # lines at the top and bottom of a page where these stand
TAIL_PAGES = 25  # pages that the last chapter has at most
LONG_PAGES = 40  # pages from which a chapter is split at deeper headings


def bare(line: Column) -> Column:
    """A line as running headers are compared: lower case, one blank, numbers as ``#``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), "[0-9]+", "#")


def running_lines(lines: DataFrame, key: list[str], pages: int = FURNITURE_PAGES) -> DataFrame:
    """``key, running`` for the lines (see ``bare``) in the first or last three of at least ``pages`` pages. ``lines`` has ``key, page, line_no, text``."""
    w = Window.partitionBy(*key, "page")
    edges = lines.withColumn("_up", F.row_number().over(w.orderBy("line_no"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("line_no")))).where(f"_up <= {EDGE} or _down <= {EDGE}")
    seen = edges.select(*key, "page", bare(F.col("text")).alias("running")).where("running != ''").distinct()
    return seen.groupBy(*key, "running").agg(F.count("*").alias("pages")).where(F.col("pages") >= pages).select(*key, "running", "pages")


def cue(line: Column, cues: list[tuple[str, str]]) -> Column:
    """``branch`` of the longest phrase that a heading names as words of their own, a plural included; null for none. Of phrases as long as each other the first counts."""
    body = F.lower(F.regexp_replace(F.trim(line), HEADING_NUMBER, ""))
    quoted = lambda phrase: "".join("\\" + c if not c.isalnum() and c != " " else c for c in phrase.lower())
    found = [F.when(body.rlike(rf"(?<![a-z0-9]){quoted(p)}(?:e?s)?(?![a-z0-9])"), F.struct(F.lit(len(p)).alias("long"), F.lit(-i).alias("first"), F.lit(b).alias("branch"))) for i, (b, p) in enumerate(cues)]
    return F.array_max(F.array(*found))["branch"]


def proposed(lines: DataFrame, doc: str, cues: list[tuple[str, str]], tail: int = TAIL_PAGES, long: int = LONG_PAGES) -> DataFrame:
    """``doc, ordinal, branch, heading, number, page_start, page_end, inside`` of the chapters of each document, in order.

    ``lines`` has ``doc, page, line_no, text``. Running headers, contents pages (a quarter of the lines, three at least, have leaders), captions, rows of figures and sentences
    are no headings. Headings numbered by one or two levels must rise: of a document's the heaviest rising run is kept, one with a cue weighing two. A chapter
    starts at a heading of the run with a cue, and neighbours of one branch are one chapter; it ends on the page of the next,
    so that a table above that heading stays in, or at the document's end, ``tail`` pages on at most. A chapter of ``long`` pages or more
    is split at three-level headings with a cue inside it, those of their heaviest rising run; ``inside`` then names the chapter's heading.
    Documents without such headings have no rows; null texts are empty lines.
    """
    own = lines.select(F.col(doc).alias("doc"), "page", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    last = own.groupBy("doc").agg(F.max("page").alias("last_page"))
    contents = own.groupBy("doc", "page").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(LEADER)).alias("leaders")).where("leaders >= 3 and 4 * leaders >= n").select("doc", "page")
    running = running_lines(own, ["doc"]).select("doc", "running")
    read = own.withColumn("running", bare(F.col("text"))).join(contents, ["doc", "page"], "left_anti").join(running, ["doc", "running"], "left_anti")
    three = r"^\s*([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,2})\.?\s+\S"
    two = r"^\s*([0-9]{1,2})(?:\.([0-9]{1,2}))?\.?\s+(?=\S)"
    level = lambda pattern, i: F.coalesce(F.regexp_extract("text", pattern, i).try_cast("int"), F.lit(0))
    heads = chapters(read, "text").where("opens").withColumn("branch", cue(F.col("text"), cues)).withColumn("deep", F.col("text").rlike(three))
    number = F.when(F.col("deep"), 10000 * level(three, 1) + 100 * level(three, 2) + level(three, 3)).otherwise(10000 * level(two, 1) + 100 * level(two, 2))
    heads = heads.where(F.col("deep") | F.col("text").rlike(two)).withColumn("number", number.cast("double")).withColumn("place", (F.col("page") * 1000000 + F.col("line_no")).cast("long"))
    heads = stage(heads.select("doc", "page", "place", "number", "branch", "deep", F.trim("text").alias("heading")), "headings")

    def rising(some: DataFrame, group: str) -> DataFrame:
        weighed = some.withColumn("weight", F.when(F.col("branch").isNotNull(), 2.0).otherwise(1.0))
        return ordered_headings(weighed.select(group, "place", "number", "weight"), group, "place", "number", "weight").select(group, "place")

    main = heads.where("not deep")
    kept = main.join(rising(main, "doc"), ["doc", "place"]).where("branch is not null")
    w = Window.partitionBy("doc").orderBy("place")
    starts = kept.withColumn("before", F.lag("branch").over(w)).where("before is null or before != branch").drop("before")
    spans = starts.withColumn("next", F.lead("page").over(w)).join(last, "doc")
    spans = spans.withColumn("page_end", F.coalesce("next", F.least("last_page", F.col("page") + tail)))
    spans = stage(spans.select("doc", "place", "page", "page_end", "branch", "heading", "number", F.concat_ws("#", "doc", "place").alias("chapter")), "chapters")

    # a deep heading belongs to the last chapter that starts on a page before its own
    marks = spans.where(F.col("page_end") - F.col("page") + 1 >= long).select("doc", "page", F.struct("chapter", "page_end", "heading").alias("of"), F.lit(None).cast("struct<place:bigint,number:double,branch:string,heading:string>").alias("head"))
    deep = heads.where("deep and branch is not null").select("doc", "page", F.lit(None).cast(marks.schema["of"].dataType).alias("of"), F.struct("place", "number", "branch", "heading").alias("head"))
    so_far = Window.partitionBy("doc").orderBy("page", F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marks.union(deep).withColumn("of", F.last("of", ignorenulls=True).over(so_far)).where("head is not null and of is not null and page <= of.page_end")
    within = within.select("doc", "page", "of.chapter", "of.page_end", F.col("of.heading").alias("inside"), "head.*")
    within = within.join(rising(within, "chapter"), ["chapter", "place"])
    c = Window.partitionBy("chapter").orderBy("place")
    parts = within.withColumn("before", F.lag("branch").over(c)).where("before is null or before != branch")
    parts = parts.withColumn("page_end", F.coalesce(F.lead("page").over(c), "page_end"))
    cut = parts.groupBy("chapter").agg(F.min("page").alias("cut"))
    whole = spans.join(cut, "chapter", "left").withColumn("page_end", F.coalesce("cut", "page_end")).withColumn("inside", F.lit(None).cast("string"))
    columns = ["doc", "place", "branch", "heading", "number", "page", "page_end", "inside"]
    out = whole.select(columns).unionByName(parts.select(columns))
    ordinal = F.row_number().over(Window.partitionBy("doc").orderBy("place"))
    return out.select(F.col("doc").alias(doc), ordinal.alias("ordinal"), "branch", "heading", F.col("number").cast("int").alias("number"), F.col("page").alias("page_start"), "page_end", "inside")
