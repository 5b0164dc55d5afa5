"""Grids read as tables of values: text with places to cells, cells to values under their headers.

Both work on long tables, a row for each cell, so that a table's size is no limit and Spark shares the work by table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import voice_of
from ..functions.titles import years_named

#: What counts as a printed figure, a dash for none, and a serial number before a label.
FIGURE = r"^\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?$"
DASH = "^[-–—]+$"
SERIAL = r"(?i)^(?:\(?[ivxlc]+[.)]|\(?[a-z][.)]|[0-9]{1,2}(?:\.[0-9])?[.)]?)$"
HEADER_LIMIT = 8  # rows above the values that can be a header
NUMBERED = r"(?i)^(?:s|sl|sr)\.? ?no\.?$"
TOTAL = r"(?i)\btotal\b"
VOICE_ROW = r"(?i)^(?:proposed|approved|claimed|admitted|allowed|projected|actual)$"


def figure(text: Column) -> Column:
    """The number that a printed figure stands for, negative in brackets; null for other texts."""
    bare = F.regexp_replace(text, r"[(),%\s]", "")
    exact = bare.try_cast("decimal(28,6)")
    return F.when(F.trim(text).rlike(FIGURE), F.when(F.trim(text).rlike(r"^\("), -exact).otherwise(exact))


def text_cells(lines: DataFrame, page: str, line: str, text: str, apart: int = 2, tolerance: int = 2) -> DataFrame:
    """``page, row, col, text``: the grids that pages of text print by position.

    Words fewer than ``apart`` blanks from each other are one phrase. The right edges of a page's figures, sorted, fall into columns wherever
    neighbours are more than ``tolerance`` apart; a column lies at the median of its edges. A phrase left of the first
    column is a label (column 0), a serial number at the start of a line, before words, stands apart (column -1). In lines without figures above the first that has some, each column takes the phrase whose middle is nearest to its own. Lines with nothing
    are left out, a page without figures gives no cells. All steps are windows within a page, so lines that lie by page already aren't moved.
    """
    own = lines.select(F.col(page).alias("page"), F.col(line).alias("row"), F.regexp_extract_all(F.col(text), F.lit(rf"\s*\S+(?:\s{{1,{apart - 1}}}\S+)*"), F.lit(0)).alias("found"))
    each = own.select("page", "row", F.posexplode("found").alias("place", "piece"))
    so_far = Window.partitionBy("page", "row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    phrases = each.withColumn("x1", F.sum(F.length("piece")).over(so_far)).withColumn("text", F.trim("piece"))
    phrases = phrases.withColumn("after", F.lead("text").over(Window.partitionBy("page", "row").orderBy("place")))
    serial = (F.col("place") == 0) & F.col("text").rlike(SERIAL) & F.col("after").isNotNull() & figure(F.col("after")).isNull() & ~F.col("after").rlike(DASH)
    phrases = phrases.select("page", "row", "text", (F.col("x1") - F.length("text")).alias("x0"), "x1", serial.alias("serial")).withColumn("value", figure(F.col("text")).isNotNull() & ~F.col("serial"))

    # what isn't a figure runs through the same windows beside the figures
    kind = Window.partitionBy("page", "value").orderBy("x1")
    stepped = phrases.withColumn("step", F.when(F.col("x1") - F.lag("x1").over(kind) > tolerance, 1).otherwise(0)).withColumn("col", 1 + F.sum("step").over(kind))
    column, whole = Window.partitionBy("page", "value", "col"), Window.partitionBy("page")
    placed = stepped.withColumn("nth", F.row_number().over(column.orderBy("x1"))).withColumn("all", F.count("*").over(column))
    placed = placed.withColumn("middle", (F.min("x0").over(column) + F.min(F.when(2 * F.col("nth") >= F.col("all"), F.col("x1"))).over(column)) / 2)
    placed = placed.withColumn("left", F.min(F.when(F.col("value"), F.col("x0"))).over(whole)).withColumn("first_row", F.min(F.when(F.col("value"), F.col("row"))).over(whole))
    placed = placed.withColumn("columns", F.collect_list(F.when(F.col("value") & (F.col("nth") == 1), F.struct("col", "middle"))).over(whole)).where("left is not null")

    # a phrase that ends before the columns begin is a label, wherever it stands; its words are joined in order
    head = ~F.col("value") & (F.col("row") < F.col("first_row")) & (F.col("x1") >= F.col("left"))
    kinds = placed.select("page", "row", "col", "text", "x0", "x1", "serial", "value", (~F.col("value") & (F.col("x1") < F.col("left"))).alias("label"), head.alias("head"), F.when(head, F.col("columns")).alias("columns")).where("value or label or head")
    words = lambda of: F.array_sort(F.collect_list(F.when(of, F.struct("x0", "text"))))
    rows = kinds.groupBy("page", "row").agg(
        F.collect_list(F.when(F.col("value"), F.struct("col", "text"))).alias("values"), words(F.col("label") & F.col("serial")).alias("serials"), words(F.col("label") & ~F.col("serial")).alias("labels"),
        F.collect_list(F.when(F.col("head"), F.struct(((F.col("x0") + F.col("x1")) / 2).alias("at"), "text"))).alias("heads"), F.first("columns", ignorenulls=True).alias("columns"),
    )
    cell = lambda col, text: F.struct(col.cast("long").alias("col"), text.alias("text"))
    joined = lambda of, col: F.when(F.size(of) > 0, F.array(cell(F.lit(col), F.concat_ws(" ", f"{of}.text"))))
    nearest = lambda c: F.array_min(F.transform("heads", lambda h: F.struct(F.abs(h["at"] - c["middle"]).alias("far"), h["at"].alias("at"), h["text"].alias("text"))))
    parts = [F.transform("values", lambda v: cell(v["col"], v["text"])), joined("serials", -1), joined("labels", 0), F.transform("columns", lambda c: cell(c["col"], nearest(c)["text"]))]
    none = F.array().cast("array<struct<col:bigint,text:string>>")
    return rows.select("page", "row", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("c")).select("page", "row", "c.*")


def interpreted(cells: DataFrame, table: str, titles: DataFrame | None = None) -> DataFrame:
    """``table, row, col, label, group, fiscal_year, year_from, voice, voice_from, total, value`` of every figure of each grid.

    ``cells`` has ``table, row, col, text``; ``titles`` has ``table, title``. Header rows are those above the first with
    a label and a figure, eight at most. In all of them but the last a blank takes what stands on its left, so that years and voices
    over several columns fall to each. The label column is the first whose cells are words for the better half; value columns lie on its right and hold figures
    or dashes for three fifths. A column of serial numbers is none. A column is a total if its header says so, or if in three rows or more, and in all, it is the sum of the others of its table.
    A row without figures groups the rows below it until the next; a label that is nothing but a voice overrides the column's, and its label is the group's; a label that is a year overrides the year, and the column's header is the label.
    The year is the row's, the header's or the title's, if that names one alone; so is the voice. Blank and null cells count as none; a grid without value columns gives no rows.
    All steps are windows within a table: cells are moved once at most, not at all where they lie by table already, and never staged.
    """
    key = [table]
    whole, row, col = Window.partitionBy(*key), Window.partitionBy(*key, "row"), Window.partitionBy(*key, "col")
    grid = cells.select(table, "row", "col", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text")).where("text != ''")
    grid = grid.withColumn("number", figure(F.col("text"))).withColumn("serial", F.col("text").rlike(SERIAL)).withColumn("value_like", F.col("number").isNotNull() | F.col("text").rlike(DASH))
    grid = grid.withColumn("n", F.dense_rank().over(whole.orderBy("row"))).withColumn("top_row", F.min("row").over(whole))  # by table first: all that follows finds the cells dealt out
    both = F.max(~F.col("value_like") & ~F.col("serial")).over(row) & F.max(F.col("number").isNotNull() & ~F.col("serial")).over(row)
    grid = grid.withColumn("both", both).withColumn("far", F.max("col").over(row))
    grid = grid.withColumn("start", F.least(F.min(F.when(F.col("both"), F.col("n"))).over(whole), F.lit(HEADER_LIMIT + 1)))
    grid = grid.withColumn("first_row", F.min(F.when(F.col("n") == F.col("start"), F.col("row"))).over(whole)).where("first_row is not null").drop("n", "both", "start")

    grid = grid.withColumn("nth", F.row_number().over(col.orderBy("row"))).withColumn("inside", F.col("row") >= F.col("first_row"))
    counts = {"n": F.col("inside"), "words": ~F.col("value_like") & ~F.col("serial"), "values": F.col("value_like"), "numbers": F.col("number").isNotNull(), "small": F.col("text").rlike("^[0-9]{1,2}$")}
    grid = grid.withColumns({c: F.count_if(F.col("inside") & holds).over(col) for c, holds in counts.items()})
    grid = grid.withColumn("label_col", F.min(F.when((F.col("n") > 0) & (2 * F.col("words") >= F.col("n")), F.col("col"))).over(whole)).where("label_col is not null")
    valued = (F.col("col") > F.col("label_col")) & (5 * F.col("values") >= 3 * F.col("n")) & (F.col("numbers") > 0)
    # a row below the first that has nothing but a label is no header, it groups what follows
    above = (F.col("row") < F.col("first_row")) & ~((F.col("row") > F.col("top_row")) & (F.col("far") <= F.col("label_col")))
    grid = grid.select(*key, "row", "col", "text", "number", "serial", "value_like", "nth", valued.alias("valued"), (valued & ~((F.col("n") >= 3) & (F.col("small") == F.col("n")))).alias("asked"), above.alias("above"))

    # headers: every value column of every header row, blanks filled from the left in all rows but the last; worked out beside a column's first cell
    grid = grid.withColumn("last", F.max(F.when(F.col("above"), F.col("row"))).over(whole)).withColumn("heads", F.array_sort(F.collect_list(F.when(F.col("above") & F.col("valued"), F.struct("row", "col", "text"))).over(whole)))
    mine = F.filter("heads", lambda h: (h["col"] <= F.col("col")) & ((h["row"] < F.col("last")) | (h["col"] == F.col("col"))))
    grid = grid.withColumn("heads", F.when(F.col("asked") & (F.col("nth") == 1), mine))
    header = F.concat_ws(" ", F.transform(F.filter("heads", lambda h, i: F.coalesce(F.get("heads", i + 1)["row"] != h["row"], F.lit(True))), lambda h: h["text"]))
    grid = grid.withColumn("header", F.when(F.col("heads").isNotNull(), header))
    one = lambda c: F.when(F.size(years_named(F.coalesce(c, F.lit("")))) == 1, years_named(c)[0])
    named = F.struct("header", one(F.col("header")).alias("head_year"), voice_of(F.col("header")).alias("head_voice"), F.col("header").rlike(TOTAL).alias("total_name"))
    grid = grid.withColumn("meant", F.max(F.when(F.col("header").isNotNull() & ~F.col("header").rlike(NUMBERED), named)).over(col))

    body = grid.where("not above").groupBy(*key, "row").agg(
        F.array_sort(F.collect_list(F.when(F.col("meant").isNull() & ~F.col("value_like") & ~F.col("serial"), F.struct("col", "text")))).alias("words"),
        F.collect_list(F.when(F.col("meant").isNotNull() & F.col("number").isNotNull(), F.struct("col", "number", "meant"))).alias("figures"),
    )
    own = body.withColumn("own", F.concat_ws(" ", "words.text")).drop("words")
    group = F.last(F.when((F.size("figures") == 0) & (F.col("own") != ""), F.col("own")), ignorenulls=True).over(whole.orderBy("row"))
    own = own.withColumn("group", group).where(F.size("figures") > 0).withColumn("own_years", years_named(F.col("own")))
    if titles is not None:
        own = own.join(titles.select(table, one(F.col("title")).alias("title_year"), voice_of(F.col("title")).alias("title_voice")), key, "left")
    else:
        own = own.withColumns({c: F.lit(None).cast("string") for c in ("title_year", "title_voice")})
    voiced, dated = F.col("own").rlike(VOICE_ROW), (F.size("own_years") == 1) & (F.length("own") <= 16)
    own = own.withColumns({"voiced": voiced, "dated": dated, "row_year": F.when(dated, F.col("own_years")[0]), "row_voice": F.when(voiced, voice_of(F.col("own")))})
    # of the columns that the header doesn't call a total, one may still be the sum of all others
    summed = F.aggregate("figures", F.lit(0).cast("decimal(38,6)"), lambda done, f: (done + f["number"]).cast("decimal(38,6)"))
    own = own.withColumn("all", F.when(F.size("figures") >= 3, summed))
    out = own.select("*", F.explode("figures").alias("f")).drop("figures", "own_years").select("*", "f.col", "f.number", "f.meant.*").drop("f")
    judged = out.withColumn("sums_up", F.min(F.coalesce(2 * F.col("number") == F.col("all"), F.lit(False))).over(col) & (F.count("*").over(col) >= 3))
    label_of = F.when(F.col("voiced") & F.col("group").isNotNull(), F.col("group")).when(F.col("dated"), F.col("header")).when(F.col("own") == "", F.col("group")).otherwise(F.col("own"))
    return judged.select(
        *key, "row", "col", label_of.alias("label"), "group", F.coalesce("row_year", "head_year", "title_year").alias("fiscal_year"), F.when(F.col("row_year").isNotNull(), "row").when(F.col("head_year").isNotNull(), "header").when(F.col("title_year").isNotNull(), "title").alias("year_from"),
        F.coalesce("row_voice", "head_voice", "title_voice").alias("voice"), F.when(F.col("row_voice").isNotNull(), "row").when(F.col("head_voice").isNotNull(), "header").when(F.col("title_voice").isNotNull(), "title").alias("voice_from"),
        (F.col("total_name") | F.col("sums_up")).alias("total"), F.col("number").alias("value"),
    )
