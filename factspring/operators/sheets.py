"""Sheets and pages read for what they state: year blocks, rows of labels on a taxonomy, figures set aside, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import first_match
from ..functions.titles import years_named
from .placing import place_labels, plain

#: Header words of a working's columns, in the order that they are tried.
BLOCK_COLUMNS = (
    ("opening_acc_dep", r"opening\s*acc"), ("closing_acc_dep", r"closing\s*acc"), ("gross_dep", r"allowable\s*gross"), ("net_dep", r"allowable\s*net"), ("dep_on_contribution", r"dep\w*\s*on\s*con"),
    ("dep_retired", r"dep\w*\s*on\s*assets\s*ret"), ("opening_gfa", r"opening\s*gfa|balance\s*depreciable"), ("additions", r"addition"), ("grants", r"grants?"), ("deductions", r"deduction"), ("closing_gfa", r"closing\s*gfa"), ("average_gfa", r"average"), ("rate", r"rate"),
)
SKIPPED = r"(?i)^(total|depreciable assets|non depreciable)"
#: Fixed value: a printed row, its label and then one to fourteen figures.
ROW = r"^([A-Za-z(].*?[A-Za-z)%.])\s+((?:\(?[-–]?[\d,]*\d(?:\.\d+)?\)?%?\s*){1,14})$"


def year_blocks(cells: DataFrame, sheet: list[str], above: int = 3) -> DataFrame:
    """``sheet, at, fiscal_year, title, row, label, key, value, total`` of the workings of a sheet, ``cells`` being ``sheet, row, col, text``.

    A block begins at a cell that says "Particulars" and has its year in one of the ``above`` rows before it; its
    columns are known by their headers, the first of a kind counts. Rows go on until a gap or a total; other headings
    are passed over. ``at`` is row and column of the beginning. Every step meets cells by row or by column, not by range.
    """
    text = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.trim("text"))
    next_ = F.lead("col").over(Window.partitionBy(*sheet, "row").orderBy("col"))
    starts = text.where(F.col("text").rlike(r"(?i)^particulars\s*\*?$")).withColumn("_to", F.coalesce(next_, F.lit(2**31 - 1))).select(*sheet, F.col("row").alias("_i"), F.col("col").alias("_j"), "_to")
    within = lambda low: (F.col("col") >= low) & (F.col("col") < F.col("_to"))
    heads = starts.withColumn("row", F.explode(F.sequence(F.col("_i") - above, F.col("_i") - 1))).join(text, [*sheet, "row"]).where(within(F.col("_j") - 2))
    heads = heads.withColumn("_year", F.get(years_named(F.col("text")), F.lit(0)))
    block = [*sheet, "_i", "_j"]
    dated = heads.where("_year is not null").groupBy(*block).agg(F.min_by(F.struct("_year", "row"), F.struct("row", "col")).alias("_y")).select(*block, "_y._year", F.col("_y.row").alias("_row"))
    titled = heads.join(dated.drop("_year"), block).where((F.col("row") == F.col("_row")) & heads["_year"].isNull()).groupBy(*block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " ").alias("title"))
    known = dated.select(*block, F.col("_year").alias("fiscal_year")).join(titled, block, "left").withColumn("title", F.coalesce("title", F.lit("")))
    columns = starts.join(text, (F.col("_i") == F.col("row")) & _same(starts, text, sheet)).select(*[starts[c] for c in sheet], "_i", "_j", "_to", "col", "text").where(within(F.col("_j") + 1))
    columns = columns.withColumn("key", first_match(F.col("text"), BLOCK_COLUMNS)).where("key is not null").groupBy(*block, "key").agg(F.min("col").alias("col"))
    labels = starts.join(text, (F.col("_j") == F.col("col")) & _same(starts, text, sheet)).where("row > _i").select(*[starts[c] for c in sheet], "_i", "_j", "row", F.col("text").alias("label"))
    w = Window.partitionBy(*block).orderBy("row")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total, skipped = F.col("label").rlike("(?i)^total"), F.col("label").rlike(SKIPPED)
    begun = F.coalesce(F.max((~skipped).cast("int")).over(before), F.lit(0)) > 0
    gap = begun & (F.col("row") - F.lag("row").over(w) > 1)
    labels = labels.withColumn("total", total).withColumn("_gap", F.coalesce(gap, F.lit(False))).withColumn("_end", F.coalesce(F.max(F.col("total").cast("int")).over(before), F.lit(0)) + F.max(F.col("_gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = labels.where((F.col("_end") == 0) & (F.col("total") | ~skipped)).select(*block, "row", "label", "total")
    value = F.regexp_replace("text", ",", "").try_cast("decimal(24,6)")
    filled = rows.join(columns, block).join(text.select(*sheet, "row", "col", value.alias("value")), [*sheet, "row", "col"]).where("value is not null")
    return filled.join(known, block).select(*sheet, F.struct(F.col("_i").alias("row"), F.col("_j").alias("col")).alias("at"), "fiscal_year", "title", "row", "label", "key", "value", "total")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (a[c] == b[c])
    return out


def scanned(lines: DataFrame, document: list[str], page: str, text: str, unit: Column, aliases: DataFrame, refusals: DataFrame) -> DataFrame:
    """``document, bucket, name, n, pages, example``: rows of tables by what their labels name: ``placed`` (a code), ``ambiguous`` (an alias of several codes) or ``unplaced`` (the label).

    Labels of fewer than three letters or digits are no rows. Each distinct label is placed once, whatever the number of its lines.
    """
    line = F.trim(F.col(text))
    rows = lines.where(line.rlike(ROW)).select(*document, page, F.substring(line, 1, 160).alias("_line"), F.regexp_extract(line, ROW, 1).alias("label"), unit.alias("unit"))
    rows = rows.withColumn("_norm", plain(F.col("label"))).where(F.length("_norm") >= 3)
    counted = rows.groupBy(*document, "_norm", "unit").agg(F.count("*").alias("n"), F.collect_set(page).alias("_pages"), F.min("_line").alias("example"))
    asked = counted.select("_norm", "unit").distinct().withColumn("id", F.struct("_norm", "unit"))
    placed = place_labels(asked.select("id", F.col("_norm").alias("label"), "unit"), aliases, refusals).select("id", "code")
    several = aliases.select(plain(F.col("alias")).alias("_norm"), "code").groupBy("_norm").agg(F.count_distinct("code").alias("_codes")).where("_codes > 1")
    named = counted.withColumn("id", F.struct("_norm", "unit")).join(placed, "id", "left").join(several, "_norm", "left")
    bucket = F.when(F.col("code").isNotNull(), "placed").when(F.col("_codes").isNotNull(), "ambiguous").otherwise("unplaced")
    out = named.withColumn("bucket", bucket).withColumn("name", F.coalesce("code", "_norm"))
    return out.groupBy(*document, "bucket", "name").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("pages"), F.min("example").alias("example"))


def set_aside(facts: DataFrame, group: list[str], value: str, considered: Column, least: int = 3, factor: float = 5.0) -> DataFrame:
    """``facts`` with ``middle`` and ``set_aside``: why a considered figure stands too far from the median of its group's positive ones; null in groups with fewer than ``least`` of these, and for all others."""
    seen = facts.withColumn("_in", F.coalesce(considered & F.col(value).isNotNull(), F.lit(False)))
    middle = seen.where(F.col("_in") & (F.col(value) > 0)).groupBy(*group).agg(F.median(F.col(value).cast("double")).alias("middle"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    far = F.col(value).cast("double")
    why = F.when(F.col(value) <= 0, "not above zero").when(far < F.col("middle") / factor, "under a fifth of the median" if factor == 5 else "far under the median").when(far > F.col("middle") * factor, "over five times the median" if factor == 5 else "far over the median")
    return seen.join(middle, group, "left").withColumn("set_aside", F.when(F.col("_in") & F.col("middle").isNotNull(), why)).drop("_in")


def routed(routes: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first route whose condition holds; a condition that is null doesn't."""
    out = F.when(F.coalesce(routes[0][1], F.lit(False)), routes[0][0])
    for name, condition in routes[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(otherwise)


def risks(tags: dict[str, Column]) -> Column:
    """Names of the conditions that hold, joined by commas."""
    return F.concat_ws(",", *[F.when(condition, F.lit(name)) for name, condition in tags.items()])
