"""Network charges and losses from cells of tables: what a table is about, which cells determine something, levels on one axis or on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of network levels, of tables of amounts, and fiscal years in headers.
LEVEL = r"(?i)\b(inter[- ]?state|intra[- ]?state|transmission|ht|lt|ehv|hv|\d{2,3}\s*kv|below\s+\d+\s*kv|above\s+\d+\s*kv|400\s*v)\b"
AMOUNTS = r"(?i)\b(rs\.?\s*(cr|crore|lakh)s?|crore|lakh|\bMU\b|million units|revenue|ARR|expense|cost)\b"
FISCAL_YEAR = r"(?i)\bFY\s?(20\d\d)\s*[-–—/]\s*(\d{2,4})\b"

#: What a table is about: the first family of which it has a word, in any header or row label.
FAMILIES = [("wheeling_charge", "wheeling"), ("cross_subsidy_surcharge", r"cross subsidy|(?<!\S)css(?!\S)"), ("additional_surcharge", "additional surcharge"), ("oa_loss", "loss"), ("green_tariff", "green")]
NAMED = {"wheeling_charge": "wheeling", "additional_surcharge": "additional surcharge", "green_tariff": "green tariff"}
LOSSES = ("oa_loss", "distribution_loss_approved")

#: A figure, and a second one in brackets behind it: ``0.45 (3.5%)``.
FIGURE = r"^\s*(?:Rs\.?\s*)?(-?\d+(?:,\d+)*(?:\.\d+)?)\s*(%)?\s*(?:[(\[]\s*(\d+(?:\.\d+)?)\s*(%)?\s*(?:loss(?:es)?)?\s*[)\]])?\s*$"


def families(cells: DataFrame, grid: list[str], trajectory: Column | None = None) -> DataFrame:
    """``*grid, family, amounts``: what each table is about by the words of all its labels, null for nothing known; and whether it is a table of amounts.

    ``cells`` has ``headers`` and ``rows``, arrays of labels. In a region of loss trajectories (``trajectory``) a table with losses is of approved distribution losses, others of nothing.
    Only marks are aggregated, not the labels.
    """
    words = F.lower(F.concat_ws(" ", "headers", "rows"))
    seen = [F.max(words.rlike(pattern)).alias(f"_is_{name}") for name, pattern in FAMILIES]
    marks = cells.groupBy(*grid).agg(*seen, F.max(F.concat_ws(" ", "headers", "rows").rlike(AMOUNTS)).alias("amounts"), F.max(F.lit(False) if trajectory is None else trajectory).alias("_path"))
    family = F.when(F.col("_path"), F.when(F.col("_is_oa_loss"), "distribution_loss_approved")).otherwise(F.coalesce(*[F.when(F.col(f"_is_{name}"), name) for name, _ in FAMILIES]))
    return marks.select(*grid, family.alias("family"), "amounts")


def level(labels: Column) -> Column:
    """The first label that names a level, whole; null for none."""
    return F.get(F.filter(labels, lambda x: x.rlike(LEVEL)), F.lit(0))


def charges(cells: DataFrame, grid: list[str], trajectory: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts ``*grid, row, col, family, component, value, unit, injection, drawal, level, period`` and the tables that give none, ``*grid, reason``.

    ``cells`` has ``*grid, row, col, headers, rows, raw``. A table whose rows and columns both name levels is a matrix: the row's level is where energy
    is injected, the column's where it is drawn; else the row's or the column's is ``level``. A loss counts if it is a
    percentage with a level, a year or the word; a charge if its label names the family and a unit, or it stands in a matrix of that family. A second figure in brackets is the loss beside a charge.
    Tables of amounts mention a family without determining it. Cells without a plain figure give nothing; repeated cells give repeated facts.
    """
    about = families(cells, grid, trajectory)
    refused = about.where("family is null or amounts").select(*grid, F.when(F.col("family").isNull(), "no family known").otherwise(F.concat("family", F.lit(" in a table of amounts"))).alias("reason"))
    read = cells.join(about.where("family is not null and not amounts").select(*grid, "family"), grid)
    text = F.concat_ws(" ", "headers", "rows")
    group = lambda i: F.nullif(F.regexp_extract("raw", FIGURE, i), F.lit(""))
    year = lambda part: F.when(part.rlike(FISCAL_YEAR), F.concat(F.lit("FY"), F.regexp_extract(part, FISCAL_YEAR, 1), F.lit("-"), F.right(F.regexp_extract(part, FISCAL_YEAR, 2), F.lit(2))))
    seen = read.where(F.col("raw").rlike(FIGURE)).select(
        *grid, "row", "col", "family", text.alias("_text"), level(F.col("rows")).alias("_from"), level(F.col("headers")).alias("_to"),
        F.coalesce(year(F.concat_ws(" ", "headers")), year(F.concat_ws(" ", "rows"))).alias("period"),
        F.regexp_replace(group(1), ",", "").cast("decimal(18,4)").alias("_first"), group(3).cast("decimal(18,4)").alias("_second"), (group(2).isNotNull() | text.contains("%")).alias("_percent"), group(2).isNotNull().alias("_marked"),
    )
    matrix = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    lower = F.lower("_text")
    is_loss = F.col("family").isin(*LOSSES)
    named = F.coalesce(*[F.when(F.col("family") == f, lower.contains(w)) for f, w in NAMED.items()], lower.contains("cross subsidy") | lower.rlike(r"(?<!\S)css(?!\S)"))
    unit = F.when(F.col("_percent") & (is_loss | F.col("_marked")), "percent").when(lower.contains("kwh") | lower.contains("unit"), "INR_per_kWh").when(F.col("_percent"), "percent").when(matrix, "INR_per_kWh")
    counts = F.when(is_loss, F.col("_percent") & (F.coalesce("_from", "_to", "period").isNotNull() | lower.contains("loss"))).otherwise((named | matrix) & unit.isNotNull())
    first = F.struct(F.col("family"), F.when(is_loss, "loss").otherwise("charge").alias("component"), F.col("_first").alias("value"), unit.alias("unit"))
    second = F.struct(F.lit("oa_loss").alias("family"), F.lit("loss").alias("component"), F.col("_second").alias("value"), F.lit("percent").alias("unit"))
    facts = F.concat(F.array(first), F.when(F.col("_second").isNotNull() & ~is_loss, F.array(second)).otherwise(F.array().cast("array<struct<family:string,component:string,value:decimal(18,4),unit:string>>")))
    out = seen.withColumn("_unit", unit).where(counts).select(
        *grid, "row", "col", F.when(matrix, F.col("_from")).alias("injection"), F.when(matrix, F.col("_to")).alias("drawal"), F.when(~matrix, F.coalesce("_from", "_to")).alias("level"), "period", F.explode(facts).alias("_f")
    )
    return out.select(*grid, "row", "col", "_f.family", "_f.component", "_f.value", "_f.unit", "injection", "drawal", "level", "period"), refused
