"""Sheets, scans and headline figures, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sheets
from ..registry import query
from ..sources.catalog import FACTS_SQL, facts, table
from .forms import ALIASES, REFUSALS, _sql

#: A sheet as rows of cells; "#" stands for the number of the supplier.
SHEET = [
    ["", "Depreciation", "FY 2024-25", "", "", "", "Note on FY 2025-26", "", ""],
    ["", "", "", "", "", "", "", "", ""],
    ["", "Particulars", "Opening GFA", "Additions", "Rate", "", "Particulars *", "Closing GFA", "Opening Acc. Dep"],
    ["", "Depreciable assets", "", "", "", "", "Land", "#", "5"],
    ["", "Plant", "1,00#", "20", "5.28", "", "Lines", "7", "x"],
    ["", "Lines", "30", "", "3.34", "", "", "", ""],
    ["", "Total", "40", "20", "", "", "Meters", "9", "9"],
    ["", "After", "1", "1", "1", "", "Total", "9", "9"],
]
#: first column, year, title, row, label, key, value before and after the supplier's number, total
BLOCKS = [
    (1, "FY2024-25", "Depreciation", 4, "Plant", "opening_gfa", "100#", False), (1, "FY2024-25", "Depreciation", 4, "Plant", "additions", "20", False), (1, "FY2024-25", "Depreciation", 4, "Plant", "rate", "5.28", False),
    (1, "FY2024-25", "Depreciation", 5, "Lines", "opening_gfa", "30", False), (1, "FY2024-25", "Depreciation", 5, "Lines", "rate", "3.34", False), (1, "FY2024-25", "Depreciation", 6, "Total", "opening_gfa", "40", True), (1, "FY2024-25", "Depreciation", 6, "Total", "additions", "20", True),
    (6, "FY2025-26", "", 3, "Land", "closing_gfa", "#", False), (6, "FY2025-26", "", 3, "Land", "opening_acc_dep", "5", False), (6, "FY2025-26", "", 4, "Lines", "closing_gfa", "7", False),
]
_ROWS = ", ".join("(" + ", ".join(map(_sql, row)) + ")" for row in BLOCKS)


@query("year_blocks", f"SELECT s_suppkey, col, fiscal_year, title, row, label, key, replace(v, '#', s_suppkey::VARCHAR)::DECIMAL(24,6) AS value, total FROM supplier, (VALUES {_ROWS}) b(col, fiscal_year, title, row, label, key, v, total)")
def year_blocks(spark, sf_dir) -> DataFrame:
    """Blocks of a working by fiscal year, two on one sheet."""
    grid = F.array(*[F.array(*map(F.lit, row)) for row in SHEET])
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(grid).alias("row", "cells")).select("s_suppkey", "row", F.posexplode("cells").alias("col", "text"))
    out = sheets.year_blocks(cells.withColumn("text", F.replace("text", F.lit("#"), F.col("s_suppkey").cast("string"))), ["s_suppkey"])
    return out.select("s_suppkey", F.col("at.col").alias("col"), "fiscal_year", "title", "row", "label", "key", "value", "total")


#: line: bucket, name; None for lines that are no rows
SCANNED = {
    "Power Purchase Cost 1,234.50 1,300.00": ("placed", "C.PP"), "1.2 Employee expenses (12.5)": None, "Employee expenses 12.5 13.1": ("placed", "C.OM.EMP"), "Hydro 120 130": ("ambiguous", "hydro"),
    "Other matters 4.5": ("unplaced", "other matters"), "A sentence of the order.": None, "Net O&M Expenses 7": ("placed", "C.OM"),
}


@query("label_scan", f"SELECT p_size, bucket, name, count(*)::BIGINT AS n, count(DISTINCT p_partkey % 3)::INTEGER AS pages, min(line) AS example FROM part JOIN (VALUES {', '.join(f'({i}, {_sql(line)}, {_sql(v[0])}, {_sql(v[1])})' for i, (line, v) in enumerate(SCANNED.items()) if v)}) s(i, line, bucket, name) ON i = p_partkey % {len(SCANNED)} GROUP BY p_size, bucket, name")
def label_scan(spark, sf_dir) -> DataFrame:
    """Printed rows of documents by what their labels name: placed, ambiguous, unplaced."""
    line = F.get(F.array(*map(F.lit, SCANNED)), (F.col("p_partkey") % len(SCANNED)).cast("int"))
    lines = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 3).alias("page"), line.alias("line"))
    return sheets.scanned(lines, ["p_size"], "page", "line", F.lit(None).cast("string"), spark.createDataFrame(ALIASES, "alias string, code string, unit string"), spark.createDataFrame(REFUSALS, "code string, phrase string"))


@query("headlines_set_aside", f"""WITH {FACTS_SQL}, h AS (SELECT *, head = 'arr' AND voice <> 'actual' AND utility % 10 <> 0 AS considered FROM facts), m AS (SELECT utility, median(value::DOUBLE) AS middle FROM h WHERE considered AND value > 0 GROUP BY utility HAVING count(*) >= 3)
SELECT fact_id, CASE WHEN NOT considered OR middle IS NULL THEN NULL WHEN value <= 0 THEN 'not above zero' WHEN value::DOUBLE < middle / 5 THEN 'under a fifth of the median' WHEN value::DOUBLE > middle * 5 THEN 'over five times the median' END AS set_aside FROM h LEFT JOIN m USING (utility)""")
def headlines_set_aside(spark, sf_dir) -> DataFrame:
    """Headline figures of consensus facts far from their utility's median, totals aside."""
    considered = (F.col("head") == "arr") & (F.col("voice") != "actual") & (F.col("utility") % 10 != 0)
    return sheets.set_aside(facts(spark, sf_dir), ["utility"], "value", considered).select("fact_id", "set_aside")
