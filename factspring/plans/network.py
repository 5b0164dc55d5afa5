"""Network charges of tables printed from orders' lines: matrices of levels, losses by level and year, tables of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.network import charges
from ..registry import query
from ..sources.catalog import table

# Each order is a table, each line a cell; what the table is follows from the order, its figures are the line's, in either dialect.
_CHARGE = "CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR(9))"
_LOSS = "concat(CAST(l_linenumber AS VARCHAR(9)), '.5')"
_AMOUNT = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(9))"
_ROW = "concat(CAST(11 * l_linenumber AS VARCHAR(9)), ' kV')"
_COL = "concat('At ', CAST(11 * (1 + l_partkey % 6) AS VARCHAR(9)), ' kV')"
_FY = "concat('FY ', CAST(2020 + l_partkey % 7 AS VARCHAR(9)), '-', CAST(21 + l_partkey % 7 AS VARCHAR(9)))"
KINDS = {  # form: header path, row path, the cell
    0: ("array('Wheeling drawal', {col})", "array('Injection', {row})", f"concat({_CHARGE}, ' (', {_LOSS}, '%)')"),
    1: ("array({fy}, 'Loss %')", "array({row})", _LOSS),
    2: ("array('Wheeling charges', 'Rs crore')", "array({row})", _AMOUNT),
    3: ("array('Additional surcharge (Rs/kWh)')", "array('All consumers')", _CHARGE),
    4: ("array('Meter rent')", "array('Each month')", _AMOUNT),
    5: ("array('Cross subsidy surcharge', 'Rs per unit')", "array({row}, {fy})", f"CASE WHEN l_linenumber = 2 THEN 'not fixed' ELSE {_CHARGE} END"),
}
_KEY = "l_orderkey, l_linenumber, l_partkey"
_NONE = "CAST(NULL AS VARCHAR(20))"
_SAID = {  # form: family, component, value, unit, injection, drawal, level, period
    0: [("wheeling_charge", "charge", _CHARGE, "INR_per_kWh", _ROW, _COL, _NONE, _NONE), ("oa_loss", "loss", _LOSS, "percent", _ROW, _COL, _NONE, _NONE)],
    1: [("oa_loss", "loss", _LOSS, "percent", _NONE, _NONE, _ROW, f"replace({_FY}, ' ', '')")],
    3: [("additional_surcharge", "charge", _CHARGE, "INR_per_kWh", _NONE, _NONE, _NONE, _NONE)],
    5: [("cross_subsidy_surcharge", "charge", f"CASE WHEN l_linenumber <> 2 THEN {_CHARGE} END", "INR_per_kWh", _NONE, _NONE, _ROW, f"replace({_FY}, ' ', '')")],
}


def _cells(spark, sf_dir) -> DataFrame:
    fill = {"row": _ROW, "col": _COL, "fy": _FY}
    part = lambda i: "CASE l_orderkey % 6 " + " ".join(f"WHEN {k} THEN {v[i].format(**fill)}" for k, v in KINDS.items()) + " END"
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.col("l_partkey").alias("col"), F.expr(part(0)).alias("headers"), F.expr(part(1)).alias("rows"), F.expr(part(2)).alias("raw"))


@query("network_charges", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {_KEY}, '{f}' AS family, '{c}' AS component, ({v})::DECIMAL(18,4) AS value, '{u}' AS unit, {i} AS injection, {d} AS drawal, {le} AS level, {p} AS period FROM lineitem WHERE l_orderkey % 6 = {k}" for k, facts in _SAID.items() for f, c, v, u, i, d, le, p in facts) + ") WHERE value IS NOT NULL")
def network_charges(spark, sf_dir) -> DataFrame:
    """Charges and losses of every table with their levels, injection and drawal of a matrix apart, bracketed second figures as losses."""
    facts, _ = charges(_cells(spark, sf_dir), ["l_orderkey"])
    return facts.withColumnsRenamed({"row": "l_linenumber", "col": "l_partkey"})


@query("network_refused", "SELECT DISTINCT l_orderkey, CASE l_orderkey % 6 WHEN 4 THEN 'no family known' ELSE 'wheeling_charge in a table of amounts' END AS reason FROM lineitem WHERE l_orderkey % 6 IN (2, 4)")
def network_refused(spark, sf_dir) -> DataFrame:
    """Tables that determine no charge, with the reason."""
    return charges(_cells(spark, sf_dir), ["l_orderkey"])[1]
