"""Cells, slabs, labels and figures printed from the tables' own columns, and read back; the SQL goes by the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, labels
from ..operators import placing
from ..registry import query
from ..sources.catalog import table


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, row in enumerate(rows))


def _carried(spark, sf_dir, forms: list[str], name: str) -> DataFrame:
    """``p_partkey`` and the form that its number picks."""
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms)).cast("int")).alias(name))


_CELL_FIELDS = ("state", "value", "currency", "per_unit", "frequency", "percent", "percent_of", "sign", "reference", "marked", "secondary")
#: A line's figures in the dialects of both: price, quantity and percentage as printed.
_PRICE, _MANY, _SHARE = "cast(cast(l_extendedprice as decimal(18,2)) as varchar(30))", "cast(cast(l_quantity as int) as varchar(20))", "cast(cast(round(l_discount * 100) as int) as varchar(20))"


@query("cell_forms", f"""SELECT l_orderkey, l_linenumber,
  CASE l_linenumber WHEN 3 THEN CASE WHEN round(l_discount * 100) = 0 THEN 'zero' ELSE 'value' END WHEN 5 THEN CASE l_returnflag WHEN 'N' THEN 'zero' ELSE 'not_applicable' END WHEN 7 THEN 'cross_reference' ELSE 'value' END AS cell_state,
  CASE l_linenumber WHEN 1 THEN {_PRICE} WHEN 3 THEN {_SHARE} WHEN 4 THEN '-' || {_PRICE} WHEN 2 THEN {_MANY} WHEN 6 THEN {_MANY} END AS cell_value, CASE l_linenumber WHEN 1 THEN 'rupees' WHEN 2 THEN 'paise' END AS cell_currency,
  CASE l_linenumber WHEN 1 THEN 'kWh' WHEN 2 THEN 'unit' END AS cell_per_unit, NULL::VARCHAR AS cell_frequency, l_linenumber = 3 AS cell_percent, CASE WHEN l_linenumber = 3 THEN 'energy charge' END AS cell_percent_of,
  CASE WHEN l_linenumber = 3 THEN CASE WHEN l_tax > 0.04 THEN 1 ELSE -1 END END AS cell_sign, CASE WHEN l_linenumber = 7 THEN 'LMV-' || l_suppkey END AS cell_reference, l_linestatus = 'F' AS cell_marked, CASE WHEN l_linenumber = 6 THEN {_PRICE} END AS cell_secondary FROM lineitem""")
def cell_forms(spark, sf_dir) -> DataFrame:
    """Each line's figures printed as a cell of one of the ladder's forms, and read back."""
    printed = F.expr(f"""concat(case l_linenumber when 1 then concat('Rs. ', {_PRICE}, '/kWh') when 2 then concat({_MANY}, ' paise per unit') when 3 then concat(if(l_tax > 0.04, '(+) ', '-'), {_SHARE}, ' % of the energy charge') when 4 then concat('(', {_PRICE}, ')')
      when 5 then case l_returnflag when 'A' then 'N.A.' when 'N' then 'Nil' else '–' end when 6 then concat({_MANY}, ' (', {_PRICE}, ')') else concat('As applicable to LMV-', l_suppkey, '.') end, if(l_linestatus = 'F', ' *', ''))""")
    out = cells.normalise(table(spark, sf_dir, "lineitem").withColumn("printed", printed), "printed")
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"cell.{f}").alias(f"cell_{f}") for f in _CELL_FIELDS])


_SLAB_FIELDS = ("lower", "upper", "lower_in", "upper_in", "known", "kind", "unit", "reference")
_A, _B = "cast(cast(l_quantity as int) as varchar(20))", "cast(cast(l_quantity as int) + 10 * l_linenumber as varchar(20))"


@query("slab_forms", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (3, 4) THEN {_A} WHEN l_linenumber IN (5, 6) THEN {_B} WHEN l_linenumber = 2 THEN '0' WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN {_A} END AS slab_lower,
  CASE WHEN l_linenumber < 5 THEN {_B} WHEN l_linenumber = 7 AND l_returnflag <> 'N' THEN {_A} END AS slab_upper,
  CASE WHEN l_linenumber IN (2, 3, 6) THEN true WHEN l_linenumber IN (4, 5) OR l_linenumber = 7 AND l_returnflag <> 'A' THEN false END AS slab_lower_in, CASE WHEN l_linenumber < 5 OR l_linenumber = 7 AND l_returnflag <> 'N' THEN true END AS slab_upper_in,
  CASE WHEN l_linenumber IN (1, 6) OR l_linenumber = 7 AND l_returnflag <> 'R' THEN 'explicit' ELSE 'inferred' END AS slab_known,
  CASE WHEN l_linenumber = 2 THEN 'telescopic_first' WHEN l_linenumber IN (5, 6) OR l_linenumber = 7 AND l_returnflag = 'N' THEN 'open' WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'telescopic_next' ELSE 'absolute' END AS slab_kind,
  CASE l_linenumber WHEN 1 THEN 'kWh' WHEN 2 THEN 'unit' WHEN 3 THEN 'kVAh' WHEN 6 THEN 'HP' WHEN 7 THEN CASE WHEN l_returnflag = 'R' THEN 'unit' END END AS slab_unit, NULL::VARCHAR AS slab_reference FROM lineitem""")
def slab_forms(spark, sf_dir) -> DataFrame:
    """Each line's bounds printed as a slab label, and read back with inclusivity and how it is known."""
    printed = F.expr(f"""case l_linenumber when 1 then concat('Up to and including ', {_B}, ' kWh') when 2 then concat('First ', {_B}, ' units') when 3 then concat({_A}, '-', {_B}, ' kVAh') when 4 then concat('Above ', {_A}, ' - ', {_B}) when 5 then concat('Above ', {_B})
      when 6 then concat({_B}, ' HP and above') else case l_returnflag when 'A' then concat('<= ', {_A}) when 'N' then concat('> ', {_A}) else concat('Next ', {_A}, ' units') end end""")
    out = table(spark, sf_dir, "lineitem").withColumn("slab", cells.slab_bounds(printed))
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"slab.{f}").alias(f"slab_{f}") for f in _SLAB_FIELDS])


@query("slab_sequences", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER w = 1 OR l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'claimed twice' ELSE 'gap' END AS conflict FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
k AS (SELECT *, lead(conflict) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS after FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN conflict IS NOT NULL OR after IS NOT NULL THEN 'ambiguous' ELSE 'inferred' END AS known, conflict FROM k WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber))""")
def slab_sequences(spark, sf_dir) -> DataFrame:
    """The lines of an order as slabs of one schedule, each from the one before: neighbours that claim a bound twice or leave a gap. Orders with two lines of one number have no sequence."""
    lines = table(spark, sf_dir, "lineitem")
    once = lines.groupBy("l_orderkey").agg((F.count("*") == F.count_distinct("l_linenumber")).alias("once")).where("once").select("l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    upper = F.sum(10 + F.col("l_quantity").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = lines.join(once, "l_orderkey").withColumn("upper", upper).withColumn("before", F.lag("upper").over(w))
    label = F.expr("if(before is null, concat('up to ', upper), concat(before + case l_returnflag when 'A' then 0 when 'N' then 1 else 5 end, '-', upper))")
    return cells.adjacent(made.withColumn("slab", cells.slab_bounds(label)), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "known", "conflict")


@query("cost_heads", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'interest_wc' WHEN 'O' THEN 'interest_sd' ELSE 'interest_loan' END WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'P' THEN 'regulatory_asset' ELSE 'power_purchase' END
  WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'O' THEN 'other' ELSE 'roe' END WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'employee' WHEN 'O' THEN 'tax' ELSE 'bad_debts' END ELSE CASE o_orderstatus WHEN 'F' THEN 'net_arr' WHEN 'O' THEN 'gap' ELSE 'nti' END END AS head FROM orders""")
def cost_heads(spark, sf_dir) -> DataFrame:
    """The cost head of each order's label."""
    label = F.expr("""concat(case o_orderpriority when '1-URGENT' then 'Interest on ' when '2-HIGH' then 'Power purchase ' when '3-MEDIUM' then 'Return on ' when '4-NOT SPECIFIED' then 'Employee ' else 'Net ' end,
      case o_orderpriority when '1-URGENT' then case o_orderstatus when 'F' then 'working capital' when 'O' then 'consumer security deposit' else 'long-term loan' end when '2-HIGH' then case o_orderstatus when 'F' then 'cost' when 'O' then 'and wheeling' else 'true-up impact' end
      when '3-MEDIUM' then case o_orderstatus when 'F' then 'equity' when 'O' then 'filing' else 'capital employed' end when '4-NOT SPECIFIED' then case o_orderstatus when 'F' then 'cost' when 'O' then 'income tax' else 'bad debts' end
      else case o_orderstatus when 'F' then 'ARR' when 'O' then 'surplus' else 'other income' end end, ', ', o_orderkey)""")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.cost_head(label).alias("head"))


ALIASES = [("Power purchase cost", "C.PP", "INR_crore"), ("Power purchase", "C.PP", "INR_crore"), ("Hydro", "C.PP.HYDRO", "INR_crore"), ("Hydro", "E.PP.HYDRO", "MU"), ("O&M expenses", "C.OM", "INR_crore"), ("Employee expenses", "C.OM.EMP", "INR_crore"), ("Return on equity", "C.ROE", "INR_crore"), ("Equity", "C.EQ", "INR_crore"), ("ARR", "C.ARR", "INR_crore"), ("Sales", "E.SALES", "MU"), ("Total sales to consumers", "E.SALES", "MU")]
REFUSALS = [("C.EQ", "debt"), ("E.SALES", "revenue from")]
#: (label, unit): code, alias, how
PLACED = {
    ("1.2 Power Purchase Cost", None): ("C.PP", "power purchase cost", "exact"),
    ("Cost of power purchase including transmission", None): ("C.PP", "power purchase", "contains"),
    ("Hydro", "MU"): ("E.PP.HYDRO", "hydro", "exact"),
    ("Hydro", None): (None, None, None),
    ("Net O & M Expenses (Rs crore)", None): ("C.OM", "o and m expenses", "contains"),
    ("Allowed return on equity capital", None): ("C.ROE", "return on equity", "contains"),
    ("Debt to equity", None): (None, None, None),
    ("New equity", None): ("C.EQ", "equity", "contains"),
    ("Gross ARR", None): (None, None, None),
    ("ARR", "INR_crore"): ("C.ARR", "arr", "exact"),
    ("Revenue from sales", None): (None, None, None),
    ("Metered sales", "MU"): ("E.SALES", "sales", "contains"),
    ("Other matters net of sales", None): (None, None, None),
    ("", None): (None, None, None),
}


@query("placed_labels", f"SELECT p_partkey, code, alias, how FROM part JOIN (VALUES {_values(PLACED.values())}) v(i, code, alias, how) ON i = p_partkey % {len(PLACED)} WHERE code IS NOT NULL")
def placed_labels(spark, sf_dir) -> DataFrame:
    """Labels on codes of a taxonomy: exact aliases, aliases of several codes told apart by unit, contained aliases, refusals."""
    pick = lambda i: F.get(F.array(*[F.lit(k[i]).cast("string") for k in PLACED]), (F.col("p_partkey") % len(PLACED)).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick(0).alias("label"), pick(1).alias("unit"))
    out = placing.place_labels(rows, spark.createDataFrame(ALIASES, "alias string, code string, unit string"), spark.createDataFrame(REFUSALS, "code string, phrase string"))
    return out.withColumnRenamed("id", "p_partkey")


@query("printed_trace", """WITH c AS (SELECT DISTINCT (p_retailprice::DECIMAL(18,2) - 1000)::DECIMAL(18,2) AS v FROM part),
q AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN -1 ELSE 1 END * round(CASE WHEN l_linenumber = 3 THEN l_quantity::INTEGER ELSE ((l_partkey * 13) % 90000) / 100.0 END, 1)::DECIMAL(18,1) AS value, l_linenumber = 5 AS percent FROM lineitem),
g AS (SELECT * FROM q WHERE length(abs((value * 10)::BIGINT)::VARCHAR) >= 4),
f AS (SELECT l_orderkey, l_linenumber, value AS v, 1 AS p FROM g UNION ALL SELECT l_orderkey, l_linenumber, value / 100, 3 FROM g WHERE percent),
t AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN round(c.v * pow(10, p)::BIGINT, 0) = round(f.v::DECIMAL(18,4) * pow(10, p)::BIGINT, 0) THEN 1 WHEN abs(round(c.v * pow(10, p)::BIGINT, 0) - round(f.v::DECIMAL(18,4) * pow(10, p)::BIGINT, 0)) = 1 THEN 2 ELSE 3 END) AS rank
  FROM f JOIN c ON abs(round(c.v * pow(10, p)::BIGINT, 0) - round(f.v::DECIMAL(18,4) * pow(10, p)::BIGINT, 0)) <= 1 OR round(c.v * pow(10, p)::BIGINT, 0) = -round(f.v::DECIMAL(18,4) * pow(10, p)::BIGINT, 0) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN length(abs((value * 10)::BIGINT)::VARCHAR) < 4 THEN 'uninformative' WHEN rank = 1 THEN 'traced' WHEN rank = 2 THEN 'near' WHEN rank = 3 THEN 'opposite' ELSE 'untraced' END AS result FROM q LEFT JOIN t USING (l_orderkey, l_linenumber)""")
def printed_trace(spark, sf_dir) -> DataFrame:
    """Figures of one printed place among cells: equal, one unit off, of opposite sign, as a fraction, too short to tell, or not there."""
    there = table(spark, sf_dir, "part").select((F.col("p_retailprice").cast("decimal(18,2)") - 1000).cast("decimal(18,2)").alias("value"))
    value = F.expr("cast(case l_linenumber % 4 when 0 then -1 else 1 end * round(case when l_linenumber = 3 then cast(l_quantity as decimal(18,2)) else cast(l_partkey * 13 % 90000 as decimal(18,2)) / 100 end, 1) as decimal(18,1))")
    said = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), value.alias("value"), F.lit(1).alias("places"), (F.col("l_linenumber") == 5).alias("percent"))
    return placing.trace_printed(said, there).select("id.l_orderkey", "id.l_linenumber", "result")
