"""Titles, headers and headings printed from the tables' own columns, and read back; the SQL goes by the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles
from ..registry import query
from ..sources.catalog import table

_FY = "concat('FY ', year(o_orderdate) + 20, '-', lpad(cast((year(o_orderdate) + 21) % 100 as string), 2, '0'))"


@query("section_classes", """SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 're_portfolio' WHEN '3-MEDIUM' THEN 'wheeling' WHEN '4-NOT SPECIFIED' THEN NULL ELSE CASE WHEN o_orderstatus = 'O' THEN 'tariff_schedule' ELSE 'power_purchase' END END AS section FROM orders""")
def section_classes(spark, sf_dir) -> DataFrame:
    """The section of each order's table by its title (F49): charges of stations or in crore are bought power."""
    title = F.expr(f"""concat(case o_orderpriority when '1-URGENT' then 'Energy charges of ' when '2-HIGH' then 'Solar purchase from ' when '3-MEDIUM' then 'Wheeling charges of ' when '4-NOT SPECIFIED' then 'Depreciation of ' else 'Tariff for LT consumers of ' end,
      case o_orderstatus when 'F' then 'allocated stations' when 'O' then 'domestic users' else 'the licensee (Rs. Cr)' end, ', ', {_FY})""")
    return table(spark, sf_dir, "orders").select("o_orderkey", titles.section_class(title).alias("section"))


@query("document_kinds", """WITH t AS (SELECT o_orderkey, coalesce(o_orderstatus = 'P', false) AS corrected, concat(quarter(o_orderdate), left(o_orderpriority, 1)) AS form FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL),
k AS (SELECT o_orderkey, corrected, form, CASE WHEN form IN ('11', '15', '22', '41', '45') THEN 'tariff_order' WHEN form IN ('12', '42') THEN 'arr_true_up_order' WHEN form IN ('21', '35') THEN 'myt_order' WHEN form = '13' THEN 'myt_petition'
    WHEN form = '33' THEN 'arr_petition' WHEN form = '23' THEN 'regulation' WHEN form = '24' THEN 'regulation_amendment' WHEN form = '25' THEN 'mid_term_review' END AS kind,
  CASE WHEN form IN ('14', '43') THEN 'goes with an order' WHEN form = '31' THEN 'a step of the procedure' WHEN form = '32' THEN 'reviews an order' WHEN form = '34' THEN 'an order on something else' WHEN form IN ('15', '35', '42') THEN 'by its subject alone' END AS note FROM t)
SELECT o.o_orderkey, CASE WHEN corrected AND form NOT IN ('21', '22') THEN NULL ELSE kind END AS kind,
  CASE WHEN corrected AND form IN ('21', '22') THEN 'with its corrigendum' WHEN corrected AND form NOT IN ('14', '43', '31') THEN 'corrects an order' ELSE note END AS note FROM orders o LEFT JOIN k USING (o_orderkey)""")
def document_kinds(spark, sf_dir) -> DataFrame:
    """The kind that each order's listed title names, with its note: every kind and note there is."""
    title = F.expr(f"""concat(case concat(quarter(o_orderdate), left(o_orderpriority, 1))
        when '11' then 'Tariff Order for ' when '12' then 'Order on True-up of ' when '13' then 'MYT petition up to ' when '14' then 'Press note on the tariff of ' when '15' then 'ARR of '
        when '21' then 'MYT Order for the control period up to ' when '22' then 'Order of the control period on ARR and Tariff for ' when '23' then 'Terms of Tariff Regulations up to ' when '24' then 'Tariff Regulations (First Amendment) of ' when '25' then 'Mid-term review of the business plan for '
        when '31' then 'Interim order on ARR of ' when '32' then 'Review petition against the tariff order of ' when '33' then 'Petition for annual performance review of ' when '34' then 'Order on safety in ' when '35' then 'Business plan and ARR up to '
        when '41' then 'Approval of retail supply tariff of ' when '42' then 'Truing up of ' when '43' then 'Salient features of the order of ' when '44' then 'Annual report of ' when '45' then 'Order on Truing up and tariff of ' end, {_FY},
      case o_orderstatus when 'O' then ', with annexures' when 'P' then case when quarter(o_orderdate) = 2 and left(o_orderpriority, 1) in ('1', '2') then ' (order with corrigendum)' else ' (Corrigendum)' end else '' end)""")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.transform(F.array(title), titles.document_kind)))


@query("unit_hints", """WITH h AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'rupees' WHEN 'N' THEN 'paise' END AS currency,
  CASE floor(l_quantity)::INTEGER % 12 WHEN 0 THEN 'kWh' WHEN 1 THEN 'kVA' WHEN 2 THEN 'kVAh' WHEN 3 THEN 'kVArh' WHEN 4 THEN 'kW' WHEN 5 THEN 'BHP' WHEN 6 THEN 'HP' WHEN 7 THEN 'unit' WHEN 8 THEN 'connection' WHEN 9 THEN 'bill' WHEN 10 THEN 'unit' END AS unit,
  CASE month(l_shipdate) % 7 WHEN 0 THEN 'per_month' WHEN 1 THEN 'per_month' WHEN 2 THEN 'per_annum' WHEN 3 THEN 'per_annum' WHEN 4 THEN 'per_day' WHEN 5 THEN 'per_bill' END AS time, coalesce(l_tax > 0.05, false) AS percent FROM lineitem)
SELECT l_orderkey, l_linenumber, currency, CASE WHEN unit IS NULL AND time = 'per_bill' THEN 'bill' ELSE unit END AS per_unit, CASE WHEN unit = 'bill' THEN 'per_bill' ELSE time END AS frequency, percent FROM h""")
def unit_hints(spark, sf_dir) -> DataFrame:
    """What the header of each line's column says of units: every currency, unit and time that headers know."""
    header = F.expr("""concat(case l_returnflag when 'A' then case l_linenumber % 4 when 0 then 'Rupees' when 1 then 'INR' when 2 then '₹' else 'Rs.' end
        when 'N' then case l_linenumber % 4 when 0 then 'Paisa' when 1 then 'Ps.' when 2 then 'Charge (p)' else 'Paise' end else 'Charge' end,
      case int(floor(l_quantity)) % 12 when 0 then ' per kWh' when 1 then '/kVA' when 2 then ' in kVAh' when 3 then '/kVArh' when 4 then ' per kW' when 5 then ' per BHP' when 6 then ' in HP' when 7 then ' per unit' when 8 then '/connection' when 9 then ' per bill' when 10 then ' in units' else '' end,
      case month(l_shipdate) % 7 when 0 then ' per month' when 1 then '/month' when 2 then ' per annum' when 3 then ' per year' when 4 then ' per day' when 5 then ' per bill' else '' end,
      ' of line ', coalesce(cast(l_partkey as string), ''), case when l_tax > 0.06 then ' (%)' when l_tax > 0.05 then ' (percentage)' else '' end)""")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.transform(F.array(header), titles.unit_hint)))


@query("header_components", """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linenumber IN (4, 6) THEN 'tod_adjustment' WHEN l_linenumber = 5 THEN 'minimum' WHEN l_linenumber = 2 THEN 'demand' WHEN l_linenumber = 1 THEN 'fixed'
  WHEN l_linenumber = 3 OR l_returnflag = 'N' THEN 'energy' WHEN l_returnflag = 'R' THEN 'rebate' WHEN l_linenumber = 6 THEN 'surcharge' ELSE 'charge' END AS component FROM lineitem)
SELECT *, CASE WHEN component = 'tod_adjustment' THEN 'energy charge' END AS percent_of FROM c""")
def header_components(spark, sf_dir) -> DataFrame:
    """The component of each line by the words of its header and row."""
    header = F.expr("case l_linenumber when 1 then 'Fixed Charge' when 2 then 'Demand Charge' when 3 then 'Energy Charge' when 4 then 'Rate %' when 5 then 'Minimum charge' when 6 then 'Surcharge %' else 'Rate' end")
    row = F.expr("case l_returnflag when 'A' then concat('LMV-', l_suppkey) when 'N' then concat('Energy in block ', l_partkey) else concat('Rebate of ', l_discount) end")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", titles.component(header, row).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("years_named", """WITH y AS (SELECT o_orderkey, o_orderstatus AS s, year(o_orderdate) + 20 AS y FROM orders)
SELECT o_orderkey, concat('FY', y, '-', lpad(((y + 1) % 100)::VARCHAR, 2, '0'), CASE s WHEN 'F' THEN concat(' FY', y - 1, '-', lpad((y % 100)::VARCHAR, 2, '0')) WHEN 'O' THEN concat(' FY', y + 1, '-', lpad(((y + 2) % 100)::VARCHAR, 2, '0')) ELSE '' END) AS years FROM y""")
def years_named(spark, sf_dir) -> DataFrame:
    """The fiscal years that each order's header names: in full, by their end, as a range; two that are no neighbours are none."""
    y = "(year(o_orderdate) + 20)"
    header = F.expr(f"concat('ARR for ', {_FY}, case o_orderstatus when 'F' then concat(' and FY', lpad(cast({y} % 100 as string), 2, '0')) when 'O' then concat(' to ', {y} + 1, '/', {y} + 2) else concat(', as in ', {y}, '-', lpad(cast(({y} + 2) % 100 as string), 2, '0')) end)")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", titles.years_named(header)).alias("years"))


@query("chapter_headings")
def chapter_headings(spark, sf_dir) -> DataFrame:
    """Whether each line of each document opens a chapter, every other line with a number before it (F64)."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    numbered = lines.withColumn("line", F.when(F.col("line_no") % 2 == 0, F.concat(F.floor(F.col("line_no") / 2) + 1, F.lit(". "), "line")).otherwise(F.col("line")))
    return titles.chapters(numbered, "line").select("doc_id", "line_no", "opens")


@query("amended_texts", "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9%.:]+', ' ', 'g')) AS plain FROM benchmark")
def amended_texts(spark, sf_dir) -> DataFrame:
    """Texts as they are compared with their amendments."""
    return table(spark, sf_dir, "benchmark").select("item_id", titles.amended(F.col("text")).alias("plain"))


@query("json_lengths", "SELECT event_id, json_array_length('[' || repeat('1,', (event_id % 4)::INTEGER) || props || ']')::INTEGER AS n FROM events")
def json_lengths(spark, sf_dir) -> DataFrame:
    """Lengths of arrays in JSON."""
    arrays = F.concat(F.lit("["), F.expr("repeat('1,', int(event_id % 4))"), "props", F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", F.json_array_length(arrays).alias("n"))
