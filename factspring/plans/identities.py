"""Seven identities over the figures of suppliers' years, and the figures that failed ones mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..quality.identities import Identity, Line, Term, Tolerance, Way, checked, tagged
from ..registry import query
from ..sources.catalog import table

TREE = [
    Line("total"),
    Line("power", "costs"),
    Line("power_fixed", "power", splits=True),
    Line("power_variable", "power", splits=True),
    Line("surplus", "power", splits=True),
    Line("wires", "costs"),
    Line("om", "costs"),
    Line("staff", "om"),
    Line("repairs", "om"),
    Line("recovered", "om", -1),
    Line("equity", "costs"),
    Line("other_income"),
    Line("requirement"),
    Line("revenue"),
    Line("subsidy"),
    Line("gap"),
    Line("sales"),
    Line("interstate"),
    Line("loss"),
    Line("input"),
    Line("unit_cost"),
]
CRORE, MU, RATE = "INR_crore", "MU", "INR_per_kWh"
some = lambda *codes: tuple(Term(c, needed=False) for c in codes)
SEVEN = [
    Identity("total", "total", CRORE, (
        Way("the sum of the parts", some("power", "wires", "om", "equity"), parts=2, where="inside is null or power is null"),
        Way("the sum of the parts, wires inside power", some("power", "om", "equity"), parts=2, where="inside = 'wires' and power is not null"),
    ), (Way("power holds the wires", (Term("power"), *some("om", "equity")), where="inside is null and wires <> 0"),)),
    Identity("requirement", "requirement", CRORE, (Way("the total less other income", (Term("total"), Term("other_income", -1, False))),)),
    Identity("gap", "gap", CRORE, (
        Way("requirement less revenue", (Term("requirement"), Term("revenue", -1)), where="subsidy is null or coalesce(subsidised, 'before') = 'before'"),
        Way("requirement less revenue and subsidy", (Term("requirement"), Term("revenue", -1), Term("subsidy", -1)), where="coalesce(subsidised, 'after') = 'after'"),
    )),
    Identity("input", "input", MU, (
        Way("sales grossed up", (Term("sales"),), (Term("loss", -1),), 100, 100, "coalesce(lost_on, '') <> 'within' or interstate is null"),
        Way("sales within the state grossed up", (Term("sales"), Term("interstate", -1)), (Term("loss", -1),), 100, 100, "lost_on = 'within'"),
    ), (Way("the loss is of sales within the state", (Term("sales"), Term("interstate", -1)), (Term("loss", -1),), 100, 100, "lost_on is null and interstate <> 0"),)),
    Identity("unit_cost", "unit_cost", RATE, (Way("requirement over sales", (Term("requirement"),), (Term("sales"),), 10),), severity="warning"),
    Identity("power", "power", CRORE, (Way("fixed and variable less surplus", (Term("power_fixed"), Term("power_variable"), Term("surplus", -1, False))),)),
    Identity("sales", "sales", MU, (Way("the categories", (Term("sales/each"),)),)),
]
ROOM = Tolerance({CRORE: "0.05", MU: "0.5", RATE: "0.01"}, "0.0001")
GROUP = ["supplier", "year"]

# What is printed, in either dialect: parts by line number, some lines missing, some figures off, some by another convention.
_PARTS = ", ".join(f"sum(CASE WHEN l_linenumber = {i} THEN p END) AS {c}" for i, c in enumerate(("power_fixed", "power_variable", "wires", "staff", "repairs", "equity", "surplus"), 1))
_WIDE = f"""SELECT l_suppkey AS supplier, y AS year, {_PARTS}, {', '.join(f"sum(CASE WHEN l_returnflag = '{f}' THEN q END) AS sold_{f.lower()}" for f in 'ANR')},
  sum(CASE WHEN l_linestatus = 'F' THEN q END) AS interstate, sum(CASE WHEN l_returnflag = 'R' THEN p END) AS revenue, sum(CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN p END) AS subsidy, sum(q) AS sold
  FROM (SELECT *, year(l_shipdate) AS y, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem) x GROUP BY l_suppkey, y"""
_ZERO = lambda *cs: " + ".join(f"coalesce({c}, 0)" for c in cs)
_STEPS = [
    f"CAST({_ZERO('power_fixed', 'power_variable')} - coalesce(surplus, 0) + CASE WHEN supplier % 7 = 3 THEN 5000 ELSE 0 END AS DECIMAL(18,4)) AS power, CAST(CASE WHEN year % 2 = 0 THEN {_ZERO('staff', 'repairs')} END AS DECIMAL(18,4)) AS om, CAST(sold + CASE WHEN supplier % 9 = 4 THEN 20 ELSE 0 END AS DECIMAL(18,4)) AS sales, CAST(year % 12 + 6 AS DECIMAL(18,4)) AS loss",
    f"CAST(power + {_ZERO('staff', 'repairs', 'equity')} + CASE WHEN supplier % 4 <> 1 THEN coalesce(wires, 0) ELSE 0 END + CASE WHEN supplier % 13 = 6 THEN 9000 ELSE 0 END AS DECIMAL(18,4)) AS total, CAST(CASE WHEN supplier % 5 <> 0 THEN coalesce(equity, 0) / 8 END AS DECIMAL(18,4)) AS other_income, CAST(round(CAST(CAST(sold - CASE WHEN supplier % 6 < 2 THEN coalesce(interstate, 0) ELSE 0 END AS DOUBLE) / (1 - CAST(loss AS DOUBLE) / 100) AS DECIMAL(38,9)), 2) AS DECIMAL(18,4)) AS input",
    "CAST(total - coalesce(other_income, 0) AS DECIMAL(18,4)) AS requirement",
    "CAST(requirement - coalesce(revenue, 0) - CASE WHEN supplier % 2 = 0 THEN coalesce(subsidy, 0) ELSE 0 END AS DECIMAL(18,4)) AS gap, CAST(round(CAST(CAST(requirement AS DOUBLE) / CAST(sold AS DOUBLE) * 10 AS DECIMAL(38,9)), 2) AS DECIMAL(18,4)) AS unit_cost",
]
_PRINTED = _WIDE
for step in _STEPS:
    _PRINTED = f"SELECT *, {step} FROM ({_PRINTED}) s"
_CONVENTIONS = """SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 8 = 1 THEN 'wires' END AS inside, CASE s_suppkey % 4 WHEN 0 THEN 'after' WHEN 2 THEN 'before' END AS subsidised, CASE WHEN s_suppkey % 6 = 1 THEN 'within' END AS lost_on FROM supplier"""


def _values(spark, sf_dir) -> DataFrame:
    """The printed figures one by one, each with its place as ``ref``; sales by category too."""
    wide = spark.sql(_PRINTED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    lines = [line.code for line in TREE if line.code not in ("recovered",)]
    cells = [F.struct(F.lit(c).alias("line"), F.lit(None).cast("string").alias("category"), F.col(c).cast("decimal(18,4)").alias("value")) for c in lines]
    cells += [F.struct(F.lit("sales").alias("line"), F.lit(f).alias("category"), F.col(f"sold_{f.lower()}").cast("decimal(18,4)").alias("value")) for f in "ANR"]
    rows = wide.select(*GROUP, F.posexplode(F.array(*cells)).alias("ref", "c"))
    return rows.select(*GROUP, "ref", "c.line", "c.category", "c.value").where("value is not null")


def _checks(spark, sf_dir, values: DataFrame) -> DataFrame:
    conventions = spark.sql(_CONVENTIONS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return checked(values, GROUP, TREE, SEVEN, ROOM, conventions, ["supplier"])


def _sql_checks() -> str:
    """Each identity said once more by hand, in SQL, with its ways as columns ``a`` and ``b`` (whichever is open) and a hint."""
    om = f"coalesce(om, {_ZERO('staff', 'repairs')})"
    om_is = "(om IS NOT NULL OR staff IS NOT NULL OR repairs IS NOT NULL)"
    parts = lambda wires: f"(coalesce(power, 0) + {om} + coalesce(equity, 0){' + coalesce(wires, 0)' if wires else ''})"
    ratio = lambda top, bottom: f"round((({top})::DOUBLE / ({bottom})::DOUBLE)::DECIMAL(38,9), 4)"
    om_lines = "CASE WHEN om IS NOT NULL THEN ['om'] ELSE CASE WHEN staff IS NOT NULL THEN ['staff'] ELSE [] END || CASE WHEN repairs IS NOT NULL THEN ['repairs'] ELSE [] END END"
    has = lambda c: f"CASE WHEN {c} IS NOT NULL THEN ['{c}'] ELSE [] END"
    all_parts = f"['total'] || {has('power')} || {om_lines} || {has('equity')}"
    count = f"(power IS NOT NULL)::INT + {om_is}::INT + (equity IS NOT NULL)::INT"
    none = "NULL::DECIMAL(20,4)"
    gross, within = ratio("sales * 100", "100 - loss"), ratio("(sales - interstate) * 100", "100 - loss")
    rows = [
        ("total", "blocking", "total", "0.05", f"CASE WHEN inside IS NULL AND {count} + (wires IS NOT NULL)::INT >= 2 THEN {parts(True)} END", "the sum of the parts", f"{all_parts} || {has('wires')}", f"CASE WHEN inside = 'wires' AND {count} >= 2 THEN {parts(False)} END", "the sum of the parts, wires inside power", all_parts, f"CASE WHEN inside IS NULL AND wires <> 0 THEN {parts(False)} END", "power holds the wires"),
        ("requirement", "blocking", "requirement", "0.05", "total - coalesce(other_income, 0)", "the total less other income", f"['requirement', 'total'] || {has('other_income')}", none, "", "[]", none, ""),
        ("gap", "blocking", "gap", "0.05", "CASE WHEN subsidy IS NULL OR coalesce(subsidised, 'before') = 'before' THEN requirement - revenue END", "requirement less revenue", "['gap', 'requirement', 'revenue']", "CASE WHEN coalesce(subsidised, 'after') = 'after' THEN requirement - revenue - subsidy END", "requirement less revenue and subsidy", "['gap', 'requirement', 'revenue', 'subsidy']", none, ""),
        ("input", "blocking", "input", "0.5", f"CASE WHEN lost_on IS NULL OR interstate IS NULL THEN {gross} END", "sales grossed up", "['input', 'loss', 'sales']", f"CASE WHEN lost_on = 'within' THEN {within} END", "sales within the state grossed up", "['input', 'interstate', 'loss', 'sales']", f"CASE WHEN lost_on IS NULL AND interstate <> 0 THEN {within} END", "the loss is of sales within the state"),
        ("unit_cost", "warning", "unit_cost", "0.01", ratio("requirement * 10", "sales"), "requirement over sales", "['requirement', 'sales', 'unit_cost']", none, "", "[]", none, ""),
        ("power", "blocking", "power", "0.05", "power_fixed + power_variable - coalesce(surplus, 0)", "fixed and variable less surplus", f"['power', 'power_fixed', 'power_variable'] || {has('surplus')}", none, "", "[]", none, ""),
        ("sales", "blocking", "sales", "0.5", "CASE WHEN sold_a IS NOT NULL OR sold_n IS NOT NULL OR sold_r IS NOT NULL THEN coalesce(sold_a, 0) + coalesce(sold_n, 0) + coalesce(sold_r, 0) END", "the categories", "['sales', 'sales/each']", none, "", "[]", none, ""),
    ]
    each = " UNION ALL ".join(
        f"SELECT supplier, year, '{n}' AS identity, '{s}' AS severity, {p}::DECIMAL(20,4) AS printed, {room}::DECIMAL(20,4) AS room, ({a})::DECIMAL(20,4) AS a, '{wa}' AS wa, ({la})::VARCHAR[] AS la, ({b})::DECIMAL(20,4) AS b, '{wb}' AS wb, ({lb})::VARCHAR[] AS lb, ({h})::DECIMAL(20,4) AS h, '{wh}' AS wh FROM p"
        for n, s, p, room, a, wa, la, b, wb, lb, h, wh in rows
    )
    near = lambda x: f"coalesce(abs(printed - {x}) <= greatest(room, 0.0001 * abs({x})), false)"
    return f"""p AS (SELECT * FROM ({_PRINTED}) LEFT JOIN ({_CONVENTIONS}) USING (supplier)), e AS ({each}),
j AS (SELECT *, {near('a')} AS na, {near('b')} AS nb, {near('h')} AS nh FROM e WHERE printed IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)),
k AS (SELECT *, na OR nb AS holds, CASE WHEN na OR (a IS NOT NULL AND NOT nb) THEN 1 ELSE 2 END AS way FROM j),
c AS (SELECT supplier, year, identity, severity, holds, printed, CASE way WHEN 1 THEN a ELSE b END AS expected, CASE way WHEN 1 THEN wa ELSE wb END AS what, CASE WHEN NOT holds AND nh THEN wh END AS hint, list_sort(CASE way WHEN 1 THEN la ELSE lb END) AS lines FROM k)"""


@query("identity_checks", f"WITH {_sql_checks()} SELECT supplier, year, identity, severity, holds, printed, expected, printed - expected AS difference, what, hint, array_to_string(lines, ' ') AS lines FROM c")
def identity_checks(spark, sf_dir) -> DataFrame:
    """Seven identities of each supplier's year with tolerances by unit, stated conventions and hints (E10, F27): one aggregation, no division before a decision."""
    out = _checks(spark, sf_dir, _values(spark, sf_dir))
    return out.withColumn("lines", F.concat_ws(" ", "lines")).withColumn("printed", F.col("printed").cast("decimal(20,4)"))


@query("identity_tags", f"""WITH {_sql_checks()}, f AS (SELECT supplier, year, severity, unnest(lines) AS l FROM c WHERE NOT holds), g AS (SELECT supplier, year, l, count(*) AS findings, count(*) FILTER (severity = 'blocking') AS blocking FROM f GROUP BY ALL),
v AS ({' UNION ALL '.join([f"SELECT supplier, year, '{x.code}' AS line, NULL AS category, {x.code}::DECIMAL(18,4) AS value FROM p" for x in TREE if x.code != "recovered"] + [f"SELECT supplier, year, 'sales', '{f}', sold_{f.lower()}::DECIMAL(18,4) FROM p" for f in "ANR"])})
SELECT v.supplier, v.year, line, category, coalesce(findings, 0) AS findings, coalesce(blocking, 0) AS blocking, CASE WHEN blocking > 0 THEN 'identity_failure' END AS tag FROM v LEFT JOIN g ON g.supplier = v.supplier AND g.year = v.year AND l = CASE WHEN category IS NULL THEN line ELSE line || '/each' END WHERE value IS NOT NULL""")
def identity_tags(spark, sf_dir) -> DataFrame:
    """Every figure with the failed identities that took it, and a tag where one of them blocks."""
    values = _values(spark, sf_dir)
    return tagged(values, GROUP, _checks(spark, sf_dir, values)).drop("ref")
