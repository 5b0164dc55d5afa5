"""Six ratios of suppliers' years with their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.benchmarks import Ratio, placed, ratios
from ..registry import query
from .identities import _PRINTED, _values

CRORE, MU = "INR_crore", "MU"
SIX = [
    Ratio("power_per_input", "power", CRORE, "input", MU, 10, 3),
    Ratio("om_per_sale", "om", CRORE, "sales", MU, 10, 3),
    Ratio("requirement_per_sale", "requirement", CRORE, "sales", MU, 10, 3),
    Ratio("loss", "loss", "percent"),
    Ratio("gap_share", "gap", CRORE, "requirement", CRORE, 100),
    Ratio("equity_share", "equity", CRORE, "total", CRORE, 100),
]
# Units as printed: some sales in kWh, some losses without a unit; one supplier in seventeen sells nothing in its second order.
_UNIT = "CASE WHEN line = 'sales' AND supplier % 10 = 6 THEN 'kWh' WHEN line IN ('sales', 'input') THEN 'MU' WHEN line = 'loss' THEN CASE WHEN supplier % 11 <> 5 THEN 'percent' END ELSE 'INR_crore' END"


def _sql() -> str:
    cases = []
    for m in SIX:
        wanted = [(m.top, m.top_unit)] + ([(m.bottom, m.bottom_unit)] if m.bottom else [])
        figure = {c: "CASE WHEN supplier % 17 = 8 THEN 0 ELSE sales END" if c == "sales" else c for c, _ in wanted}
        unit = {c: _UNIT.replace("line", f"'{c}'") for c, _ in wanted}
        missing = "concat_ws(', ', " + ", ".join(f"CASE WHEN {figure[c]} IS NULL THEN '{c}' END" for c, _ in wanted) + ")"
        other = "concat_ws(', ', " + ", ".join(f"CASE WHEN ({unit[c]}) IS DISTINCT FROM '{u}' THEN '{c} in ' || coalesce({unit[c]}, 'no unit') END" for c, u in wanted) + ")"
        value = f"({figure[m.top]})::DOUBLE" + (f" / nullif({figure[m.bottom]}, 0)::DOUBLE * {m.times}" if m.bottom else "")
        nought = f"WHEN ({figure[m.bottom]}) = 0 THEN '{m.bottom} is nought'" if m.bottom else ""
        cases.append(f"SELECT supplier, year, '{m.name}' AS ratio, round(({value})::DECIMAL(38,9), {m.places})::DECIMAL(28,4) AS v, CASE WHEN {missing} <> '' THEN 'not printed: ' || {missing} WHEN {other} <> '' THEN 'another unit: ' || {other} {nought} END AS reason FROM p")
    return f"WITH p AS ({_PRINTED}), r AS (SELECT supplier, year, ratio, CASE WHEN reason IS NULL THEN v END AS value, reason FROM ({' UNION ALL '.join(cases)}))"


@query("benchmark_ratios", f"""{_sql()}, s AS (SELECT year, ratio, count(value) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY ALL),
o AS (SELECT year, ratio, value, row_number() OVER (PARTITION BY year, ratio ORDER BY value) AS i, count(*) OVER (PARTITION BY year, ratio) AS m FROM r WHERE value IS NOT NULL), d AS (SELECT year, ratio, sum(value) * (CASE WHEN count(*) = 1 THEN 2 ELSE 1 END) AS twice FROM o WHERE i IN ((m + 1) // 2, m // 2 + 1) GROUP BY ALL)
SELECT supplier, r.year, r.ratio, value, reason, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY r.year, r.ratio ORDER BY value NULLS LAST) END AS place, n, low, high, (twice::DECIMAL(30,4) * 0.5::DECIMAL(3,1))::DECIMAL(34,5) AS middle FROM r JOIN s ON s.year = r.year AND s.ratio = r.ratio LEFT JOIN d ON d.year = r.year AND d.ratio = r.ratio""")
def benchmark_ratios(spark, sf_dir) -> DataFrame:
    """Six ratios of each supplier's year, with the reason where there is none, its place among the year's and the year's range."""
    facts = _values(spark, sf_dir).where("category is null").withColumn("unit", F.expr(_UNIT))
    later = facts.where("line = 'sales' and supplier % 17 = 8").withColumn("value", F.lit(0).cast("decimal(18,4)")).withColumn("ref", F.col("ref") + 100)
    out = placed(ratios(facts.unionByName(later), ["supplier", "year"], F.col("ref"), SIX), ["year", "ratio"], "value")
    middle = F.when(F.col("n") > 0, F.col("middle").cast("decimal(34,5)")).alias("middle")
    none = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)
    return out.select("supplier", "year", "ratio", "value", "reason", "place", "n", none("low"), none("high"), middle)
