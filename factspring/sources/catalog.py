"""The driver's tables, and the fact model read off them.

An order is a decision that states one figure: its customer stands for the utility, the customer's nation for the
commission, the nation's region for the state, the order's date for the fiscal year (from April), its priority for the
voice and its status for the cost head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOICES = {"1-URGENT": "approved", "2-HIGH": "claimed", "3-MEDIUM": "approved_earlier", "4-NOT SPECIFIED": "actual", "5-LOW": "approved"}
HEADS = {"O": "arr", "F": "power_purchase", "P": "om"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_of(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def fiscal_year_sql(year: str) -> str:
    """``FYyyyy-yy`` of the year that it starts in, in either dialect."""
    return f"concat('FY', cast({year} as varchar(4)), '-', lpad(cast(({year} + 1) % 100 as varchar(2)), 2, '0'))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fact_id, order_id, utility, commission, state, fy_start, fiscal_year, voice, head, label, value, order_year``.

    The dimensions are joined without a hint: their size decides how.
    """
    orders = table(spark, sf_dir, "orders").withColumn("fy_start", F.expr("year(add_months(o_orderdate, -3))"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("fact_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("utility"),
        F.col("c_nationkey").alias("commission"),
        F.col("n_regionkey").alias("state"),
        "fy_start",
        F.expr("concat('FY', fy_start, '-', lpad((fy_start + 1) % 100, 2, '0'))").alias("fiscal_year"),
        F.expr(case_of("o_orderpriority", VOICES)).alias("voice"),
        F.expr(case_of("o_orderstatus", HEADS)).alias("head"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
        F.year("o_orderdate").alias("order_year"),
    )


FACTS_SQL = f"""facts AS (SELECT o_orderkey AS fact_id, o_orderkey AS order_id, o_custkey AS utility, c_nationkey AS commission, n_regionkey AS state, fy_start,
  'FY' || fy_start || '-' || lpad(((fy_start + 1) % 100)::VARCHAR, 2, '0') AS fiscal_year, {case_of("o_orderpriority", VOICES)} AS voice, {case_of("o_orderstatus", HEADS)} AS head,
  o_orderpriority AS label, o_totalprice::DECIMAL(18,2) AS value, year(o_orderdate)::INTEGER AS order_year
  FROM (SELECT *, year(o_orderdate - INTERVAL 3 MONTH)::INTEGER AS fy_start FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
