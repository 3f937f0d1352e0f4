"""The panel: series with a break-free history and an online part, and what is known of breaks.

from_table() turns any table with a series key and a total order into a panel
(id, time, value, period, step, target): period 1 is history, 2 is online; step
counts online points from 0. lineitem_panel() is the standing example, one
series a supplier, with a scale break put into every second series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_table(rows: DataFrame, id: str, order: list[str], value: str, history: float = 0.6) -> DataFrame:
    """(id, time, value, period, step, hist_len, onl_len); points that are not finite are left out first."""
    finite = F.col(value).cast("double")
    rows = rows.select(F.col(id).alias("id"), *(F.col(c).alias(f"o_{c}") for c in order), finite.alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    by = Window.partitionBy("id").orderBy(*(f"o_{c}" for c in order))
    n = F.count("*").over(Window.partitionBy("id"))
    hist = F.floor(n * int(history * 10) / 10.0)
    timed = rows.select("id", (F.row_number().over(by) - 1).cast("long").alias("time"), "value", hist.alias("hist_len"), (n - hist).alias("onl_len"))
    return timed.withColumn("period", F.when(F.col("time") < F.col("hist_len"), 1).otherwise(2)).withColumn("step", F.col("time") - F.col("hist_len"))


def with_breaks(panel: DataFrame, broken: Column, tau: Column, factor: float = 1.5) -> DataFrame:
    """A panel with target, 1 from step tau on in broken series, and its values scaled there."""
    target = F.when(broken & (F.col("period") == 2) & (F.col("step") >= tau), 1).otherwise(0)
    return panel.withColumn("target", target).withColumn("value", F.when(F.col("target") == 1, F.col("value") * factor).otherwise(F.col("value")))


def lineitem_panel(spark: SparkSession, sf_dir: str, value: str = "l_quantity", suppliers: int = 1) -> DataFrame:
    """suppliers: how many neighbouring ones are one series."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if suppliers > 1:
        rows = rows.withColumn("l_suppkey", F.floor(F.col("l_suppkey") / suppliers))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    panel = from_table(rows, "l_suppkey", order, value)
    return with_breaks(panel, F.col("id") % 2 == 0, F.col("id") * 37 % F.col("onl_len"))


PANEL_SQL = """
numbered AS (
  SELECT l_suppkey AS id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS time,
         CAST(l_quantity AS DOUBLE) AS raw,
         CAST(floor(count(*) OVER (PARTITION BY l_suppkey) * 6 / CAST(10 AS DOUBLE)) AS BIGINT) AS hist_len,
         count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem),
placed AS (SELECT *, n - hist_len AS onl_len, time - hist_len AS step, CASE WHEN time < hist_len THEN 1 ELSE 2 END AS period FROM numbered),
marked AS (SELECT *, CASE WHEN id % 2 = 0 AND period = 2 AND step >= (id * 37) % onl_len THEN 1 ELSE 0 END AS target FROM placed),
panel AS (SELECT id, time, CASE WHEN target = 1 THEN raw * CAST(1.5 AS DOUBLE) ELSE raw END AS value, hist_len, onl_len, period, step, target FROM marked)
"""


def long_panel_sql(suppliers: int) -> str:
    """The panel of so many suppliers a series."""
    return PANEL_SQL.replace("FROM lineitem)", f"FROM (SELECT * REPLACE (l_suppkey // {suppliers} AS l_suppkey) FROM lineitem))")


def online(panel: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """The online rows, each with its series' fitted values."""
    rows = panel.where("period = 2")
    return rows if fits is None else rows.join(fits, "id")
