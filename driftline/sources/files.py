"""Reading and writing panels as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import shared_folder

PANEL = "id LONG, time INT, value DOUBLE, period INT"


def read_panel(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(id, time, value, period) with its schema given, never inferred."""
    reader = spark.read.schema(PANEL)
    return reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)


def write_panel(panel: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a panel so that a series lies in one file, in order of time."""
    rows = panel.select("id", F.col("time").cast("int").alias("time"), "value", F.col("period").cast("int").alias("period"))
    dealt = rows.repartition("id").sortWithinPartitions("id", "time")
    writer = dealt.write.mode("errorifexists")
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)


def shifted_edition(rows: DataFrame, lead: int = 0) -> DataFrame:
    """A panel from the edition that marks history with 0 and the rest with 1; lead points before the border go online too."""
    border = rows.where("period = 0").groupBy("id").agg((F.max("time") + 1 - lead).alias("border"))
    return rows.join(border, "id").withColumn("period", F.when(F.col("time") < F.col("border"), 1).otherwise(2)).withColumn("step", F.col("time") - F.col("border")).drop("border")


def through(panel: DataFrame, format: str) -> DataFrame:
    """A panel written to the shared folder and read again."""
    at = f"{shared_folder(panel.sparkSession)}/panel-{uuid.uuid4().hex}"
    write_panel(panel, at, format)
    return read_panel(panel.sparkSession, at, format)
