"""Running totals over groups of any size: no task holds a group.

A window function gives a group to one task. Here rows are dealt by ranges of
(group, order), each range adds up its own rows, and what lies before a range is
added back. Only the first group of a range can have begun before it, so what is
added back has a row for each range at most, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import table


def running(df: DataFrame, by: list[str], order: list[Column], of: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with a column for each name in `of`: the sum of its expression over the rows before this one in the group.

    Rows that tie in `order` stand in any order, the same one for all sums. Null
    groups are groups. The dealt rows are a table in the shared folder, as the
    sums and the rows must see the same ranges. ranges: how many, by default
    spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("run_tie", F.monotonically_increasing_id())  # so that a range may end among rows that tie
    dealt = table(tied.repartitionByRange(ranges, *by, *order, "run_tie").withColumn("run_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "run_part").agg(*(F.sum(e).alias(n) for n, e in of.items()))
    earlier = Window.partitionBy(*by).orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*(F.col(b).alias(f"run_{i}") for i, b in enumerate(by)), F.col("run_part").alias("run_at"), *(F.sum(n).over(earlier).alias(f"run_b_{n}") for n in of), F.count("*").over(earlier).alias("run_n")).where("run_n > 0").drop("run_n")
    within = Window.partitionBy(*by, "run_part").orderBy(*order, "run_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumns({f"run_s_{n}": F.sum(e).over(within) for n, e in of.items()})
    same = F.col("run_part") == F.col("run_at")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"run_{i}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.join(F.broadcast(begun), same, "left").withColumns({n: zero(f"run_b_{n}") + zero(f"run_s_{n}") for n in of})
    return out.select(*df.columns, *of)
