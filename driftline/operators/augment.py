"""More series out of those there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def boundary_cuts(panel: DataFrame, cuts: int = 3, least: int = 60, margin: int = 20) -> DataFrame:
    """Pseudo-series whose history reaches further: (id, cut, time, value, period, step, target).

    Each series with an online part of at least so many points gives cuts, drawn
    from its id, before its break; points before a cut become history.
    """
    limit = F.least(F.coalesce(F.col("tau"), F.col("onl_len")), F.col("onl_len") - margin)
    meta = panel.where("period = 2").groupBy("id").agg(F.max("onl_len").alias("onl_len"), F.max("hist_len").alias("hist_len"), F.min(F.when(F.col("target") == 1, F.col("step"))).alias("tau"))
    meta = meta.where(F.col("onl_len") >= least).withColumn("lim", limit).where("lim >= 30")
    at = lambda j: (10 + (F.col("id") * 31 + j * 57) % (F.col("lim") - 10)).cast("long")
    drawn = meta.select("id", F.col("hist_len").alias("hl"), F.posexplode(F.array(*(at(F.lit(j)) for j in range(cuts)))).alias("j", "k"))
    rows = panel.join(drawn, "id").withColumn("step", F.col("time") - F.col("hl") - F.col("k"))
    return rows.select((F.lit(100000) + F.col("id") * 10 + F.col("j")).alias("id"), "time", "value", F.when(F.col("step") < 0, 1).otherwise(2).alias("period"), "step", F.when(F.col("step") < 0, 0).otherwise(F.col("target")).alias("target"))


def mirrored(panel: DataFrame) -> DataFrame:
    """Each series upside down around zero, under another id."""
    return panel.withColumn("id", F.lit(200000) + F.col("id")).withColumn("value", -F.col("value"))


def windows(online: DataFrame, width: int = 128, stride: int = 16, lo: float = 0.15, hi: float = 0.85) -> DataFrame:
    """(id, start, label, values): windows before the break (0), and around it with the break between lo and hi of their width (1)."""
    by = online.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("s"), F.min(F.when(F.col("target") == 1, F.col("step"))).alias("tau"))
    cut = by.withColumn("start", F.explode(F.when(F.size("s") >= width, F.sequence(F.lit(0), F.size("s") - width, F.lit(stride))).otherwise(F.array().cast("array<int>"))))
    inside = (F.col("tau") - F.col("start")) / float(width)
    label = F.when(F.col("tau").isNull() | (F.col("start") + width <= F.col("tau")), 0).when((inside >= lo) & (inside <= hi), 1)
    kept = cut.withColumn("label", label).where("label is not null")
    return kept.select("id", F.col("start").cast("long").alias("start"), "label", F.transform(F.slice("s", F.col("start") + 1, F.lit(width)), lambda x: x["value"]).alias("values"))


def _given(value: Column, use) -> Column:
    """use(value), with value made once: a lambda over it would otherwise hold its whole expression and make it anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def standardised(series: Column) -> Column:
    """An array less its mean, by its deviation. Work grows with its length."""
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    spread = lambda s, m: F.sqrt(F.greatest(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(s), F.lit(1e-24)))
    scaled = lambda s, m, sd: F.transform(s, lambda x: (x - m) / sd)
    return _given(series, lambda s: _given(mean(s), lambda m: _given(spread(s, m), lambda sd: scaled(s, m, sd))))


def backward(panel: DataFrame) -> DataFrame:
    """Every series with the border moved back, under another id: the last quarter of its history goes online, breaks stay where they are in time."""
    moved = panel.withColumn("id", F.lit(300000) + F.col("id")).withColumn("lead", F.floor(F.col("hist_len") / 4))
    moved = moved.withColumn("hist_len", F.col("hist_len") - F.col("lead")).withColumn("onl_len", F.col("onl_len") + F.col("lead")).withColumn("step", F.col("time") - F.col("hist_len"))
    return moved.withColumn("period", F.when(F.col("step") < 0, 1).otherwise(2)).drop("lead")


def sampled_steps(online: DataFrame, target: int = 60) -> DataFrame:
    """The rows of a series at about target steps, closer together at its beginning. It uses the length, so only for training rows."""
    n = F.count("*").over(Window.partitionBy("id"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda k: F.floor(F.pow(n.cast("double"), k / float(target - 1)) + 1e-9) - 1)
    return online.withColumn("keep", (n <= target) | F.array_contains(grid, F.col("step"))).where("keep").drop("keep")
