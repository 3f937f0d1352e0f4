"""The same series seen otherwise: panels of transformed values, over which every family can be made and fitted anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans import fits


def compressed(panel: DataFrame) -> DataFrame:
    """Values by their inverse hyperbolic sine."""
    return panel.withColumn("value", F.asinh("value"))


def _numbered(panel: DataFrame) -> DataFrame:
    """A panel with time, steps and lengths counted anew, after points have gone."""
    by, whole = Window.partitionBy("id").orderBy("time"), Window.partitionBy("id")
    hist = F.sum((F.col("period") == 1).cast("long")).over(whole)
    rows = panel.withColumn("hist_len", hist).withColumn("onl_len", F.count("*").over(whole) - hist).withColumn("time", F.row_number().over(by) - 1)
    return rows.withColumn("step", F.col("time") - F.col("hist_len"))


def deviations(panel: DataFrame, rows: int = 10) -> DataFrame:
    """Values less the mean of the rows before them; the first ones, which have too few, are gone."""
    by = Window.partitionBy("id").orderBy("time")
    before = by.rowsBetween(-rows, -1)
    made = panel.withColumn("n", F.count("*").over(before)).withColumn("value", F.col("value") - F.avg("value").over(before))
    return _numbered(made.where(F.col("n") == rows).drop("n"))


def whitened(panel: DataFrame) -> DataFrame:
    """Standardised values less rho times the one before, rho the history's lag-1 correlation, within 0.95; the first point is gone."""
    m = fits.moments(panel)
    by = Window.partitionBy("id").orderBy("time")
    z = panel.join(m.select("id", "mu", "sd0"), "id").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd0")).withColumn("zp", F.lag("z").over(by)).drop("mu", "sd0")
    h = F.col("period") == 1
    whole = Window.partitionBy("id")
    rho = F.sum(F.when(h, F.col("z") * F.col("zp"))).over(whole) / F.greatest(F.sum(F.when(h & F.col("zp").isNotNull(), F.col("zp") * F.col("zp"))).over(whole), F.lit(1e-12))
    rho = F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.coalesce(rho, F.lit(0.0))))
    made = z.withColumn("rho", rho).withColumn("value", F.col("z") - F.col("rho") * F.col("zp")).where("zp is not null")
    return _numbered(made.drop("z", "zp", "rho"))


def last_history(panel: DataFrame, points: int = 512) -> DataFrame:
    """Only the last points of each history, and the online part."""
    return _numbered(panel.where(F.col("time") >= F.col("hist_len") - points))


def anchored(panel: DataFrame, points: int) -> DataFrame:
    """The online part alone, its first points for a history; steps keep the number they had in step0."""
    rows = panel.where("period = 2").withColumn("step0", F.col("step"))
    rows = rows.withColumn("period", F.when(F.col("step") < points, 1).otherwise(2)).withColumn("time", F.col("step"))
    return _numbered(rows).where(F.col("onl_len") > 0)


def anchor_view(panel: DataFrame, made, names: list[str], anchors: tuple[int, ...] = (10, 40), blank: float = 0.5) -> DataFrame:
    """(id, step, names): a family (made of a panel) fitted on the first online points, anew at each anchor; blank before the first."""
    parts = panel.where((F.col("period") == 2) & (F.col("step") < anchors[0])).select("id", "step", *(F.lit(blank).alias(n) for n in names))
    for a, b in zip(anchors, [*anchors[1:], None]):
        got = made(anchored(panel, a)).withColumn("step", F.col("step") + a)
        parts = parts.unionByName((got.where(F.col("step") < b) if b else got).select("id", "step", *names))
    return parts


def raw_inputs(panel: DataFrame, fitted: DataFrame) -> DataFrame:
    """(id, step, z, asinh_z): the two plain inputs of a sequence model. fitted: moments."""
    z: Column = (F.col("value") - F.col("mu")) / F.col("sd0")
    return panel.where("period = 2").join(fitted, "id").select("id", "step", z.alias("z"), F.asinh(z).alias("asinh_z"))


def ordered_window(panel: DataFrame, fitted: DataFrame, rows: int = 32, most: float = 20.0) -> DataFrame:
    """(id, step, w0.., o0..): the last standardised values, zeros before the first, and the same in order of size, zeros after the last."""
    z = F.greatest(F.lit(-most), F.least(F.lit(most), (F.col("value") - F.col("mu")) / F.col("sd0")))
    by = Window.partitionBy("id").orderBy("step")
    x = panel.where("period = 2").join(fitted, "id").select("id", "step", z.alias("z"))
    x = x.withColumn("l", F.sort_array(F.collect_list("z").over(by.rowsBetween(1 - rows, 0))))
    last = [F.coalesce(F.lag("z", rows - 1 - k).over(by) if k < rows - 1 else F.col("z"), F.lit(0.0)).alias(f"w{k}") for k in range(rows)]
    return x.select("id", "step", *last, *(F.coalesce(F.get("l", F.lit(k)), F.lit(0.0)).alias(f"o{k}") for k in range(rows)))
