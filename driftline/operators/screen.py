"""What changes at breaks that the eye does not see: statistics before and after, against cuts of unbroken series.

A case is a cut of a series: at its break, or, for each break, at the same step of
two unbroken series of about its length. A case's last points before the cut and
its first after it are two windows; statistics of both are compared. A case is
hidden if neither mean, spread, neighbours' correlation nor kurtosis changes by
more than the rule allows, which is asked of breaks and controls alike. As every
statistic wanders, only what breaks show over controls counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.relational import matched_controls
from driftline.session import ship

#: What a hidden case may change by: mean (in deviations), spread (from, to), lag-1 correlation, kurtosis.
RULE = {"mean": 0.3, "spread": (0.85, 1.18), "ac1": 0.12, "kurt": 1.5}
LAGS = (1, 3, 10, 30)
STATISTICS = [*(f"ac{k}" for k in LAGS), "vol_ac1", "abs_ac5", "diff_sd", "diff_kurt", "turning", "bend", "q95", "q99", "crossing", "long_var"]
SPECTRUM = ["low", "middle", "high", "entropy", "peak"]


def cases(panel: DataFrame, width: int, per: int = 2) -> DataFrame:
    """(case, place, id, broken, cut): each break with width points on either side of it, and its controls (place 1 and on)."""
    each = panel.where("period = 2").groupBy("id").agg(F.max("hist_len").alias("h"), F.max("onl_len").alias("n"), F.max("target").alias("broken"), F.min(F.when(F.col("target") == 1, F.col("step"))).alias("tau"))
    fit = each.where((F.col("broken") == 0) | ((F.col("n") - F.col("tau") >= width) & (F.col("tau") + F.col("h") >= width)))
    breaks = fit.where("broken = 1").select(F.col("id").alias("case"), F.lit(0).cast("long").alias("place"), "id", "broken", F.col("tau").alias("cut"))
    dealt = matched_controls(fit.select("id", "n", "broken"), "id", "n", "broken", per, width=32)
    cut = dealt.join(breaks.select(F.col("case").alias("id"), "cut"), "id").select(F.col("id").alias("case"), (F.col("place") + 1).alias("place"), F.col("control").alias("id"), "cut")
    known = each.select("id", "h", "n")
    held = cut.join(known, "id").select("case", "place", "id", F.lit(0).alias("broken"), F.least("cut", F.col("n") - width).alias("cut"), "h")
    return breaks.unionByName(held.where(F.col("cut") + F.col("h") >= width).where("cut >= 0").drop("h"))


def sides(panel: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(case, place, broken, after, pos, value): the windows before (0) and after (1) each cut, points numbered from 0."""
    cut = found.select("case", "place", "broken", F.col("id").alias("of"), "cut")
    rows = panel.join(cut, F.col("id") == F.col("of")).where((F.col("step") >= F.col("cut") - width) & (F.col("step") < F.col("cut") + width))
    after = (F.col("step") >= F.col("cut")).cast("int")
    return rows.select("case", "place", "broken", after.alias("after"), (F.col("step") - F.col("cut") + width * (1 - after)).cast("long").alias("pos"), "value")


def _unbiased(kurt: Column, n: Column) -> Column:
    """Excess kurtosis of a sample from that of its values."""
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


def statistics(rows: DataFrame) -> DataFrame:
    """(case, place, broken, after, mean, sd, kurt, STATISTICS) of each window of sides()."""
    key = ["case", "place", "broken", "after"]
    whole, by = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("pos")
    z = rows.withColumns({"mean": F.avg("value").over(whole), "sd": F.stddev_pop("value").over(whole)})
    z = z.withColumn("z", (F.col("value") - F.col("mean")) / (F.col("sd") + 1e-12))
    z = z.withColumns({f"z{k}": F.lag("z", k).over(by) for k in (*LAGS, 5)}).withColumn("d", F.col("z") - F.col("z1"))
    z = z.withColumn("d1", F.lag("d").over(by)).withColumn("n", F.count("*").over(whole)).withColumn("near", F.avg("z").over(by.rowsBetween(0, 49)))
    crossed = F.when(F.col("z1").isNotNull(), (F.signum("z") != F.signum("z1")).cast("double"))
    got = z.groupBy(*key).agg(
        F.first("mean").alias("mean"), F.first("sd").alias("sd"), _unbiased(F.kurtosis("value"), F.count("value")).alias("kurt"),
        *(F.corr("z", f"z{k}").alias(f"ac{k}") for k in LAGS), F.corr(F.col("z") * F.col("z"), F.col("z1") * F.col("z1")).alias("vol_ac1"), F.corr(F.abs("z"), F.abs("z5")).alias("abs_ac5"),
        F.stddev_pop("d").alias("diff_sd"), _unbiased(F.kurtosis("d"), F.count("d")).alias("diff_kurt"), F.corr("d", "d1").alias("turning"), F.corr("z", F.col("z1") * F.col("z1")).alias("bend"),
        *(F.percentile(F.abs("z"), F.lit(p)).alias(n) for n, p in (("q95", 0.95), ("q99", 0.99))), F.avg(crossed).alias("crossing"),
        F.var_pop(F.when((F.col("pos") % 10 == 0) & (F.col("pos") < F.col("n") - 50), F.col("near"))).alias("long_var"),
    )
    return got


def spectra(rows: DataFrame) -> DataFrame:
    """(case, place, broken, after, SPECTRUM): shares of the spectrum's power by range, its entropy and its highest value. A window is one group."""
    ship(rows.sparkSession)
    key = ["case", "place", "broken", "after"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("pos")["value"].to_numpy(float)
        power = np.abs(np.fft.rfft((v - v.mean()) / (v.std() + 1e-12) * np.hanning(len(v)))[1:]) ** 2
        share, k = power / (power.sum() + 1e-12), len(power)
        made = [share[: k // 8].sum(), share[k // 8 : k // 3].sum(), share[2 * k // 3 :].sum(), -(share * np.log(share + 1e-12)).sum(), share.max()]
        return pd.DataFrame([[*pdf[key].iloc[0], *made]], columns=[*key, *SPECTRUM])

    return rows.groupBy(*key).applyInPandas(one, "case long, place long, broken int, after int, " + ", ".join(f"{c} double" for c in SPECTRUM))


def judged(stats: DataFrame, names: list[str]) -> DataFrame:
    """(case, place, broken, hidden, changes of names) of cases with both windows."""
    key = ["case", "place", "broken"]
    before = stats.where("after = 0").select(*key, *(F.col(c).alias(f"b_{c}") for c in ("mean", "sd", "kurt", *names)))
    both = stats.where("after = 1").join(before, key)
    low, high = RULE["spread"]
    spread = F.col("sd") / (F.col("b_sd") + 1e-12)
    hidden = (F.abs(F.col("mean") - F.col("b_mean")) / (F.col("b_sd") + 1e-12) <= RULE["mean"]) & (spread >= low) & (spread <= high)
    hidden &= (F.abs(F.col("ac1") - F.col("b_ac1")) <= RULE["ac1"]) & (F.abs(F.col("kurt") - F.col("b_kurt")) <= RULE["kurt"])
    return both.select(*key, F.coalesce(hidden, F.lit(False)).alias("hidden"), *((F.col(c) - F.col(f"b_{c}")).alias(c) for c in names))


def excess(changes: DataFrame, names: list[str]) -> DataFrame:
    """(hidden, name, breaks, controls, sd_break, sd_control, ratio, far_break, far_control) of each statistic's changes; far: more than two of the controls' deviations."""
    long = changes.select("hidden", "broken", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("d")) for c in names))).alias("x")).select("hidden", "broken", "x.*")
    of = lambda y: F.when(F.col("broken") == y, F.col("d"))
    spread = long.groupBy("hidden", "name").agg(F.count(of(1)).alias("breaks"), F.count(of(0)).alias("controls"), F.stddev_samp(of(1)).alias("sd_break"), F.stddev_samp(of(0)).alias("sd_control"))
    far = long.join(spread.select("hidden", "name", "sd_control"), ["hidden", "name"]).withColumn("far", (F.abs("d") > 2 * F.col("sd_control")).cast("double"))
    share = far.groupBy("hidden", "name").agg(*(F.avg(F.when(F.col("broken") == y, F.col("far"))).alias(n) for y, n in ((1, "far_break"), (0, "far_control"))))
    return spread.join(share, ["hidden", "name"]).select("hidden", "name", "breaks", "controls", "sd_break", "sd_control", (F.col("sd_break") / F.nullif("sd_control", F.lit(0.0))).alias("ratio"), "far_break", "far_control")
