"""Ranked metrics across series: the time-stratified, pair-weighted AUC and what is taken from it.

A step's AUC compares all positive with all negative series at that step by
midranks; steps weigh by their pairs. Rows are counted by step and score first;
what lies below a score comes from running totals over ranges of (step, score),
so that a step with most of the rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.scans import running


def group_auc(scored: DataFrame, by: list[str], score: str = "score", y: str = "target") -> DataFrame:
    """(by, np, nn, auc): the midrank AUC of each group; auc is null where only one class is present."""
    each = scored.select(*by, F.col(score).alias("score"), F.col(y).alias("y")).groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = running(each, by, [F.asc_nulls_first("score")], {"lower": F.col("q")})
    sums = below.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("q").alias("nn"), F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2.0)).alias("wins"))
    return sums.select(*by, "np", "nn", F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("wins") / (F.col("np") * F.col("nn"))).alias("auc"))


def ts_auc(scored: DataFrame, score: str = "score", y: str = "target", step: str = "step") -> DataFrame:
    """One row (ts_auc, steps, pairs): steps with one class only are skipped; without any other step it is 0.5."""
    each = group_auc(scored, [step], score, y).where("auc is not null")
    pairs = F.col("np") * F.col("nn")
    return each.agg(F.coalesce(F.sum(F.col("auc") * pairs) / F.sum(pairs), F.lit(0.5)).alias("ts_auc"), F.count("*").alias("steps"), F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"))


def ts_auc_by(scored: DataFrame, group: str, score: str = "score", y: str = "target", step: str = "step") -> DataFrame:
    """(group, ts_auc): the same within each value of a column that a row's step or series gives."""
    each = group_auc(scored, [group, step], score, y).where("auc is not null")
    pairs = F.col("np") * F.col("nn")
    return each.groupBy(group).agg((F.sum(F.col("auc") * pairs) / F.sum(pairs)).alias("ts_auc"), F.sum(pairs).alias("pairs"))


def step_curve(scored: DataFrame, half: int = 12, score: str = "score", y: str = "target") -> DataFrame:
    """(step, auc, weight, smooth): each step's AUC and a centred mean of it over 2 half + 1 steps. A step is one row here."""
    each = group_auc(scored, ["step"], score, y).where("auc is not null")
    near = Window.orderBy("step").rowsBetween(-half, half)
    return each.select("step", "auc", (F.col("np") * F.col("nn")).alias("weight"), F.avg("auc").over(near).alias("smooth"))


def earnings(scored: DataFrame, score: str = "score", y: str = "target") -> DataFrame:
    """(id, earned, steps): the mean share of comparisons a series wins over the steps at which it is compared, ties one half."""
    s = scored.select("id", "step", F.col(score).alias("score"), F.col(y).alias("y"))
    each = s.groupBy("step", "score").agg(F.sum("y").alias("t1"), F.sum(1 - F.col("y")).alias("t0"))
    places = running(each, ["step"], [F.asc_nulls_first("score")], {"lt1": F.col("t1"), "lt0": F.col("t0")})
    totals = each.groupBy("step").agg(F.sum("t1").alias("n1"), F.sum("t0").alias("n0")).where("n1 > 0 and n0 > 0")
    places = places.join(totals, "step").withColumnsRenamed({"step": "at", "score": "of"})
    rows = s.join(places, F.col("step").eqNullSafe(F.col("at")) & F.col("score").eqNullSafe(F.col("of")))
    won = F.when(F.col("y") == 1, (F.col("lt0") + F.col("t0") / 2.0) / F.col("n0")).otherwise((F.col("n1") - F.col("lt1") - F.col("t1") / 2.0) / F.col("n1"))
    return rows.groupBy("id").agg(F.avg(won).alias("earned"), F.count("*").alias("steps"))


def weights(scored: DataFrame, y: str = "target", ramp: int = 50) -> DataFrame:
    """(id, step, step_weight, pair_weight, evidence_weight) of each row: each step alike, each pair alike, and positives by age since their break."""
    by, whole = Window.partitionBy("step"), F.col("step_rows")
    base = scored.select("id", "step", F.col(y).alias("y")).withColumn("step_rows", F.count("*").over(by)).withColumn("pos", F.sum("y").over(by))
    base = base.withColumn("first_pos", F.min(F.when(F.col("y") == 1, F.col("step"))).over(Window.partitionBy("id")))
    base = base.withColumn("w1", 1.0 / whole).withColumn("w2", F.col("pos") * (whole - F.col("pos")) / whole)
    means = base.agg(F.avg("w1").alias("a1"), F.avg("w2").alias("a2"))
    aged = F.when(F.col("y") == 1, F.greatest(F.lit(0.05), F.least(F.lit(1.0), (F.col("step") - F.col("first_pos") + 1) / float(ramp)))).otherwise(1.0)
    return base.crossJoin(F.broadcast(means)).select("id", "step", (F.col("w1") / F.col("a1")).alias("step_weight"), (F.col("w2") / F.nullif("a2", F.lit(0.0))).alias("pair_weight"), aged.alias("evidence_weight"))


def spearman(scored: DataFrame, a: str, b: str, by: str = "step") -> DataFrame:
    """(by, n, rho): rank correlation of two columns within each group, by midranks."""
    w = Window.partitionBy(by)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0
    ranked = scored.select(by, rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), (F.covar_pop("ra", "rb") / F.nullif(F.sqrt(F.var_pop("ra") * F.var_pop("rb")), F.lit(0.0))).alias("rho"))
