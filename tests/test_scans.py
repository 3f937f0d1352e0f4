"""Running totals over ranges, against loops."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from driftline.operators import metrics
from driftline.plans.scans import running


def test_running_totals_with_a_hot_group_nulls_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else int(g), None if v == 7 else int(v), int(w)) for g, v, w in zip(rng.choice([0, 0, 0, 1, 2, 3], 3000), rng.integers(0, 40, 3000), rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "g long, v long, w long").withColumn("extra", F.lit("x"))
    each = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = running(each, ["g"], [F.asc_nulls_first("v")], {"pos": F.lit(1), "below": F.col("w")}, ranges=7).collect()
    want, sums = defaultdict(list), defaultdict(int)
    for g, v, w in rows:
        sums[g, v] += w
    for (g, v), w in sums.items():
        want[g].append((v is not None, v or 0, w))
    assert len(got) == len(sums)
    for r in got:
        before = [w for a, b, w in want[r["g"]] if (a, b) < (r["v"] is not None, r["v"] or 0)]
        assert (r["pos"], r["below"]) == (len(before), sum(before))


def test_rows_that_all_tie_are_numbered_once_each_over_many_ranges(spark):
    df = spark.createDataFrame([(1, 1)] * 500, "g long, v long")
    out = running(df, ["g"], [F.col("v").asc()], {"pos": F.lit(1)}, ranges=5)
    assert sorted(r["pos"] for r in out.collect()) == list(range(500))


def test_auc_of_one_hot_step_is_that_of_its_pairs_and_no_task_holds_the_step(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0 if i % 10 else i % 3, float(rng.integers(0, 300)), int(rng.integers(2))) for i in range(2000)]
    scored = spark.createDataFrame(rows, "id long, step long, score double, target int")
    won = total = 0.0
    for step in {r[1] for r in rows}:
        pos = np.array([s for _, t, s, y in rows if t == step and y == 1])
        neg = np.array([s for _, t, s, y in rows if t == step and y == 0])
        won += (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        total += len(pos) * len(neg)
    assert abs(metrics.ts_auc(scored).first()["ts_auc"] - won / total) < 1e-12
    each = scored.groupBy("step", "score").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be put in one task again
    try:
        dealt = running(each, ["step"], [F.col("score").asc()], {"at": F.lit(1)}, ranges=8)
        held = dealt.where("step = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held["all"] == len({s for _, t, s, _ in rows if t == 0}) and held["most"] <= 0.7 * held["all"]
