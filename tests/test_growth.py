"""Work that must grow no faster than the input."""

import math

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import augment, dynamics, forensics, grouped, innovations, learn
from driftline.plans import fits, staged
from driftline.plans.panel import from_table


def test_standardising_reads_an_array_a_fixed_number_of_times(spark):
    x = np.arange(2000) * 0.37 % 7
    rows = spark.createDataFrame([(x.tolist(),)], "s array<double>").select(augment.standardised(F.col("s")).alias("z"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2  # one for the mean, one for the deviation, neither inside another's lambda
    assert np.abs(np.array(rows.first()["z"]) - (x - x.mean()) / x.std()).max() < 1e-9


def test_exponential_means_of_many_series_are_those_of_each_by_itself():
    rng = np.random.default_rng(3)
    for lengths in ((1,), (1, 1, 1), (300, 1, 7, 129), (5, 2000)):
        x, begins = rng.normal(size=(2, sum(lengths))), np.cumsum((0, *lengths[:-1]))
        start = rng.normal(size=(2, len(lengths)))
        got = staged.means_of_many(x, begins, 0.1, start)
        for k, (b, n) in enumerate(zip(begins, lengths)):
            for row in range(2):
                assert np.abs(got[row, b : b + n] - staged.means(x[row, b : b + n], 0.1, start[row, k])).max() < 1e-12


def test_exponential_means_go_on_over_batches_without_a_call_a_series(spark):
    rows = spark.range(3).join(spark.range(-5, 4500).withColumnRenamed("id", "step")).withColumn("x", F.sin(F.col("step") + F.col("id")))
    rows = rows.withColumn("kept", F.sum("x").over(Window.partitionBy("id").orderBy("step")))
    made = staged.rendered(rows, [{"m": staged.ewma("x", 0.1, 2.0)}, {"after": staged.lag("m")}])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "FlatMapGroups" not in plan  # no call a series, and columns that it does not read are not sent
    got = made.toPandas().sort_values(["id", "step"])
    for id, one in got.groupby("id"):
        want = staged.means(one["x"].to_numpy()[5:], 0.1, 2.0)
        assert np.abs(one["m"].to_numpy()[5:] - want).max() < 1e-12 and np.abs(one["m"].to_numpy()[:5] - 1.8).max() < 1e-12


def test_rounding_takes_halves_as_other_engines_do(spark):
    x = [0.28345, -0.28345, 1.00005, 0.5, -2.5, 19.99995, 1e300, float("nan"), None, -1e-9]
    got = [r[1] for r in sorted(staged.output(spark.createDataFrame(list(enumerate(x)), "id long, v double"), ["v"], 4, ("id",)).collect())]
    want = duckdb.sql("SELECT round(v, 4) + 0.0 FROM (SELECT unnest([0.28345, -0.28345, 1.00005, 0.5, -2.5, 19.99995]::DOUBLE[]) AS v)").fetchall()
    assert got[:6] == [r[0] for r in want] and got[6] == 1e300 and math.isnan(got[7]) and got[8] is None and math.copysign(1, got[9]) == 1


def test_tables_of_students_t_are_made_once_and_scales_are_the_likeliest():
    assert innovations._student_table(5) is innovations._student_table(5)
    ref2 = np.square(np.random.default_rng(3).standard_t(5, 300))
    for df, scale in zip((3, 5, 10), innovations._t_scales(ref2, (3, 5, 10))):
        r = ref2 / scale**2
        assert abs(((df + 1) * r / (df + r)).mean() - 1) < 1e-9


def test_prefixes_of_all_scan_steps_are_those_of_each_by_itself(monkeypatch):
    rng = np.random.default_rng(5)
    ref, z = forensics.Reference(rng.normal(size=90)), rng.normal(size=400).round(1)
    ends = innovations.scan_steps(400)
    for made in (ref.first, ref.second):
        alone = np.concatenate([made(z[:t], np.array([t])) for t in ends])
        for table in (1, 3000, forensics.TABLE):  # points of a table, however many ends there are
            monkeypatch.setattr(forensics, "TABLE", table)
            assert np.abs(forensics._at_ends(made, z, ends) - alone).max() < 1e-9
    n, x = 57, z[:57]
    got = dict(zip(forensics.PREFIX, ref.first(x, np.array([n]))[0]))
    assert abs(got["half_mean"] - (x[n // 2 :].mean() - x[: n // 2].mean())) < 1e-12 and abs(got["dacf2"] - (np.corrcoef(x[:-2], x[2:])[0, 1] - ref.acf[2])) < 1e-12
    assert abs(got["dlogmad"] - np.log((np.median(np.abs(x - np.median(x))) + 1e-9) / (ref.mad + 1e-9))) < 1e-12 and abs(got["dq25"] - np.quantile(x, 0.25) + ref.quantile[0.25]) < 1e-12


def test_decayed_sums_ask_for_the_weights_of_a_keep_once():
    x = np.random.default_rng(6).normal(size=333)
    dynamics._fading.cache_clear()
    got = [dynamics._decayed(x, np.array([0.9]))[0] for _ in range(3)]
    want, y = [], 0.0
    for v in x:
        y = v + 0.9 * y
        want.append(y)
    assert dynamics._fading.cache_info().misses == 1 and all(np.abs(g - want).max() < 1e-12 for g in got)


def test_series_come_to_grouped_families_as_arrow_tables(spark):
    points = [(i, t, float(10 * i + t), 1 if t < 3 else 2) for i in (7, 8) for t in (4, 0, 3, 1, 2)]
    rows = spark.createDataFrame(points, "id long, time long, value double, period int").repartition(3)
    made = grouped._by_series(rows, ["seen", "none"], lambda h, o: np.column_stack([o + h[0], np.full(len(o), np.nan)]))
    assert "FlatMapGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["step"]): (r["seen"], r["none"]) for r in made.collect()}
    assert got == {(i, k): (20.0 * i + 3 + k, None) for i in (7, 8) for k in (0, 1)}  # what is not a number stays a null


def test_a_series_is_whitened_as_an_arrow_table_in_any_order():
    rng = np.random.default_rng(8)
    rows = pa.table({"id": np.full(300, 4), "time": np.arange(300), "value": rng.normal(size=300), "period": np.where(np.arange(300) < 180, 1, 2)})
    made = innovations._series(rows)
    assert made.column_names[:5] == ["id", "step", "nu", "nc", "lz"] and made["step"].to_pylist()[-120:] == list(range(120))
    assert made.equals(innovations._series(rows.take(rng.permutation(300))))


def test_a_trend_stands_beside_its_series_without_a_join(spark):
    points = [(i, t, float((7 * t * t + 3 * i) % 11)) for i, n in ((1, 60), (2, 20), (3, 1)) for t in range(n)]
    panel = from_table(spark.createDataFrame(points, "id long, t long, v double"), "id", ["t"], "v")
    got = fits.fitted(panel, fits.trend)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the panel is made once, not once for each pass over the history
    rows = got.toPandas()
    assert rows.groupby("id").size().to_dict() == {1: 24, 2: 8}  # a series without a history has no fit
    y = np.array([p[2] for p in points if p[0] == 1])[:36]
    slope, level = np.polyfit(np.arange(36), y, 1)
    e = y - level - slope * np.arange(36)
    one = rows[rows["id"] == 1].iloc[0]
    want = {"hn": 36, "slope": slope, "level": level + slope * 35, "sd": math.sqrt((e * e).sum() / 35), "rho": (e[1:] * e[:-1]).sum() / (e * e).sum()}
    assert all(abs(one[k] - v) < 1e-9 for k, v in want.items()) and abs(one["prev0"] - (y[-1] - want["level"]) / want["sd"]) < 1e-9
    alone = fits.trend(panel).toPandas().set_index("id")
    assert set(alone.index) == {1, 2} and all(abs(alone.loc[1, k] - v) < 1e-9 for k, v in want.items())


def test_learners_weigh_steps_without_moving_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, s, i % 2, 0.1 * i + 0.01 * s) for i in range(8) for s in range(i + 1)], "id long, step long, target int, a double")
    rows.write.parquet(f"{tmp_path}/rows")
    made = learn.assembled(spark.read.parquet(f"{tmp_path}/rows"), ["a"], logits=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan  # a step's rows need not meet in one task
    assert all(abs(r["w"] - 1 / (8 - r["step"])) < 1e-12 for r in made.collect()) and made.count() == rows.count()
    middle = learn.by_step(rows, mean_0=F.avg("a"), pos=F.sum("target")).where("step = 7").first()
    assert abs(middle["mean_0"] - 0.77) < 1e-12 and middle["pos"] == 1


def test_only_so_many_models_are_fitted_side_by_side_as_memory_holds():
    assert learn._side_by_side(1_000, 18, 5) == 5 and learn._side_by_side(0, 18, 5) == 5
    assert learn._side_by_side(2_500_000, 18, 5) == 2 and learn._side_by_side(86_000_000, 18, 5) == 1
