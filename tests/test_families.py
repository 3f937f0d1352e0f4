"""Window expressions against plain loops, prefix invariance, and batch against stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import families, grouped, innovations
from driftline.plans import fits
from driftline.plans.panel import from_table, online
from driftline.plans.staged import rendered
from driftline.streaming import jobs
from driftline.streaming.detectors import squash


def table(series: dict[int, np.ndarray]):
    return [(i, t, float(v)) for i, values in series.items() for t, v in enumerate(values)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    series = {k: np.concatenate([rng.normal(size=120), rng.normal(loc=k % 2, scale=1 + k % 3, size=80)]) for k in range(4)}
    return from_table(spark.createDataFrame(table(series), "s long, t long, v double"), "s", ["t"], "v").cache()


def values(df, id, column):
    return [r[0] for r in df.where(F.col("id") == id).orderBy("step").select(column).collect()]


def test_cusum_and_variance_ratio_are_the_recurrences(spark, panel):
    stages, names = families.monitor()
    got = rendered(online(panel, fits.trend(panel)), stages).cache()
    for i in (0, 1):
        z, up, down, peak, mean, var, ratio_peak = values(got, i, "raw"), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0
        cusum, ratio = values(got, i, "raw_cusum"), values(got, i, "raw_variance_ratio")
        for t, x in enumerate(z):
            up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
            peak = max(peak, up, down)
            assert cusum[t] == pytest.approx(squash(peak / (0.84 * math.log(max(t + 1, 2)) + 1e-9)), abs=1e-9)
            e = x - mean
            mean += 0.02 * e
            var = 0.98 * (var + 0.02 * e * e)
            if t + 1 >= 20:
                ratio_peak = max(ratio_peak, abs(math.log(max(var, 1e-12))))
            assert ratio[t] == pytest.approx(squash(ratio_peak / 0.55), abs=1e-9)


def test_mass_battery_is_the_recurrence(spark, panel):
    stages, names = families.mass()
    assert len(names) == 90
    got = rendered(online(panel, fits.mass_reference(panel)), stages)
    rows = got.where("id = 2").orderBy("step").collect()
    m1 = m2 = 0.0
    for r in rows:
        m1, m2 = 0.96 * m1 + 0.04 * abs(r["z"]), 0.96 * m2 + 0.04 * r["z"] ** 2
        assert r["gap_a25"] == pytest.approx(np.clip((m1 - r["h1_a"]) / math.sqrt(r["h2_a"] / 25), -20, 20), abs=1e-8)
        assert r["lvr_a25"] == pytest.approx(np.clip(math.log(max(m2 - m1 * m1, 1e-9) / r["h2_a"]), -20, 20), abs=1e-7)


def test_no_channel_sees_the_future(spark, panel):
    cut = panel.where("step < 30")
    for (stages, names), fit in ((families.multiscale(), fits.trend), (families.rolling_acf(), fits.acf_reference), (families.tails(), fits.tail_reference)):
        whole = rendered(online(panel, fit(panel)), stages).where("step < 30").select("id", "step", *names)
        short = rendered(online(cut, fit(cut)), stages).select("id", "step", *names)
        a, b = (np.array(x.orderBy("id", "step").collect(), float) for x in (whole, short))
        assert np.allclose(a, b, atol=1e-9)


def test_stream_agrees_with_batch_however_points_are_split(spark, panel):
    points = online(panel, fits.moments(panel)).select("id", "step", "value", "mu", "sd0")
    got = jobs.replay(points, 5)
    assert got.count() == points.count()
    z = np.array(values(points.withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd0")), 3, "z"))
    up = down = peak = 0.0
    for t, (x, c) in enumerate(zip(z, values(got, 3, "cusum"))):
        up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
        peak = max(peak, up, down)
        assert c == pytest.approx(squash(peak / (0.84 * math.log(max(t + 1, 2)) + 1e-9)), abs=1e-9)


def test_white_battery_on_a_break_in_scale(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=1900)
    x = np.zeros(1900)
    for t in range(1, 1900):
        x[t] = 0.6 * x[t - 1] + noise[t] * (2.5 if t >= 1600 else 1.0)
    panel = from_table(spark.createDataFrame(table({1: x}), "s long, t long, v double"), "s", ["t"], "v", 0.7)
    streams = innovations.streams(panel).cache()
    assert streams.first()["ar_order"] >= 1
    stages, names = innovations.battery()
    got = rendered(streams, stages).where("step >= 0").select("step", *names)
    before, after = (got.where(f"step = {s}").first() for s in (260, 560))
    assert after["scale_cusum"] > before["scale_cusum"] + 5
    odds = innovations.odds(streams)
    assert odds.where("step = 560").first()["mix_up"] > odds.where("step = 260").first()["mix_up"] + 5


def test_window_expressions_of_the_white_battery_are_the_recurrences(spark, panel):
    streams = innovations.streams(panel).cache()
    stages, names = innovations.battery()
    got = rendered(streams, stages).where("id = 1 and step >= 0").orderBy("step").collect()
    nu = [r[0] for r in streams.where("id = 1").orderBy("step").select("nu").collect()]
    k, port, up, down = len(nu) - len(got), 0.0, 0.0, 0.0
    for t, r in enumerate(got):
        x, before = nu[k + t], nu[k + t - 2]
        port += 0.01 * (x * before - port)
        up, down = max(0.0, up + x * before - 0.25), max(0.0, down - x * before - 0.25)
        assert r["port2"] == pytest.approx(port, abs=1e-9)
        assert r["lag2_cusum"] == pytest.approx(max(up, down), abs=1e-9)
        seg = np.array(nu[max(0, k + t - 31) : k + t + 1])
        assert r["glr_mean32"] == pytest.approx(abs(seg.sum()) / math.sqrt(len(seg)), abs=1e-9)


def test_run_lengths_restart_after_a_shift(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400), rng.normal(size=200), rng.normal(3.0, 1, 67)])
    panel = from_table(spark.createDataFrame(table({1: x}), "s long, t long, v double"), "s", ["t"], "v")
    got = grouped.run_lengths(panel).orderBy("step").collect()
    assert all(0 <= r["p_5"] <= r["p_20"] + 1e-12 <= r["p_60"] + 2e-12 <= 1 + 1e-9 for r in got)
    assert np.mean([r["p_20"] for r in got[202:212]]) > np.mean([r["p_20"] for r in got[150:199]]) + 0.3


def test_novelty_of_a_wider_stream(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=900), rng.normal(size=300), 4 * rng.normal(size=300)])
    panel = from_table(spark.createDataFrame(table({1: x}), "s long, t long, v double"), "s", ["t"], "v")
    got = grouped.novelty(panel, (100,)).orderBy("step").collect()
    assert [r["near_100"] for r in got[:4]] == [0.0] * 4
    assert np.mean([r["near_100"] for r in got[450:]]) > np.mean([r["near_100"] for r in got[150:290]]) + 1


def test_novelty_windows_are_the_reference_ones(spark):
    x = np.random.default_rng(5).normal(size=600)
    panel = from_table(spark.createDataFrame(table({1: x}), "s long, t long, v double"), "s", ["t"], "v")
    got = grouped.novelty(panel).where("step = 30").first()
    assert [c for c in got.asDict() if c.startswith("near_")] == ["near_25", "near_50", "near_100", "near_250"]
    assert all(got[f"near_{w}"] != 0 for w in (25, 50, 100))


def test_constant_and_short_histories_stay_finite(spark):
    series = {1: np.ones(200), 2: np.arange(12.0), 3: np.concatenate([np.random.default_rng(0).normal(size=40), [np.nan, np.inf]])}
    panel = from_table(spark.createDataFrame(table(series), "s long, t long, v double"), "s", ["t"], "v")
    assert panel.where("id = 3").count() == 40
    for (stages, names), fit in ((families.monitor(), fits.trend), (families.mass(), fits.mass_reference)):
        got = rendered(online(panel, fit(panel)), stages).select(*names).collect()
        assert all(v is None or math.isfinite(v) for r in got for v in r)
